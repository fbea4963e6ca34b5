"""Blend modes, composites and masks: the same projection over two aligned rasters."""

from __future__ import annotations

from pixelmill.functions import color
from pixelmill.functions.color import RGB, clamp, luminance, mix, smoothstep
from pixelmill.operators.pointwise import done
from pixelmill.operators.spatial import bilinear, gather, place
from pixelmill.operators.registry import EFFECTS, apply, effect
from pixelmill.plans.rel import num
from pixelmill.sources.rasters import COLOUR

TAU = 6.283185307179586


def _overlay(a, b):
    """Twice the product below the middle of ``a``, its mirror above."""
    return f"(case when {a} <= 0.5 then 2.0 * {a} * {b} else 1.0 - 2.0 * (1.0 - {a}) * (1.0 - {b}) end)"


def _soft(a, b):
    root = f"(case when {a} <= 0.25 then ((16.0 * {a} - 12.0) * {a} + 4.0) * {a} else sqrt(greatest({a}, 0.0)) end)"
    return f"(case when {b} <= 0.5 then {a} - (1.0 - 2.0 * {b}) * {a} * (1.0 - {a}) else {a} + (2.0 * {b} - 1.0) * ({root} - {a}) end)"


#: mode -> expression of base and top.
BLENDS = {
    "normal": lambda a, b: b,
    "multiply": lambda a, b: f"({a} * {b})",
    "screen": lambda a, b: f"({a} + {b} - {a} * {b})",
    "overlay": _overlay,
    "hard-light": lambda a, b: _overlay(b, a),
    "soft-light": _soft,
    "darken": lambda a, b: f"least({a}, {b})",
    "lighten": lambda a, b: f"greatest({a}, {b})",
    "difference": lambda a, b: f"abs({a} - {b})",
    "exclusion": lambda a, b: f"({a} + {b} - 2.0 * {a} * {b})",
    "add": lambda a, b: f"({a} + {b})",
    "subtract": lambda a, b: f"greatest({a} - {b}, 0.0)",
}


def mask_coverage(rel, mask: dict, image=None):
    """Adds ``cover`` (0 to 1): a luminance band, nearness to a colour, or a channel of another raster."""
    kind = mask["kind"]
    if kind == "luminance":
        low, high, f = mask["low"], mask["high"], mask.get("feather", 0.0)
        rel = rel.let(lum=luminance())
        raw = f"least({smoothstep(num(low - f), num(low), 'lum')}, 1.0 - {smoothstep(num(high), num(high + f), 'lum')})"
    elif kind == "color":
        target = color.oklab_value([color.decode_value(v / 255) for v in mask["color"]])
        rel = color.oklab(rel)
        away = " + ".join(f"pow({c} - ({num(t)}), 2)" for c, t in zip(("lab_l", "lab_a", "lab_b"), target, strict=True))
        raw = f"1.0 - {smoothstep(num(mask['tolerance']), num(mask['tolerance'] + mask.get('feather', 0.0)), f'sqrt({away})')}"
    else:
        channel = {"luminance": luminance(), "alpha": "a", "red": "r", "green": "g", "blue": "b"}[mask["channel"]]
        on = [c for c in place(rel) if c in image.columns]  # a still masks every frame
        rel = rel.join(image.let(m=channel).keep(*on, "m"), on, "left")
        raw = "coalesce(m, 0.0)"  # where a smaller mask does not reach, it covers nothing
    return rel.let(cover=f"1.0 - {clamp(raw)}" if mask.get("invert") else clamp(raw))


def mask_problem(mask: dict) -> str | None:
    if mask["kind"] == "luminance" and not 0 <= mask["low"] <= mask["high"] <= 1:
        return "mask-bounds"
    if mask["kind"] == "color" and not mask["tolerance"] > 0:
        return "mask-tolerance"
    return "mask-feather" if mask.get("feather", 0) < 0 else None


def composite(base, top, blend: str = "normal", opacity: float = 1.0, mask: dict | None = None, image=None):
    """base + (blend(base, top) - base) * opacity * mask; alpha moves by the same amount.

    Full opacity, normal and unmasked is ``top`` itself: no join.
    """
    if blend == "normal" and opacity == 1.0 and mask is None:
        return top
    if mask is not None:
        base = mask_coverage(base, mask, image)
    over = top.let(**{f"t{c}": c for c in COLOUR}).keep(*place(top), *[f"t{c}" for c in COLOUR])
    both = base.join(over, [c for c in place(base) if c in over.columns])  # a still lies under or over every frame
    amount = f"({num(opacity)} * cover)" if mask is not None else num(opacity)
    out = {c: mix(c, BLENDS[blend](c, f"t{c}"), amount) for c in RGB}
    return done(both.let(**out, a=mix("a", "ta", amount)))


def laid_over(base, effect_id: str, params: dict, ctx, blend: str = "normal", opacity: float = 1.0, mask: dict | None = None, image=None):
    """The composite of an effect's result over what it was applied to. On Spark an effect of single pixels takes the pixel below
    along (columns ``under_``), so that the two need not be joined."""
    e = EFFECTS[effect_id]
    if base.d.spark and e.access == "pointwise" and not e.resamples and not (blend == "normal" and opacity == 1.0 and mask is None):
        own = base.where(" and ".join(f"{c} is not null" for c in place(base)))  # as a join has it
        under = {f"under_{c}": c for c in (*COLOUR, "idx") if c in base.columns}
        if mask is not None:
            own, under = mask_coverage(own, mask, image), under | {"under_cover": "cover"}
        top = apply(own.let(**under).keep(*base.columns, *under), effect_id, params, ctx)
        if set(under) <= set(top.columns):
            amount = f"({num(opacity)} * under_cover)" if mask is not None else num(opacity)
            out = {c: mix(f"under_{c}", BLENDS[blend](f"under_{c}", c), amount) for c in RGB}
            out = top.let(**out, a=mix("under_a", "a", amount), **({"idx": "under_idx"} if "idx" in base.columns else {}))
            return done(out.keep(*base.columns))
    return composite(base, apply(base, effect_id, params, ctx), blend, opacity, mask, image)


def flatten(rel, matte=(1.0, 1.0, 1.0)):
    """Over an opaque matte, in linear light."""
    return rel.let(**{c: f"{c} * a + {num(m)} * (1.0 - a)" for c, m in zip(RGB, matte, strict=True)}, a=num(1))


def composites(base, top, blends, opacity: float = 1.0):
    """The unmasked composite by each of ``blends``, named in ``mode``: both rasters meet once, then each pair has a row for every mode."""
    over = top.let(**{f"t{c}": c for c in COLOUR}).keep(*place(top), *[f"t{c}" for c in COLOUR])
    both = base.join(over, [c for c in place(base) if c in over.columns]).explode("mode", base.d.array(f"'{b}'" for b in blends))

    def blended(c):
        return "case mode " + " ".join(f"when '{b}' then {BLENDS[b](c, f't{c}')}" for b in blends) + " end"

    out = {c: mix(c, f"({blended(c)})", num(opacity)) for c in RGB}
    both = both.let(**out, a=mix("a", "ta", num(opacity)))
    return both.keep(*done(both).columns, "mode")


FEEDBACK = "decay:float[0,1]=0.9; blend:enum{screen/lighten/add/difference/darken/normal}=screen; opacity:float[0,1]=1; offsetX:float[-64,64]=0; offsetY:float[-64,64]=0; scale:float[0.9,1.1]=1; rotate:float[-0.05,0.05]=0"


def feedback_step(now, before, p):
    """One frame over the previous output, which is moved, scaled, turned and faded; outside it is transparent black."""
    import math

    c, s = math.cos(-TAU * p["rotate"]), math.sin(-TAU * p["rotate"])
    at = now.let(dx=f"(x + 0.5 - w / 2.0 - {num(p['offsetX'])}) / {num(p['scale'])}", dy=f"(y + 0.5 - h / 2.0 - {num(p['offsetY'])}) / {num(p['scale'])}")
    at, taps = bilinear(at, f"(dx * {num(c)} - dy * {num(s)} + w / 2.0)", f"(dx * {num(s)} + dy * {num(c)} + h / 2.0)", "off")
    past = gather(at, before, [(x, y, {"k": k}) for x, y, k in taps], {f"past{c}": f"w_k * s_{c} * {num(p['decay'])}" for c in RGB}, carry=COLOUR)
    return done(past.let(**{c: mix(c, BLENDS[p["blend"]](c, f"past{c}"), num(p["opacity"])) for c in RGB}))


@effect("feedback", "postprocess", FEEDBACK, access="global")
def feedback(rel, p, ctx):
    """Frames in order: frame 0 has no past; each later one reads the output before it.

    ``rel`` has a frame column and ``ctx.frames`` says how many; without one the
    raster is a still and its past is transparent black.
    """
    if "frame" not in rel.columns:
        return feedback_step(rel, rel.let(r=num(0), g=num(0), b=num(0), a=num(0)), p)
    out, last = None, None
    for frame in range(ctx.frames):
        now = rel.where(f"frame = {frame}").drop("frame")
        before = last if last is not None else now.let(r=num(0), g=num(0), b=num(0), a=num(0))
        last = feedback_step(now, before, p)
        own = last.let(frame=str(frame))
        out = own if out is None else out.union(own)
    return out


