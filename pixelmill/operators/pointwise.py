"""Effects that read one pixel: pure projections, which Catalyst fuses."""

from __future__ import annotations

import math

from pixelmill.functions import color, hashing
from pixelmill.functions.color import RGB, clamp, decode, encode, fract, luminance, mix, smoothstep
from pixelmill.operators.registry import effect
from pixelmill.plans.rel import num, whole
from pixelmill.sources.rasters import COLOUR, PIXEL

TAU = 2 * math.pi


def done(rel):
    """The columns of a raster, without what an effect added."""
    return rel.keep(*[c for c in rel.columns if c in {*PIXEL, *COLOUR, "idx", "frame"} or c.startswith("under_")])


def on_luma(rel, mode, transfer):
    """A transfer of encoded values: each channel, or luminance with colours scaled along."""
    if mode != "luma":
        return rel.let(**{c: decode(transfer(encode(c))) for c in RGB})
    rel = rel.let(lum=luminance()).let(mapped=decode(transfer(encode("lum"))))
    return done(rel.let(**{c: f"case when lum > 1e-6 then {c} * (mapped / lum) else mapped end" for c in RGB}))


@effect("brightness-contrast", "preprocess", "exposure:float[-8,8]=0; contrast:float[0,4]=1; brightness:float[-1,1]=0")
def brightness_contrast(rel, p, ctx):
    gain = num(2.0 ** p["exposure"])
    return rel.let(**{c: decode(f"(({encode(f'({c} * {gain})')}) - 0.5) * {num(p['contrast'])} + 0.5 + {num(p['brightness'])}") for c in RGB})


@effect(
    "levels",
    "preprocess",
    "inputBlack:float[0,1]=0; inputWhite:float[0,1]=1; gamma:float[0.1,9.99]=1; outputBlack:float[0,1]=0; outputWhite:float[0,1]=1; mode:enum{per-channel/luma}=per-channel",
)
def levels(rel, p, ctx):
    span = max(p["inputWhite"] - p["inputBlack"], 1 / 255)

    def transfer(v):
        t = clamp(f"(({v}) - {num(p['inputBlack'])}) / {num(span)}")
        return mix(num(p["outputBlack"]), num(p["outputWhite"]), f"pow({t}, {num(1 / p['gamma'])})")

    return on_luma(rel, p["mode"], transfer)


@effect("hsl", "preprocess", "hue:float[0,1]=0; saturation:float[0,3]=1; lightness:float[-1,1]=0")
def hsl(rel, p, ctx):
    c, s = math.cos(TAU * p["hue"]) * p["saturation"], math.sin(TAU * p["hue"]) * p["saturation"]
    rel = color.oklab(rel)
    lab = [f"greatest(lab_l + {num(p['lightness'])}, 0.0)", f"lab_a * {num(c)} - lab_b * {num(s)}", f"lab_a * {num(s)} + lab_b * {num(c)}"]
    return done(color.from_oklab(rel, lab))


def monotone_lut(points, n=256) -> list[float]:
    """A monotone cubic (Fritsch-Carlson) through the points, at n even places."""
    xs, ys = zip(*points, strict=True)
    d = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(len(xs) - 1)]
    m = [d[0], *[0.0 if d[i - 1] * d[i] <= 0 else (d[i - 1] + d[i]) / 2 for i in range(1, len(d))], d[-1]]
    for i, k in enumerate(d):
        if k == 0:
            m[i] = m[i + 1] = 0.0
        else:
            a, b = m[i] / k, m[i + 1] / k
            if (s := a * a + b * b) > 9:
                m[i], m[i + 1] = 3 * a / math.sqrt(s) * k, 3 * b / math.sqrt(s) * k
    out = []
    for j in range(n):
        x = j / (n - 1)
        if x <= xs[0] or x >= xs[-1]:
            out.append(ys[0] if x <= xs[0] else ys[-1])
            continue
        i = max(k for k in range(len(xs) - 1) if xs[k] <= x)
        h = xs[i + 1] - xs[i]
        t = (x - xs[i]) / h
        out.append(
            (2 * t**3 - 3 * t**2 + 1) * ys[i] + (t**3 - 2 * t**2 + t) * h * m[i] + (3 * t**2 - 2 * t**3) * ys[i + 1] + (t**3 - t**2) * h * m[i + 1]
        )
    return [min(max(v, 0.0), 1.0) for v in out]


def from_lut(d, lut, v):
    """Linear interpolation in a table over [0, 1]."""
    table = d.array([num(x) for x in lut])
    at = f"({clamp(v)}) * {num(len(lut) - 1)}"
    low = f"least({whole(at)}, {len(lut) - 2})"
    return mix(d.at(table, low), d.at(table, f"{low} + 1"), f"{at} - {low}")


@effect("curves", "preprocess", "curve:curve=0,0 0.25,0.2 0.75,0.8 1,1; mode:enum{per-channel/luma}=per-channel")
def curves(rel, p, ctx):
    lut = monotone_lut(p["curve"])
    return on_luma(rel, p["mode"], lambda v: from_lut(rel.d, lut, v))


def noise2(rel, px, py, draw):
    """Smoothed lattice noise of a point; draw(rel, cx, cy) gives (rel, unit value)."""
    rel = rel.let(px=px, py=py).let(ix=whole("px"), iy=whole("py"))
    rel = rel.let(fx="px - ix", fy="py - iy").let(wx="fx * fx * (3.0 - 2.0 * fx)", wy="fy * fy * (3.0 - 2.0 * fy)")
    v = {}
    for dx in (0, 1):
        for dy in (0, 1):
            rel, v[dx, dy] = draw(rel, f"(ix + {dx})", f"(iy + {dy})")
    return rel, mix(mix(v[0, 0], v[1, 0], "wx"), mix(v[0, 1], v[1, 1], "wx"), "wy")


#: Streams drawn from one seed; fixed values.
STREAMS = {"luma": 0x9E3779B9, "r": 0x85EBCA6B, "g": 0xC2B2AE35, "b": 0x27D4EB2F}
PHASE_STREAM, CELL_STREAM = 0x165667B1, 0x632BE59B


@effect(
    "noise-injection",
    "preprocess",
    "kind:enum{white/value/gaussian}=white; amount:float[0,1]=0.06; scale:float[1,64]=1; channels:enum{rgb/luma}=luma; seed:seed=0",
)
def noise_injection(rel, p, ctx):
    px, py = (f"(({v} + 0.5) / {num(p['scale'])})" for v in "xy")
    streams = [STREAMS["luma"]] * 3 if p["channels"] == "luma" else [STREAMS[c] for c in RGB]
    noise = []
    for stream in streams:
        salt = p["seed"] ^ stream

        def draw(rel, cx, cy, salt=salt):
            rel, h = hashing.multiplied(rel, cx, cy)
            rel, h = hashing.multiplied(rel, h, str(salt))
            return rel, hashing.unit(rel.d, h)

        if p["kind"] == "value":
            rel, v = noise2(rel, px, py, draw)
            v = f"(2.0 * {v} - 1.0)"
        else:
            rel, u = draw(rel, whole(px), whole(py))
            v = f"(2.0 * {u} - 1.0)"
            if p["kind"] == "gaussian":
                rel, h = hashing.multiplied(rel, whole(px), whole(py))
                rel, h = hashing.multiplied(rel, h, str(salt ^ PHASE_STREAM))
                normal = f"sqrt(-2.0 * ln(1.0 - {u})) * cos({num(TAU)} * {hashing.unit(rel.d, h)})"
                v = f"({clamp(normal, '-3.0', '3.0')} / 3.0)"
        name = f"n{len(noise)}"
        rel = rel.let(**{name: v})
        noise.append(name)
    return done(rel.let(**{c: decode(f"({encode(c)} + {n} * {num(p['amount'])})") for c, n in zip(RGB, noise, strict=True)}))


@effect("posterize", "preprocess", "levels:int[2,64]=4; mode:enum{rgb/luma}=rgb; space:enum{srgb/linear}=srgb")
def posterize(rel, p, ctx):
    n = num(p["levels"] - 1)
    to, back = (encode, decode) if p["space"] == "srgb" else (lambda v: v, lambda v: v)

    def band(v):
        return back(f"({rel.d.rint(f'{clamp(to(v))} * {n}')} / {n})")

    if p["mode"] == "rgb":
        return rel.let(**{c: band(c) for c in RGB})
    rel = rel.let(lum=luminance()).let(banded=band("lum"))
    return done(rel.let(**{c: f"case when lum <= 1e-6 then 0.0 else {c} * (banded / lum) end" for c in RGB}))


@effect("threshold", "preprocess", "level:float[0,1]=0.5; softness:float[0,1]=0")
def threshold(rel, p, ctx):
    half = p["softness"] / 2
    tone = encode(luminance())
    v = smoothstep(num(p["level"] - half), num(p["level"] + half), tone) if half > 1e-6 else f"case when {tone} > {num(p['level'])} then 1.0 else 0.0 end"
    return done(rel.let(v=v).let(**dict.fromkeys(RGB, "cast(v as double)")))


@effect("invert", "preprocess", "amount:float[0,1]=1; mode:enum{rgb/lightness}=rgb")
def invert(rel, p, ctx):
    amount = num(p["amount"])
    if p["mode"] == "rgb":
        return rel.let(**{c: mix(c, decode(f"(1.0 - {encode(c)})"), amount) for c in RGB})
    rel = color.oklab(rel)
    rel = color.from_oklab(rel, ["1.0 - lab_l", "lab_a", "lab_b"], ("nr", "ng", "nb"), "0.0", "1.0")
    return done(rel.let(**{c: mix(c, f"n{c}", amount) for c in RGB}))


@effect(
    "gradient-map",
    "preprocess",
    "shadowLightness:float[0,1]=0; shadowChroma:float[0,0.33]=0; shadowHue:float[0,360]=0; midLightness:float[0,1]=0.5; midChroma:float[0,0.33]=0; midHue:float[0,360]=0; highlightLightness:float[0,1]=1; highlightChroma:float[0,0.33]=0; highlightHue:float[0,360]=0; midPosition:float[0.05,0.95]=0.5; amount:float[0,1]=1",
)
def gradient_map(rel, p, ctx):
    stops = [color.oklch_value(p[f"{s}Lightness"], p[f"{s}Chroma"], p[f"{s}Hue"]) for s in ("shadow", "mid", "highlight")]
    at = num(p["midPosition"])
    rel = rel.let(tone=clamp(encode(luminance())))
    lab = [
        f"case when tone <= {at} then {mix(num(a), num(b), f'(tone / {at})')} else {mix(num(b), num(c), f'((tone - {at}) / (1.0 - {at}))')} end"
        for a, b, c in zip(*stops, strict=True)
    ]
    rel = color.from_oklab(rel, lab, ("nr", "ng", "nb"), "0.0", "1.0")
    return done(rel.let(**{c: mix(c, f"n{c}", num(p["amount"])) for c in RGB}))


@effect("vignette", "preprocess", "radius:float[0,2]=0.7; softness:float[0.01,2]=0.45; strength:float[0,1]=0.65")
def vignette(rel, p, ctx):
    u, v = "((x + 0.5 - w / 2.0) / (w / 2.0))", "((y + 0.5 - h / 2.0) / (h / 2.0))"
    mask = f"(1.0 - {smoothstep(num(p['radius']), num(p['radius'] + p['softness']), f'sqrt({u} * {u} + {v} * {v})')})"
    rel = rel.let(gain=mix("1.0", mask, num(p["strength"])))
    return done(rel.let(**{c: f"{c} * gain" for c in RGB}))


@effect(
    "light-leak",
    "preprocess",
    "positionX:float[-1,2]=0.12; positionY:float[-1,2]=0.1; radius:float[0,2]=0.3; softness:float[0.01,3]=0.8; lightness:float[0,1]=0.9; chroma:float[0,0.35]=0.12; hue:float[0,360]=55; intensity:float[0,2]=0.55",
)
def light_leak(rel, p, ctx):
    light = [max(v, 0.0) for v in color.from_oklab_value(color.oklch_value(p["lightness"], p["chroma"], p["hue"]))]
    u, v = f"(x + 0.5 - {num(p['positionX'])} * w)", f"(y + 0.5 - {num(p['positionY'])} * h)"
    r = f"(sqrt({u} * {u} + {v} * {v}) / (sqrt(cast(w * w + h * h as double)) / 2.0))"
    rel = rel.let(fall=f"{num(p['intensity'])} * (1.0 - {smoothstep(num(p['radius']), num(p['radius'] + p['softness']), r)})")
    return done(rel.let(**{c: f"{c} + {num(k)} * fall" for c, k in zip(RGB, light, strict=True)}))


@effect("grain", "preprocess", "seed:seed=0; size:float[1,32]=1.4; intensity:float[0,1]=0.12; tonalResponse:float[0,1]=0.75; monochrome:bool=true")
def grain(rel, p, ctx):
    px, py = (f"(({v} + 0.5) / {num(p['size'])})" for v in "xy")
    names = []
    for c in ["luma"] if p["monochrome"] else list(RGB):

        def draw(rel, cx, cy, c=c):
            rel, h = hashing.chain(rel, cx, cy, str(p["seed"] ^ STREAMS[c]))
            return rel, hashing.unit(rel.d, h)

        rel, v = noise2(rel, px, py, draw)
        rel = rel.let(**{f"n{c}": f"2.0 * {v} - 1.0"})
        names.append(f"n{c}")
    rel = rel.let(tone=clamp(encode(luminance()))).let(amp=f"{num(p['intensity'])} * {mix('1.0', '4.0 * tone * (1.0 - tone)', num(p['tonalResponse']))}")
    return done(rel.let(**{c: decode(f"({encode(c)} + {names[k % len(names)]} * amp)") for k, c in enumerate(RGB)}))


@effect("channel-swap", "postprocess", "; ".join(f"source{c.upper()}:enum{{r/g/b/a}}={c}" for c in "rgba"))
def channel_swap(rel, p, ctx):
    return rel.let(**{c: p[f"source{c.upper()}"] for c in RGB}, a=clamp(p["sourceA"]))


@effect("scanlines", "postprocess", "pitch:float[1,64]=2; phase:float[-1,1]=0; strength:float[0,1]=0.5; thickness:float[0,1]=0.5; softness:float[0,1]=0.25")
def scanlines(rel, p, ctx):
    # a dark line of ``thickness`` of the pitch, centred in it, its edges softened by a share of its half width
    half = p["thickness"] / 2
    edge = max(p["softness"] * half, 1e-3)
    off = f"abs({fract(f'(y / {num(p['pitch'])} + {num(p['phase'])})')} - 0.5)"
    mask = f"(1.0 - {smoothstep(num(half - edge), num(half + edge), off)})"
    rel = rel.let(gain=f"1.0 - {num(p['strength'])} * {mask}")
    return done(rel.let(**{c: f"{c} * gain" for c in RGB}))


@effect(
    "crt-mask",
    "postprocess",
    "geometry:enum{aperture-grille/shadow-mask/slot-mask}=aperture-grille; pitch:float[1,64]=3; aspect:float[0.5,8]=1; duty:float[0.1,1.4]=1; strength:float[0,1]=0.7; softness:float[0,1]=0.3; boost:float[1,3]=1; offsetX:float[-1024,1024]=0; offsetY:float[-1024,1024]=0",
)
def crt_mask(rel, p, ctx):
    pitch = num(p["pitch"])
    rel = rel.let(px=f"x + 0.5 + {num(p['offsetX'])}", py=f"y + 0.5 + {num(p['offsetY'])}")
    if p["geometry"] == "shadow-mask":
        s = p["pitch"] / 3
        row = s * math.sqrt(3) / 2 * p["aspect"]
        radius = p["duty"] * s / 2
        edge = max(p["softness"] * radius, 2**-10)
        rel = rel.let(j0=whole(f"py / {num(row)}"), i0=whole(f"(px - py / {num(row)} * {num(s / 2)}) / {num(s)}"))
        near = {c: [] for c in range(3)}
        for dj in (-1, 0, 1, 2):
            for di in (-1, 0, 1):
                i, j = f"(i0 + {di})", f"(j0 + {dj})"
                u, v = f"(px - ({i} * {num(s)} + {j} * {num(s / 2)}))", f"(py - {j} * {num(row)})"
                name = f"c{dj + 1}{di + 1}"
                rel = rel.let(**{name: f"1.0 - {smoothstep(num(radius - edge), num(radius + edge), f'sqrt({u} * {u} + {v} * {v})')}", f"k{name}": f"(({i} + 2 * {j}) % 3 + 3) % 3"})
                for c in range(3):
                    near[c].append(f"case when k{name} = {c} then {name} else 0.0 end")
        cover = [f"greatest({', '.join(n)})" for n in near.values()]
    else:
        half = p["duty"] / 6
        edge = max(p["softness"] * half, 2**-10)
        tx = fract(f"(px / {pitch})")

        def stripe(k):
            off = f"({tx} - {num((k + 0.5) / 3)})"
            return f"(1.0 - {smoothstep(num(half - edge), num(half + edge), f'abs({off} - {rel.d.rint(off)})')})"

        cover = [stripe(k) for k in range(3)]
        if p["geometry"] == "slot-mask":
            v_half = 0.5 * min(max(p["duty"], 0), 1) * 0.85
            v_edge = max(p["softness"] * v_half, 2**-10)
            odd = f"(({whole(f'px / {pitch}')} % 2 + 2) % 2)"
            ty = fract(f"(py / {num(p['pitch'] * p['aspect'])} + {odd} * 0.5)")
            rel = rel.let(slot=f"1.0 - {smoothstep(num(v_half - v_edge), num(v_half + v_edge), f'abs({ty} - 0.5)')}")
            cover = [f"({c} * slot)" for c in cover]
    return done(rel.let(**{c: f"{c} * {mix(num(1 - p['strength']), '1.0', clamp(k))} * {num(p['boost'])}" for c, k in zip(RGB, cover, strict=True)}))


@effect(
    "bit-crush",
    "postprocess",
    "redBits:int[1,8]=4; greenBits:int[1,8]=4; blueBits:int[1,8]=4; corruptChance:float[0,1]=0; corruptPlane:int[0,7]=0; seed:seed=0",
)
def bit_crush(rel, p, ctx):
    d = rel.d
    rel, h = hashing.nest(rel, "x", "y", str(p["seed"]))
    out = {}
    for k, (c, key) in enumerate(zip(RGB, ("redBits", "greenBits", "blueBits"), strict=True)):
        top = 2 ** p[key] - 1
        rel, draw = hashing.pcg(rel, d.xor(h, k))
        rel = rel.let(**{f"code{c}": f"cast({d.rint(f'{clamp(encode(c))} * {num(top)}')} as bigint)"})
        plane = 2 ** (p[key] - 1 - min(p["corruptPlane"], p[key] - 1))
        code = f"case when {hashing.unit(d, draw)} < {num(p['corruptChance'])} then {d.xor(f'code{c}', plane)} else code{c} end"
        out[c] = decode(f"(({code}) / {num(top)})")
    return done(rel.let(**out))


@effect(
    "noise-burst",
    "postprocess",
    "seed:seed=0; density:float[0,1]=0.15; cellSize:float[1,512]=24; aspect:float[0.05,20]=1; intensity:float[0,1]=1; mode:enum{rgb/mono}=rgb",
)
def noise_burst(rel, p, ctx):
    d = rel.d
    cw, ch = max(p["cellSize"] * p["aspect"], 2**-10), max(p["cellSize"], 2**-10)
    rel, cell = hashing.chain(rel, whole(f"x / {num(cw)}"), whole(f"y / {num(ch)}"), str(p["seed"] ^ CELL_STREAM))
    rel, n = hashing.chain(rel, "x", "y", str(p["seed"] ^ STREAMS["luma"]))
    values = []
    for c in RGB:
        if p["mode"] == "mono":
            values.append(hashing.unit(d, n))
        else:
            rel, k = hashing.pcg(rel, d.xor(n, STREAMS[c]))
            values.append(hashing.unit(d, k))
    hit = f"{hashing.unit(d, cell)} < {num(p['density'])}"
    return done(rel.let(**{c: f"case when {hit} then {mix(c, decode(v), num(p['intensity']))} else {c} end" for c, v in zip(RGB, values, strict=True)}))
