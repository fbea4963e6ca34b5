"""Loops: modulators, bindings, temporal variation, keyframes and the seam report, all over a frame column."""

from __future__ import annotations

import math

from pixelmill.functions.color import clamp, fract
from pixelmill.functions.hashing import MASK
from pixelmill.operators.dithers import Pcg32  # noqa: F401  (named streams live there)
from pixelmill.plans.rel import num, whole

TAU = 2 * math.pi
SHAPES = ("sine", "triangle", "saw", "square", "smooth-noise", "stepped-random")
#: Lattice of smooth noise, steps of stepped random, and how many turns of direction a cycle has; fixed values.
LATTICE, STEPS = 8, 16
FEATURES = {"sine": 2, "triangle": 2, "saw": 1, "square": 2, "smooth-noise": LATTICE, "stepped-random": STEPS}


def mix32(h: int) -> int:
    h = ((h ^ h >> 16) * 0x85EBCA6B) & MASK
    h = ((h ^ h >> 13) * 0xC2B2AE35) & MASK
    return h ^ h >> 16


def fold(*words: int) -> int:
    """FNV-1a over the number of words and each word's bytes, finished by mix32."""
    h = 0x811C9DC5
    for word in (len(words), *words):
        for b in (word & MASK).to_bytes(4, "little"):
            h = ((h ^ b) * 0x01000193) & MASK
    return mix32(h)


def bipolar(*words: int) -> float:
    return fold(*words) / 2**32 * 2 - 1


def shape_sql(d, shape: str, theta: str, seed: int) -> str:
    """A modulator over its phase in [0, 1)."""
    if shape == "sine":
        return f"sin({num(TAU)} * {theta})"
    if shape == "triangle":
        return f"(case when {theta} < 0.25 then 4.0 * {theta} when {theta} < 0.75 then 2.0 - 4.0 * {theta} else 4.0 * {theta} - 4.0 end)"
    if shape == "saw":
        return f"({theta} * 2.0 - 1.0)"
    if shape == "square":
        return f"(case when {theta} < 0.5 then 1.0 else -1.0 end)"
    if shape == "stepped-random":
        return d.at(d.array([num(bipolar(seed, k)) for k in range(STEPS)]), f"least({whole(f'{theta} * {STEPS}')}, {STEPS - 1})")
    table = d.array([num(bipolar(seed, k % LATTICE)) for k in range(LATTICE + 1)])
    at = whole(f"{theta} * {LATTICE}")
    f = f"({theta} * {LATTICE} - {at})"
    a, b = d.at(table, at), d.at(table, f"{at} + 1")
    return f"({a} + ({b} - {a}) * {f} * {f} * (3.0 - 2.0 * {f}))"


def frames(src, n: int):
    return src.ints("frame", n).let(t=f"cast(frame as double) / {num(n)}")


def modulated(src, bindings: list[dict], n: int):
    """(binding, frame, value): base + amount * unit, rounded for integers, in the legal range."""
    out = None
    for k, b in enumerate(bindings):
        rel = frames(src, n).let(theta=fract(f"({b['cycles']} * frame / {num(n)} + {num(b.get('phase', 0.0))})"))
        unit = shape_sql(rel.d, b["shape"], "theta", b.get("seed", 0))
        if not b.get("bipolar", True):
            unit = f"(({unit} + 1.0) / 2.0)"
        value = f"{num(b['base'])} + {num(b['amount'])} * {unit}"
        if b.get("kind") == "int":
            value = f"floor({value} + 0.5)"
        low, high = b["legal"]
        rel = rel.let(binding=f"'{k}'", value=f"{clamp(value, num(low), num(high))} + 0.0").keep("binding", "frame", "value")
        out = rel if out is None else out.union(rel)
    return out


#: Steps of the R2 sequence (1/g and 1/g**2 of the plastic number), of animated gradient noise, and the golden angle
#: in turns; fixed values.
R2 = (0.7548776662466928, 0.5698402909980533)
GRADIENT_ADVANCE = 5.588238
GOLDEN_TURNS = (3 - math.sqrt(5)) / 2


def seed_from_string(text: str) -> int:
    return fold(*map(ord, text))


def temporal(src, mode: str, n: int, **v):
    """(frame, seed, ox, oy, turns): how a dither's pattern varies over the loop.

    hold: frames a step lasts; base: the node's seed; period: cells after which an
    offset repeats; cells: cells a loop on either axis; turns: turns a loop.
    """
    rel = frames(src, n)
    d, hold, period = rel.d, v.get("hold", 1), num(v.get("period", 1))
    step, steps = d.div("frame", hold), -(-n // hold)
    out = {"seed": "cast(null as bigint)", "ox": num(0), "oy": num(0), "turns": num(0)}
    seeds = d.array([fold(v.get("base", 0), seed_from_string(f"temporal:{mode}"), k) for k in range(steps)])

    def wrapped(x):
        return f"({x} - {period} * floor({x} / {period}))"

    if mode in ("per-frame-reseed", "hold-k-frames"):
        out["seed"] = f"cast({d.at(seeds, step)} as bigint)"
    elif mode == "ping-pong":
        out["seed"] = f"cast({d.at(seeds, f'least({step}, {steps} - {step})')} as bigint)"
    elif mode == "blue-noise-cycle":
        out["ox"], out["oy"] = (f"{fract(f'({step} * {num(a)})')} * {period}" for a in R2)
    elif mode == "bayer-offset-scroll":
        out["ox"], out["oy"] = (wrapped(f"({num(c)} * frame / {num(n)})") for c in v["cells"])
    elif mode == "ign-scroll":
        out["ox"] = out["oy"] = wrapped(f"(frame * {num(GRADIENT_ADVANCE)})")
    elif mode == "bayer-rotation":
        out["turns"] = fract(f"({num(v['turns'])} * frame / {num(n)})")
    elif mode == "golden-ratio-rotation":
        out["turns"] = fract(f"(frame * {num(GOLDEN_TURNS)})")
    return rel.let(**out).keep("frame", "seed", "ox", "oy", "turns")


#: easing -> expression of the unit time u.
EASINGS = {
    "linear": "u",
    "ease-in": "u * u",
    "ease-out": "1.0 - (1.0 - u) * (1.0 - u)",
    "ease-in-out": "case when u < 0.5 then 4.0 * u * u * u else 1.0 - pow(2.0 - 2.0 * u, 3) / 2.0 end",
    "hold": "0.0",
}


def keyframed(src, keys: list[tuple[int, float, str]], n: int):
    """(frame, value): an as-of join, the last key at or before a frame and the next one, wrapping round the loop.

    Keys are copied a loop earlier and later, so that every frame has both; frames and
    keys share one sorted sequence, in which windows carry the latest key forwards and
    the next one backwards.
    """
    rows = [(f + lap * n, v, e) for f, v, e in keys for lap in (-1, 0, 1)]
    table = src.values(["frame", "value", "easing"], rows).let(is_key="1")
    wanted = src.ints("frame", n).let(value="cast(null as double)", easing="cast(null as string)" if src.d.spark else "cast(null as varchar)", is_key="0")
    both = table.keep("frame", "value", "easing", "is_key").union(wanted.keep("frame", "value", "easing", "is_key"))
    both = both.let(kf="case when is_key = 1 then frame end")
    ignore = (lambda f, c: f"{f}({c}, true)") if src.d.spark else (lambda f, c: f"{f}({c} ignore nulls)")
    back = "over (order by frame, is_key desc rows between unbounded preceding and current row)"
    ahead = "over (order by frame desc, is_key desc rows between unbounded preceding and 1 preceding)"
    last = "last" if src.d.spark else "last_value"
    both = both.let(
        f0=f"{ignore(last, 'kf')} {back}", v0=f"{ignore(last, 'value')} {back}", e0=f"{ignore(last, 'easing')} {back}",
        f1=f"{ignore(last, 'kf')} {ahead}", v1=f"{ignore(last, 'value')} {ahead}",
    )
    both = both.where("is_key = 0").let(u="cast(frame - f0 as double) / nullif(f1 - f0, 0)")
    ease = "case e0 " + " ".join(f"when '{k}' then {v}" for k, v in EASINGS.items()) + " end"
    return both.let(value=f"v0 + (v1 - v0) * ({ease}) + 0.0").keep("frame", "value")


def seam_report(bindings: list[dict], n: int) -> list[tuple[int, str, str]]:
    """(binding, code, severity) of everything that breaks or blurs the loop."""
    out = []
    for k, b in enumerate(bindings):
        if b["cycles"] != int(b["cycles"]):
            out.append((k, "phase-drift", "error"))
        if FEATURES[b["shape"]] * b["cycles"] > n / 2:
            out.append((k, "undersampled", "warning"))
        low, high = b["legal"]
        least = b["base"] - abs(b["amount"]) if b.get("bipolar", True) else min(b["base"], b["base"] + b["amount"])
        most = b["base"] + abs(b["amount"]) if b.get("bipolar", True) else max(b["base"], b["base"] + b["amount"])
        if least < low or most > high:
            out.append((k, "clipped", "warning"))
    return out


def binding_problems(bindings, nodes, params):
    """``bindings`` (nth, node, param, amount) with the first reason why one cannot be bound; null if it can.

    nodes: (node, effect). params: (effect, param, kind) of all effects. A parameter is bound once, by the first binding
    that names it. Only floats and integers swing; names, switches and seeds do not.
    """
    effects = params.group(["effect"], known="1")
    out = bindings.let(turn="row_number() over (partition by node, param order by nth)")
    out = out.join(nodes, ["node"], "left").join(effects, ["effect"], "left").join(params, ["effect", "param"], "left")
    problem = """case when effect is null then 'unknown-node' when known is null then 'unknown-effect'
        when kind is null then 'unknown-parameter' when kind not in ('float', 'int') then 'parameter-not-animatable'
        when turn > 1 then 'duplicate-binding' when amount is null or isnan(amount) or abs(amount) > 1.7e308 then 'non-finite-value' end"""
    return out.let(problem=problem).keep("nth", "node", "param", "problem")
