"""Effects that read other pixels: weighted gathers, filters, resampling, displacement.

``gather`` is the one place where pixels meet: every output pixel lists its taps (a
source coordinate and weights), which are looked up and summed by pixel. Taps at computed places are
exploded, equi-joined to the source on (image, x, y) and summed. Where they lie at fixed places, the
source travels on Spark in squares of TILE x TILE pixels, and an output pixel as one row for
each square its taps fall in; taps are exploded only after that equi-join on (image,
square), so their number multiplies no shuffle. Sums are made before the second
shuffle; no image has to fit in one task.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from pixelmill.functions import color, hashing
from pixelmill.functions.color import RGB, clamp, decode_value, fract, luminance, mix
from pixelmill.operators.dithers import lightest_darkest
from pixelmill.operators.palettes import paint
from pixelmill.operators.pointwise import TAU, done
from pixelmill.operators.registry import effect
from pixelmill.plans.rel import SparkRel, num, whole
from pixelmill.sources.rasters import COLOUR, PIXEL


def edge(v: str, n: str, mode: str) -> str:
    """A coordinate brought back into 0 .. n - 1."""
    if mode == "wrap":
        return f"((({v}) % {n} + {n}) % {n})"
    if mode == "mirror":
        m = f"((({v}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
        return f"(case when {m} < {n} then {m} else 2 * {n} - 1 - {m} end)"
    return f"least(greatest({v}, 0), {n} - 1)"


def key(v: str) -> str:
    """A join key that is never null: else the optimiser's null check would repeat its whole formula in a filter."""
    return f"coalesce(cast({v} as bigint), -1)"


def keys(rel) -> list[str]:
    return [c for c in ("image_id", "frame", "x", "y", "w", "h") if c in rel.columns]


def place(rel) -> list[str]:
    return [c for c in ("image_id", "frame", "x", "y") if c in rel.columns]


def image(rel) -> list[str]:
    return [c for c in ("image_id", "frame") if c in rel.columns]


def source_of(rel, columns):
    """The raster as the looked-up side: sx, sy and columns under the name s_..."""
    return rel.let(sx="x", sy="y", **{f"s_{c}": c for c in columns}).keep(*image(rel), "sx", "sy", *[f"s_{c}" for c in columns])


def lookup(rel, src, x: str, y: str, columns=COLOUR, how="inner"):
    """One tap: columns s_... of the pixel at (x, y); with how="left" null where there is none."""
    rel = rel.let(sx=key(x), sy=key(y))
    return rel.join(source_of(src, columns), [*image(rel), "sx", "sy"], how).drop("sx", "sy")


def gather(rel, src, taps, out, carry=(), columns=COLOUR):
    """taps: (x, y, weights by name); out: name -> expression over the taps' s_ columns and w_ weights.

    Returns the pixel's key, its ``carry`` columns and the sums; taps off the image add nothing.
    """
    names = list(taps[0][2])

    def by_tap(values):
        values = list(values)
        if len(set(map(str, values))) == 1:
            return values[0]
        return "(case tap " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end)"

    sums = {k: f"coalesce(sum({v}), 0.0)" for k, v in out.items()}
    kept = {c: f"max({c})" for c in carry}
    used = {c for c in rel.columns if any(re.search(rf"\b{c}\b", str(e)) for t in taps for e in (t[0], t[1], *t[2].values()))}
    # taps at fixed places around a pixel; places that are computed have formulas too long to be compiled in one piece
    if rel.d.spark and used <= set(keys(rel)):
        rel = rel.keep(*dict.fromkeys([*keys(rel), *carry]))
        cells = ", ".join(f"struct({cell(key(t[0]))} as tx, {cell(key(t[1]))} as ty)" for t in taps)
        near = rel.explode("cell", f"array_distinct(array({cells}))").let(tx="cell.tx", ty="cell.ty").drop("cell")
        met = near.join(tiles(src, columns), [*image(rel), "tx", "ty"], "left")
        own = ", ".join("struct(" + ", ".join([f"{key(t[0])} as sx", f"{key(t[1])} as sy", *[f"cast({t[2][n]} as double) as w_{n}" for n in names]]) + ")" for t in taps)
        met = met.let(taps=f"array({own})")  # made once a row, so that what follows stays small enough to be compiled
        wide = SparkRel(met.df.select("*", F.expr("inline(taps)"))).drop("taps").where(f"{cell('sx')} = tx and {cell('sy')} = ty")
        found = SparkRel(wide.df.select("*", F.expr(f"inline_outer(get(pixels, {PLACE}))"))).drop("pixels")
        found = found.let(**{f"s_{c}": f"case when own = struct(sx, sy) then s_{c} end" for c in columns})
        return found.group(keys(rel), **kept, **sums)
    wide = rel.explode("tap", rel.d.ints(0, len(taps) - 1))
    wide = wide.let(
        sx=key(by_tap(t[0] for t in taps)),
        sy=key(by_tap(t[1] for t in taps)),
        **{f"w_{n}": f"cast({by_tap(t[2][n] for t in taps)} as double)" for n in names},
    )
    joined = wide.join(source_of(src, columns), [*image(rel), "sx", "sy"], "left")
    return joined.group(keys(rel), **kept, **sums)


#: Side of the squares of pixels that travel as one row.
TILE = 8
#: The place of (sx, sy) in its square.
PLACE = f"cast((sx % {TILE} + {TILE}) % {TILE} + (sy % {TILE} + {TILE}) % {TILE} * {TILE} as int)"


def cell(v: str) -> str:
    return f"(({v}) div {TILE})"


def tiles(src, columns):
    """(image, tx, ty, pixels): the raster in squares; pixels has for each place of a square the list of what stands there."""
    src = source_of(src, columns).let(tx=cell("sx"), ty=cell("sy"), at=PLACE)
    at = image(src)
    items = ", ".join(["struct(sx, sy) as own", *[f"s_{c}" for c in columns]])
    src = src.group([*at, "tx", "ty"], found=f"array_sort(collect_list(struct(at, struct({items}) as pixel)))")
    # sorted by place: where every place has one pixel, the place is the index
    full = f"size(found) = {TILE * TILE} and aggregate(found, 0, (k, p) -> if(p.at = k, k + 1, -1)) = {TILE * TILE}"
    pixels = f"case when {full} then transform(found, p -> array(p.pixel)) else transform(sequence(0, {TILE * TILE - 1}), k -> transform(filter(found, p -> p.at = k), p -> p.pixel)) end"
    return src.let(pixels=pixels).keep(*at, "tx", "ty", "pixels")


def bilinear(rel, px: str, py: str, mode: str, prefix=""):
    """Adds base and fraction columns; returns (rel, four taps with weight ``w``). ``off`` keeps taps off the image out."""
    b = prefix
    rel = rel.let(**{f"{b}ix": whole(f"({px}) - 0.5"), f"{b}iy": whole(f"({py}) - 0.5"), f"{b}fx": fract(f"(({px}) - 0.5)"), f"{b}fy": fract(f"(({py}) - 0.5)")})
    taps = []
    for dy in (0, 1):
        for dx in (0, 1):
            wx, wy = (f"{b}fx" if dx else f"(1.0 - {b}fx)"), (f"{b}fy" if dy else f"(1.0 - {b}fy)")
            x, y = f"{b}ix + {dx}", f"{b}iy + {dy}"
            taps.append((x if mode == "off" else edge(x, "w", mode), y if mode == "off" else edge(y, "h", mode), f"{wx} * {wy}"))
    return rel, taps


def sample(rel, px, py, mode, smooth=True):
    """Every colour channel read at a point of the plane."""
    if not smooth:
        found = lookup(rel, rel, edge(whole(px), "w", mode), edge(whole(py), "h", mode))
        return done(found.let(**{c: f"s_{c}" for c in COLOUR}))
    src = rel
    rel, taps = bilinear(rel, px, py, mode)
    return done(gather(rel, src, [(x, y, {"k": w}) for x, y, w in taps], {c: f"w_k * s_{c}" for c in COLOUR}))


# ------------------------------------------------------------- displacement


@effect(
    "rgb-split",
    "postprocess",
    "redX:float[-0.25,0.25]=0.006; redY:float[-0.25,0.25]=0; greenX:float[-0.25,0.25]=0; greenY:float[-0.25,0.25]=0; blueX:float[-0.25,0.25]=-0.006; blueY:float[-0.25,0.25]=0; jitter:float[0,0.25]=0; edge:enum{clamp/wrap/mirror}=clamp; seed:seed=0",
    access="neighbourhood",
)
def rgb_split(rel, p, ctx):
    src, taps = rel, []
    #: Salts of the channels' wobble; fixed values.
    for c, name, salt in (("r", "red", 0x9E3779B9), ("g", "green", 0x85EBCA6B), ("b", "blue", 0xC2B2AE35)):
        rel, h = hashing.multiplied(rel, str(p["seed"] ^ salt), "y")
        px = f"(x + 0.5 - ({num(p[f'{name}X'])} + ({hashing.unit(rel.d, h)} * 2.0 - 1.0) * {num(p['jitter'])}) * w)"
        rel, own = bilinear(rel, px, f"(y + 0.5 - {num(p[f'{name}Y'])} * h)", p["edge"], f"{c}_")
        taps += [(x, y, {k: w if k == c else "0.0" for k in RGB}) for x, y, w in own]
    return done(gather(rel, src, taps, {c: f"w_{c} * s_{c}" for c in RGB}, carry=["a"], columns=RGB))


@effect(
    "chromatic-aberration",
    "postprocess",
    "mode:enum{radial/linear}=radial; strength:float[0,0.2]=0.008; angle:float[-1,1]=0; centerX:float[0,1]=0.5; centerY:float[0,1]=0.5; falloff:float[0.25,4]=2; jitter:float[0,0.25]=0; edge:enum{clamp/mirror/wrap}=clamp; seed:seed=0",
    access="neighbourhood",
)
def chromatic_aberration(rel, p, ctx):
    src = rel
    rel, h = hashing.multiplied(rel, str(p["seed"]), "y")
    if p["mode"] == "linear":
        dx, dy = (f"{num(f(TAU * p['angle']) * p['strength'])} * w" for f in (math.cos, math.sin))
    else:
        rel = rel.let(ux=f"x + 0.5 - {num(p['centerX'])} * w", uy=f"y + 0.5 - {num(p['centerY'])} * h", half="0.5 * sqrt(cast(w * w + h * h as double))")
        rel = rel.let(len="sqrt(ux * ux + uy * uy)")
        pull = f"(case when len > 1e-5 then {num(p['strength'])} * half * pow({clamp('len / half')}, {num(p['falloff'])}) / len else 0.0 end)"
        dx, dy = f"ux * {pull}", f"uy * {pull}"
    rel = rel.let(mx=f"{dx} + ({hashing.unit(rel.d, h)} * 2.0 - 1.0) * {num(p['jitter'])} * w", my=dy)
    rel, red = bilinear(rel, "(x + 0.5 - mx)", "(y + 0.5 - my)", p["edge"], "r_")
    rel, blue = bilinear(rel, "(x + 0.5 + mx)", "(y + 0.5 + my)", p["edge"], "b_")
    taps = [(x, y, {"r": w, "b": "0.0"}) for x, y, w in red] + [(x, y, {"r": "0.0", "b": w}) for x, y, w in blue]
    return done(gather(rel, src, taps, {"r": "w_r * s_r", "b": "w_b * s_b"}, carry=["g", "a"], columns=RGB))


@effect(
    "wave-warp",
    "postprocess",
    "amplitude:float[0,512]=12; frequency:float[0,64]=3; phase:float[-1,1]=0; waveform:enum{sine/triangle}=sine; axis:enum{horizontal/vertical/both}=horizontal; edges:enum{mirror/wrap/clamp}=mirror; smoothing:bool=true",
    access="neighbourhood",
)
def wave_warp(rel, p, ctx):
    def shift(across, n, on):
        if p["axis"] not in (on, "both"):
            return "0.0"
        turns = f"(({across} + 0.5) / {n} * {num(p['frequency'])} + {num(p['phase'])})"
        wave = f"sin({fract(turns)} * {num(TAU)})" if p["waveform"] == "sine" else f"(1.0 - 4.0 * abs({fract(f'({turns} + 0.25)')} - 0.5))"
        return f"{num(p['amplitude'])} * {wave}"

    rel = rel.let(px=f"x + 0.5 - {shift('y', 'h', 'horizontal')}", py=f"y + 0.5 - {shift('x', 'w', 'vertical')}")
    return sample(rel, "px", "py", p["edges"], p["smoothing"])


@effect(
    "lens-distortion",
    "preprocess",
    "amount:float[-0.9,0.9]=-0.3; scale:float[0.25,4]=1; edge:enum{clamp/black/transparent}=clamp; sampling:enum{bilinear/nearest}=bilinear",
    access="neighbourhood",
)
def lens_distortion(rel, p, ctx):
    rel = rel.let(ux="x + 0.5 - w / 2.0", uy="y + 0.5 - h / 2.0", half2="(w * w + h * h) / 4.0")
    rel = rel.let(k=f"(1.0 + {num(p['amount'])} * (ux * ux + uy * uy) / half2) / {num(max(p['scale'], 2**-10))}").let(px="w / 2.0 + ux * k", py="h / 2.0 + uy * k")
    places = rel.keep(*keys(rel), "px", "py")
    out = sample(rel, "px", "py", "clamp", p["sampling"] == "bilinear")
    if p["edge"] == "clamp":
        return out
    out = out.join(places, keys(out)).let(off="px < 0.0 or px >= w or py < 0.0 or py >= h")
    alpha = "0.0" if p["edge"] == "transparent" else "1.0"
    return done(out.let(**{c: f"case when off then 0.0 else {c} end" for c in RGB}, a=f"case when off then {alpha} else a end"))


@effect("interlace-tear", "postprocess", "fieldHeight:int[1,256]=1; offset:float[-256,256]=6; phase:float[-1,1]=0; wrap:bool=true", access="neighbourhood")
def interlace_tear(rel, p, ctx):
    n = p["fieldHeight"]
    field_ = whole(f"(y + {num(p['phase'] * 2 * n)}) / {num(n)}")
    shift = round(p["offset"])  # to even, as rint; the other field moves by as much the other way
    sx = f"(x - (case when (({field_} % 2) + 2) % 2 = 0 then {shift} else {-shift} end))"
    found = lookup(rel, rel, edge(sx, "w", "wrap" if p["wrap"] else "clamp"), "y")
    return done(found.let(**{c: f"s_{c}" for c in COLOUR}))


@effect("ghost-echo", "postprocess", "copies:int[1,16]=3; offsetX:float[-256,256]=8; offsetY:float[-256,256]=0; decay:float[0,1]=0.6; mode:enum{average/add}=average", access="neighbourhood")
def ghost_echo(rel, p, ctx):
    taps = [(f"x - ({round(p['offsetX'] * k)})", f"y - ({round(p['offsetY'] * k)})", {"k": num(p["decay"] ** k)}) for k in range(p["copies"] + 1)]
    rel = gather(rel, rel, taps, {c: f"w_k * s_{c}" for c in COLOUR} | {"total": "case when s_a is not null then w_k else 0.0 end"})
    if p["mode"] == "average":
        rel = rel.let(**{c: f"{c} / total" for c in COLOUR})
    return done(rel.let(a=clamp("a")))


#: Salts of a slice's draws; fixed values.
ACTIVE, OFFSET = 0x5BD1E995, 0x27D4EB2F


def slices(rel, across: str, extent: str, p: dict, low_share: float, high_share: float):
    """(extent, line, moved, draw): the seeded slices of every side that occurs, a row for each of their lines.

    A slice's height is drawn between two shares of the side; slices stand one after
    the other, so each begins at the running sum of those before it.
    """
    d, seed = rel.d, p["seed"]
    a, b = min(low_share, high_share), max(low_share, high_share)
    rel = rel.group([extent], images="count(*)")
    rel = rel.let(low=f"greatest(1, cast({d.rint(f'{num(a)} * {extent}')} as bigint))")
    rel = rel.let(high=f"greatest(low, cast({d.rint(f'{num(b)} * {extent}')} as bigint))")
    rel = rel.explode("k", d.ints(0, d.div(extent, "low"))).let(k="cast(k as bigint)")
    rel, h = hashing.multiplied(rel, str(seed), "k")
    rel = rel.let(size=f"least(low + {whole(f'{hashing.unit(d, h)} * (high - low + 1)')}, high)")
    rel = rel.let(stop=f"sum(size) over (partition by {extent} order by k rows between unbounded preceding and current row)")
    rel = rel.let(begin="cast(stop - size as bigint)").where(f"begin < {extent}")
    rel, active = hashing.multiplied(rel, str(seed ^ ACTIVE), "k")
    rel, draw = hashing.multiplied(rel, str(seed ^ OFFSET), "k")
    rel = rel.let(moved=f"case when {hashing.unit(d, active)} < {num(p['probability'])} then 1 else 0 end", draw=f"{hashing.unit(d, draw)} * 2.0 - 1.0")
    rel = rel.explode(across, d.ints("begin", f"least(begin + size, {extent}) - 1"))
    return rel.let(**{across: f"cast({across} as bigint)"}).keep(extent, across, "moved", "draw")


def _displacement(across, along, n_across, n_along, keys_):
    def run(rel, p, ctx):
        """Slice tables have a row for each line of each side that occurs, and are joined by equality."""
        src = rel
        rel = rel.join(slices(rel, across, n_across, p, p[keys_[0]], p[keys_[1]]), [n_across, across])
        shift = f"(case when moved = 1 then cast({rel.d.rint(f'draw * {num(p['offsetRange'])} * {n_along}')} as bigint) else 0 end)"
        where = edge(f"{along} - {shift}", n_along, p["edge"])
        found = lookup(rel, src, where if along == "x" else "x", where if along == "y" else "y")
        return done(found.let(**{c: f"s_{c}" for c in COLOUR}))

    return run


for _id, _a, _key in (("row-displacement", ("y", "x", "h", "w"), "Height"), ("column-displacement", ("x", "y", "w", "h"), "Width")):
    effect(
        _id,
        "postprocess",
        f"minSlice{_key}:float[0.002,0.5]=0.008; maxSlice{_key}:float[0.002,0.5]=0.05; offsetRange:float[0,1]=0.06; probability:float[0,1]=0.35; edge:enum{{wrap/clamp/mirror}}=wrap; seed:seed=0",
        access="neighbourhood",
    )(_displacement(*_a, (f"minSlice{_key}", f"maxSlice{_key}")))


@effect(
    "slice-repeat",
    "postprocess",
    "axis:enum{horizontal/vertical}=horizontal; sliceSize:float[1,512]=24; sizeJitter:float[0,1]=0.5; probability:float[0,1]=0.35; repeats:int[1,16]=4; offsetRange:float[0,2048]=96; seed:seed=0",
    access="neighbourhood",
)
def slice_repeat(rel, p, ctx):
    d, src = rel.d, rel
    along, n = ("y", "h") if p["axis"] == "horizontal" else ("x", "w")
    size = num(max(p["sliceSize"], 1))

    def boundary(rel, slot, name):
        rel, h = hashing.nest(rel, hashing.u32(slot), str(p["seed"]))
        return rel.let(**{name: f"({slot}) * {size} + ({hashing.unit(d, h)} - 0.5) * {num(p['sizeJitter'])} * {size}"})

    rel = rel.let(u=f"{along} + 0.5").let(s0=whole(f"u / {size}"))
    rel = boundary(boundary(rel, "s0 + 1", "up"), "s0", "here")
    rel = rel.let(slot="case when up <= u then s0 + 1 when here <= u then s0 else s0 - 1 end")
    rel = boundary(boundary(rel, "slot", "top"), "slot + 1", "bottom").let(thick="greatest(bottom - top, 1.0)")
    #: Salts of a band's draws; fixed values.
    rel, band = hashing.nest(rel, hashing.u32("slot"), str(p["seed"]), str(0x2545F491))
    rel, count = hashing.pcg(rel, band)
    rel, reach = hashing.pcg(rel, d.xor(band, 0x27D4EB2F))
    rel = rel.let(strip=f"thick / (1 + {count} % {p['repeats']})", reach=f"({hashing.unit(d, reach)} * 2.0 - 1.0) * {num(p['offsetRange'])}")
    at = whole("top + reach + (u - top) - floor((u - top) / strip) * strip")
    rel = rel.let(moved=f"case when {hashing.unit(d, band)} < {num(p['probability'])} then {edge(at, n, 'wrap')} else {along} end")
    found = lookup(rel, src, "x" if along == "y" else "moved", "moved" if along == "y" else "y")
    return done(found.let(**{c: f"s_{c}" for c in COLOUR}))


def block_permutation(columns: int, rows: int, chance: float, seed: int) -> list[int]:
    """For each block the block it shows: partners in a Feistel order swap with a chance."""
    n = columns * rows
    half = 1
    while half < 16 and 4**half < n:
        half += 1
    mask = 2**half - 1
    round_keys = [hashing.pcg_value((seed ^ hashing.pcg_value((i + 0x9E3779B9) & hashing.MASK)) & hashing.MASK) for i in range(4)]

    def once(v):
        left, right = v >> half, v & mask
        for k in round_keys:
            left, right = right, left ^ (hashing.pcg_value(right ^ k) & mask)
        return left << half | right

    rank = []
    for block in range(n):
        v = once(block)
        while v >= n:
            v = once(v)
        rank.append(v)
    block_at = {r: b for b, r in enumerate(rank)}
    out = []
    for block, r in enumerate(rank):
        draw = hashing.unit_value(hashing.nest_value(r >> 1, seed ^ 0x51ED270B))
        out.append(block_at[r ^ 1] if (r ^ 1) < n and draw < chance else block)
    return out


@effect("block-shuffle", "postprocess", "columns:int[1,256]=16; rows:int[1,256]=16; swapProbability:float[0,1]=0.5; seed:seed=0", access="neighbourhood")
def block_shuffle(rel, p, ctx):
    d, src, c, r = rel.d, rel, p["columns"], p["rows"]
    table = ctx.src.values(["block", "shown"], list(enumerate(block_permutation(c, r, p["swapProbability"], p["seed"]))))  # at most 65 536 rows
    rel = rel.let(bx=d.div(f"x * {c} + {c - 1}", "w"), bz=d.div(f"y * {r} + {r - 1}", "h")).let(block=f"bz * {c} + bx").join(table, ["block"])
    rel = rel.let(tx=f"shown % {c}", ty=d.div("shown", c))

    def place(v, n, b, t, count):
        start = d.div(f"{t} * {n}", count)
        size = f"greatest({d.div(f'({t} + 1) * {n}', count)} - {start}, 1)"
        return f"least({start} + least({v} - {d.div(f'{b} * {n}', count)}, {size} - 1), {n} - 1)"

    found = lookup(rel, src, place("x", "w", "bx", "tx", c), place("y", "h", "bz", "ty", r))
    return done(found.let(**{k: f"s_{k}" for k in COLOUR}))


@effect(
    "datamosh-smear",
    "postprocess",
    "angle:float[-1,1]=0; dragLength:float[0,128]=24; threshold:float[0,1]=0.5; source:enum{bright/dark}=bright; decay:float[0,1]=1; jitter:float[0,1]=0; seed:seed=0",
    access="neighbourhood",
)
def datamosh_smear(rel, p, ctx):
    """A pixel below the threshold takes the first pixel above it on the way back, if it lies within reach."""
    level = decode_value(p["threshold"])
    op = ">=" if p["source"] == "bright" else "<="
    src = rel.let(lit=f"case when {luminance()} {op} {num(level)} then 1 else 0 end")
    dx, dy = math.cos(TAU * p["angle"]), math.sin(TAU * p["angle"])
    rel = src.let(trail=whole(f"{num(-dy)} * (x + 0.5) + {num(dx)} * (y + 0.5)"))
    rel, a = hashing.lowbias(rel, "trail")
    rel, draw = hashing.lowbias(rel, rel.d.xor(a, (p["seed"] * 0x9E3779B9) & hashing.MASK))
    rel = rel.let(steps=f"least({whole(f'greatest({num(p['dragLength'])} * (1.0 - {num(p['jitter'])} * ({draw} / 4294967296.0)), 0.0)')}, 128)")
    walk = rel.where("lit = 0 and steps > 0").keep(*keys(rel), "steps").explode("k", rel.d.ints(1, "steps"))
    back = walk.let(sx=key(whole(f"x + 0.5 - {num(dx)} * k")), sy=key(whole(f"y + 0.5 - {num(dy)} * k")))
    lit = back.join(source_of(src.where("lit = 1"), RGB), [*image(rel), "sx", "sy"])
    first = lit.let(n=f"row_number() over (partition by {', '.join(place(rel))} order by k)").where("n = 1").let(k="cast(k as bigint)").keep(*keys(rel), "k", *[f"s_{c}" for c in RGB])
    out = rel.keep(*keys(rel), *COLOUR).join(first, keys(rel), "left")
    decay = num(max(p["decay"], 1e-6))
    return done(out.let(**{c: f"case when k is null then {c} else {mix(c, f's_{c}', f'pow({decay}, k - 1)')} end" for c in RGB}))


# ------------------------------------------------------------------- filters


def gaussian(rel, radius: float, columns, axes=("x", "y")):
    """Normalised separable blur with clamped edges: one gather an axis."""
    taps = min(math.ceil(radius), 64)
    sigma = max(radius, 1e-3) / 3
    weights = [math.exp(-0.5 * i * i / sigma**2) for i in range(-taps, taps + 1)]
    total = sum(weights)
    if taps == 0:
        return rel
    carry = [c for c in rel.columns if c not in {*keys(rel), *columns}]
    for axis in axes:
        n = "w" if axis == "x" else "h"
        spots = [edge(f"{axis} + ({i})", n, "clamp") for i in range(-taps, taps + 1)]
        t = [(s if axis == "x" else "x", s if axis == "y" else "y", {"k": num(k / total)}) for s, k in zip(spots, weights, strict=True)]
        rel = gather(rel, rel, t, {c: f"w_k * s_{c}" for c in columns}, carry, columns)
    return rel


def premultiplied(rel, names=("pr", "pg", "pb", "pa")):
    return rel.let(**{n: f"{c} * a" for n, c in zip(names, RGB, strict=False)}, pa="a")


@effect("blur", "preprocess", "radius:float[0,64]=4", access="neighbourhood")
def blur(rel, p, ctx):
    rel = gaussian(premultiplied(rel).drop(*COLOUR), p["radius"], ["pr", "pg", "pb", "pa"])
    return done(rel.let(**{c: f"case when pa > 1e-5 then p{c} / pa else 0.0 end" for c in RGB}, a="pa"))


@effect("sharpen", "preprocess", "amount:float[0,4]=1; radius:float[0,32]=2; threshold:float[0,1]=0", access="neighbourhood")
def sharpen(rel, p, ctx):
    rel = gaussian(premultiplied(rel), p["radius"], ["pr", "pg", "pb", "pa"])
    rel = rel.let(**{f"soft{c}": f"case when pa > 1e-5 then p{c} / pa else 0.0 end" for c in RGB})
    delta = f"abs({color.lightness()} - {color.lightness('softr', 'softg', 'softb')})"
    rel = rel.let(gate=clamp(f"({delta} - {num(p['threshold'])}) / {num(max(p['threshold'], 1e-6))}"))
    return done(rel.let(**{c: clamp(f"{c} + {num(p['amount'])} * gate * ({c} - soft{c})") for c in RGB}))


@effect("epsilon-glow", "postprocess", "threshold:float[0,0.95]=0.55; radius:float[0,64]=10; intensity:float[0,4]=1; blend:enum{additive/screen}=additive", access="neighbourhood")
def epsilon_glow(rel, p, ctx):
    knee = clamp(f"({color.lightness()} - {num(p['threshold'])}) / {num(max(1 - p['threshold'], 1e-4))}")
    rel = rel.let(knee=knee).let(**{f"g{c}": f"{c} * a * knee" for c in RGB}).drop("knee")
    rel = gaussian(rel, p["radius"], ["gr", "gg", "gb"])

    def lit(c):
        glow, base = f"greatest(g{c} * {num(p['intensity'])}, 0.0)", clamp(c)
        return clamp(f"{base} + {glow}" if p["blend"] == "additive" else f"1.0 - (1.0 - {base}) * (1.0 - {clamp(glow)})")

    return done(rel.let(**{c: lit(c) for c in RGB}))


@effect("edge-detect", "preprocess", "operator:enum{sobel/laplacian}=sobel; strength:float[0,8]=1; mix:float[0,1]=1", access="neighbourhood")
def edge_detect(rel, p, ctx):
    src = rel.let(v=color.lightness())
    sobel = p["operator"] == "sobel"
    taps = []
    for j in (-1, 0, 1):
        for i in (-1, 0, 1):
            wx, wy = i * (2 - abs(j)), j * (2 - abs(i))
            lap = -4 if (i, j) == (0, 0) else 1 if abs(i) + abs(j) == 1 else 0
            taps.append((edge(f"x + ({i})", "w", "clamp"), edge(f"y + ({j})", "h", "clamp"), {"p": num(wx if sobel else lap), "q": num(wy if sobel else 0)}))
    rel = gather(rel, src, taps, {"gx": "w_p * s_v", "gy": "w_q * s_v"}, carry=COLOUR, columns=["v"])
    response = "sqrt(gx * gx + gy * gy) / 4.0" if sobel else "abs(gx)"
    rel = rel.let(edge=clamp(f"({response}) * {num(p['strength'])}"))
    return done(rel.let(**{c: mix(c, "pow(edge, 3)", num(p["mix"])) for c in RGB}))


@effect("emboss", "preprocess", "angle:float[0,1]=0.375; depth:float[0,8]=1.5", access="neighbourhood")
def emboss(rel, p, ctx):
    src = rel
    dx, dy = math.cos(TAU * p["angle"]), -math.sin(TAU * p["angle"])
    taps = []
    for sign, side in ((1, "t"), (-1, "u")):
        rel, own = bilinear(rel, f"(x + 0.5 + ({sign * dx!r}))", f"(y + 0.5 + ({sign * dy!r}))", "clamp", side)
        taps += [(x, y, {"t": w if side == "t" else "0.0", "u": w if side == "u" else "0.0"}) for x, y, w in own]
    sums = {f"{side}{c}": f"w_{side} * s_{c}" for side in "tu" for c in RGB}
    rel = gather(rel, src, taps, sums, carry=["a"], columns=RGB)
    lit = clamp(f"0.5 + {num(p['depth'])} * ({color.lightness('tr', 'tg', 'tb')} - {color.lightness('ur', 'ug', 'ub')})")
    return done(rel.let(lit=lit).let(**dict.fromkeys(RGB, "pow(lit, 3)")))


# ----------------------------------------------------------------- resampling


@effect("internal-resolution", "preprocess", "factor:int[1,16]=2; filter:enum{nearest/box/lanczos}=box", access="neighbourhood", resamples=True)
def internal_resolution(rel, p, ctx):
    """Smaller by a whole factor, x then y; alpha weighs colours."""
    f = p["factor"]
    for v, n in (("x", "w"), ("y", "h")):
        rel = _reduce(rel, v, n, f, p["filter"])
    return done(rel)


def _reduce(rel, v, n, f, kind):
    d = rel.d
    size = d.div(f"{n} + {f - 1}", f)
    if kind == "nearest":
        kept = rel.let(**{f"o_{v}": d.div(v, f), "hit": f"least({d.div(v, f)} * {f} + {f // 2}, {n} - 1)"}).where(f"{v} = hit")
        return kept.let(**{v: f"o_{v}", n: size}).drop(f"o_{v}", "hit")
    if kind == "box":
        wide = rel.let(o=d.div(v, f), k=num(1))
    else:
        # each pixel adds to all output pixels whose centre lies within three of it
        low, high = f"greatest(cast(ceil(({v} + 0.5) / {f}.0 - 3.5) as bigint), 0)", f"least({whole(f'({v} + 0.5) / {f}.0 + 2.5')}, {size} - 1)"
        wide = rel.explode("o", d.ints(low, high)).let(t=f"abs(({v} + 0.5) / {f}.0 - o - 0.5)")
        wave = f"3.0 * sin({math.pi!r} * t) * sin({math.pi!r} * t / 3.0) / nullif({math.pi**2!r} * t * t, 0.0)"
        wide = wide.let(k=f"case when t < 1e-6 then 1.0 when t >= 3.0 then 0.0 else {wave} end", o="cast(o as bigint)")
    wide = wide.let(**{n: size})
    other = [c for c in keys(rel) if c != v]
    sums = {f"p{c}": f"sum(k * {c} * a)" for c in RGB} | {"pa": "sum(k * a)", "total": "sum(k)"}
    out = wide.group([*other, "o"], **sums).let(**{v: "o"})
    out = out.let(**{c: f"case when pa > 1e-6 then greatest(p{c} / pa, 0.0) else 0.0 end" for c in RGB}, a=clamp("pa / greatest(total, 1e-6)"))
    return out.keep(*PIXEL, *COLOUR) if "frame" not in rel.columns else out.keep("frame", *PIXEL, *COLOUR)


@effect("nn-upscale", "postprocess", "factor:int[1,8]=2", access="neighbourhood", resamples=True)
def nn_upscale(rel, p, ctx):
    f = p["factor"]
    rel = rel.explode("i", rel.d.ints(0, f - 1)).explode("j", rel.d.ints(0, f - 1))
    return done(rel.let(x=f"x * {f} + i", y=f"y * {f} + j", w=f"w * {f}", h=f"h * {f}"))


# ----------------------------------------------------------------- other lines


@effect(
    "pixel-sort",
    "postprocess",
    "sortKey:enum{luma/hue/saturation}=luma; direction:enum{right/left/down/up}=right; threshold:float[0,1]=0.55; spanLimit:int[2,512]=64; jitter:float[0,1]=0; seed:seed=0",
    access="global",
)
def pixel_sort(rel, p, ctx):
    """Runs of keys at or over the line's threshold, cut at the limit, are sorted in place: gaps and islands."""
    vertical = p["direction"] in ("down", "up")
    line, pos = ("x", "y") if vertical else ("y", "x")
    lab = color.oklab(rel)
    lab = lab.let(chroma="sqrt(lab_a * lab_a + lab_b * lab_b)")
    key = {
        "luma": clamp("lab_l"),
        "saturation": clamp("chroma / 0.4"),
        "hue": f"case when chroma < 1e-6 then 0.0 else {fract(f'(atan2(lab_b, lab_a) / {num(TAU)} + 1.0)')} end",
    }[p["sortKey"]]
    lab, h = hashing.multiplied(lab.let(key=key), str(p["seed"]), line)
    lab = lab.let(lit=f"case when key >= {clamp(f'{num(p['threshold'])} + ({hashing.unit(lab.d, h)} - 0.5) * {num(p['jitter'])}')} then 1 else 0 end")
    of_line = ", ".join([*image(rel), line])
    # a run: pixels on since the last one off; a pixel off is a run of its own
    lab = lab.let(offs=f"sum(1 - lit) over (partition by {of_line} order by {pos} rows unbounded preceding)")
    lab = lab.let(nth=f"row_number() over (partition by {of_line}, offs, lit order by {pos}) - 1")
    lab = lab.let(span=f"case when lit = 1 then {lab.d.div('nth', p['spanLimit'])} else -1 end")
    run = f"partition by {of_line}, offs, lit, span"
    lab = lab.let(start=f"min({pos}) over ({run})", size=f"count(*) over ({run})", nth=f"row_number() over ({run} order by key, {pos}) - 1")
    back = p["direction"] in ("left", "up")
    lab = lab.let(**{pos: "case when lit = 1 then start + " + ("size - 1 - nth" if back else "nth") + f" else {pos} end"})
    return done(lab.let(**{pos: f"cast({pos} as bigint)"}))


# ------------------------------------------------------------------ index maps


def disc(radius: int, shape: str):
    """Offsets in scan order."""
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if shape == "square" or dx * dx + dy * dy <= radius * radius]


def around(rel, radius, shape):
    """The raster with each pixel's neighbours: o_idx and tap, in scan order; edges clamp."""
    offsets = disc(radius, shape)
    wide = rel.explode("tap", rel.d.ints(0, len(offsets) - 1))

    def by_tap(values):
        return "(case tap " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end)"

    wide = wide.let(sx=edge(f"x + {by_tap(dx for dx, _ in offsets)}", "w", "clamp"), sy=edge(f"y + {by_tap(dy for _, dy in offsets)}", "h", "clamp"), d2=by_tap(dx * dx + dy * dy for dx, dy in offsets))
    wide = wide.let(sx=key("sx"), sy=key("sy"))
    return wide.join(source_of(rel, ["idx"]), [*image(rel), "sx", "sy"])


@effect(
    "outline",
    "postprocess",
    "strokeWidth:int[1,8]=1; targetIndex:int[0,255]=0; colorIndex:int[0,255]=1; placement:enum{inside/outside/both}=inside; shape:enum{round/square}=round",
    access="neighbourhood",
    requires_index=True,
    produces_index=True,
)
def outline(rel, p, ctx):
    t = p["targetIndex"]
    near = around(rel, p["strokeWidth"], p["shape"]).group(keys(rel), idx="max(idx)", a="max(a)", r="max(r)", g="max(g)", b="max(b)", cut=f"max(case when (s_idx = {t}) <> (idx = {t}) then 1 else 0 end)")
    eligible = {"inside": f"idx = {t}", "outside": f"idx <> {t}", "both": "idx >= 0"}[p["placement"]]
    stroke = min(p["colorIndex"], len(ctx.palette.colors) - 1)
    return done(paint(near, ctx.palette, f"case when cut = 1 and {eligible} then {stroke} else idx end"))


@effect("dilate-erode", "postprocess", "operation:enum{dilate/erode}=dilate; targetIndex:int[0,255]=0; radius:int[1,8]=1; shape:enum{round/square}=round", access="neighbourhood", requires_index=True, produces_index=True)
def dilate_erode(rel, p, ctx):
    t = p["targetIndex"]
    near = around(rel, p["radius"], p["shape"])
    if p["operation"] == "dilate":
        out = near.group(keys(rel), idx="max(idx)", a="max(a)", hit=f"max(case when s_idx = {t} then 1 else 0 end)")
        return done(paint(out, ctx.palette, f"case when hit = 1 then {t} else idx end"))
    # the nearest other index; equally near ones by scan order. Packed, so that a plain minimum finds it.
    packed = f"min(case when s_idx <> {t} then (cast(d2 as bigint) * 1024 + tap) * 256 + s_idx end)"
    out = near.group(keys(rel), idx="max(idx)", a="max(a)", best=packed)
    return done(paint(out, ctx.palette, f"case when idx = {t} and best is not null then best % 256 else idx end"))


@effect("ridgeline", "dither", "pitch:float[2,200]=12; amplitude:float[0,10]=2.5; thickness:float[0.5,16]=1.5; angle:float[-0.5,0.5]=0; phase:float[-8,8]=0; hidden:bool=true; invert:bool=false", access="neighbourhood", produces_index=True)
def ridgeline(rel, p, ctx):
    """Rows of the image as a relief: the first of 13 rows, front to back, that reaches the pixel decides."""
    src = rel.let(lift=color.lightness())
    c, s, pitch, half = math.cos(TAU * p["angle"]), math.sin(TAU * p["angle"]), p["pitch"], p["thickness"] / 2
    qx, qy = "(x + 0.5 - w / 2.0)", "(y + 0.5 - h / 2.0)"
    rel = rel.let(across=f"{qx} * {num(-s)} + {qy} * {num(c)}", along=f"{qx} * {num(c)} + {qy} * {num(s)}")
    wide = rel.let(top=whole(f"(across + {num(half)}) / {num(pitch)} - {num(p['phase'])}")).explode("k", rel.d.ints(0, 12))
    wide = wide.let(base=f"(top - k + {num(p['phase'])}) * {num(pitch)}")
    wide = wide.let(sx=edge(whole(f"w / 2.0 + {num(-s)} * base + {num(c)} * along"), "w", "clamp"), sy=edge(whole(f"h / 2.0 + {num(c)} * base + {num(s)} * along"), "h", "clamp"))
    wide = wide.let(sx=key("sx"), sy=key("sy")).join(source_of(src, ["lift"]), [*image(rel), "sx", "sy"])
    wide = wide.let(delta=f"across - (base + {num(p['amplitude'] * pitch)} * s_lift)")
    if p["hidden"]:  # the first row at or in front of the pixel hides all behind it
        wide = wide.let(stop=f"case when delta >= {num(-half)} then k * 2 + (case when delta <= {num(half)} then 0 else 1 end) end")
        out = wide.group(keys(rel), a="max(a)", stop="min(stop)").let(ink="case when stop % 2 = 0 then 1 else 0 end")
    else:
        out = wide.group(keys(rel), a="max(a)", ink=f"max(case when abs(delta) <= {num(half)} then 1 else 0 end)")
    light, dark = lightest_darkest(ctx.palette)
    stroke, ground = (dark, light) if p["invert"] else (light, dark)
    return done(paint(out, ctx.palette, f"case when ink = 1 then {stroke} else {ground} end"))
