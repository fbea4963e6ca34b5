"""Error diffusion: serial within an image, parallel over images.

A pixel's choice depends on all before it, so one image is one sequence; images
are independent rows. Each is gathered into one row of planes (bounded: an image has
at most 16 777 216 pixels), and a vectorised kernel walks many images of one size
side by side. Independent SQL for the same rules serves as the oracle.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa

from pixelmill.functions import color
from pixelmill.operators.dithers import Pcg32, stream_of
from pixelmill.operators.palettes import Palette
from pixelmill.operators.registry import effect
from pixelmill.operators.spatial import image, place
from pixelmill.plans.rel import DuckRel, SparkRel, num

SIDE_LIMIT, PIXEL_LIMIT = 8192, 16_777_216
#: More than any loop has.
FRAMES = 1 << 20

#: (divisor, rows of (dx of the first weight, weights)) from the current row down; fixed values.
KERNELS = {
    "floyd-steinberg": (16, [(1, [7]), (-1, [3, 5, 1])]),
    "false-floyd-steinberg": (8, [(1, [3]), (-1, [3, 2])]),
    "jarvis-judice-ninke": (48, [(1, [7, 5]), (-2, [3, 5, 7, 5, 3]), (-2, [1, 3, 5, 3, 1])]),
    "stucki": (42, [(1, [8, 4]), (-2, [2, 4, 8, 4, 2]), (-2, [1, 2, 4, 2, 1])]),
    "burkes": (32, [(1, [8, 4]), (-2, [2, 4, 8, 4, 2])]),
    "sierra-3": (32, [(1, [5, 3]), (-2, [2, 4, 5, 4, 2]), (-1, [2, 3, 2])]),
    "sierra-2": (16, [(1, [4, 3]), (-2, [1, 2, 3, 2, 1])]),
    "sierra-lite": (4, [(1, [2]), (-1, [1, 1])]),
    "atkinson": (8, [(1, [1, 1]), (-1, [1, 1, 1]), (0, [1])]),
    "stevenson-arce": (200, [(2, [32]), (-3, [12, 0, 26, 0, 30, 0, 16]), (-2, [12, 0, 26, 0, 12]), (-3, [5, 0, 12, 0, 12, 0, 5])]),
    "fan": (16, [(1, [7]), (-2, [1, 3, 5])]),
    "shiau-fan": (8, [(1, [4]), (-2, [1, 1, 2])]),
    "shiau-fan-2": (16, [(1, [8]), (-3, [1, 1, 2, 4])]),
}
#: Weights right, down-left, down at key levels of the lower half; between them shares are linear. Fixed values.
LEVEL_KEYS = [
    (0, 13, 0, 5), (1, 13, 0, 5), (2, 21, 0, 10), (3, 7, 0, 4), (4, 8, 0, 5), (10, 7, 3, 3), (22, 3, 2, 1), (32, 20, 10, 19),
    (64, 11, 10, 0), (72, 5, 7, 1), (77, 4, 1, 1), (85, 4, 1, 1), (95, 5, 3, 2), (107, 5, 3, 2), (127, 4, 1, 1),
]
HISTORY, DECAY = 16, 16.0
CONTROLS = "strength:float[0,1]=1; jitter:float[0,1]=0; overshootLimit:float[0,4]=1; channels:enum{per-channel/luma}=per-channel; seed:seed=0"


def taps(kernel: str) -> list[tuple[int, int, float]]:
    divisor, rows = KERNELS[kernel]
    return [(dx + k, dy, w / divisor) for dy, (dx, weights) in enumerate(rows) for k, w in enumerate(weights) if w]


@functools.cache
def level_shares() -> tuple[tuple[float, float, float], ...]:
    """Shares of right, down-left, down for 256 levels; the upper half mirrors the lower."""
    half = []
    for level in range(128):
        k = max(i for i, key in enumerate(LEVEL_KEYS) if key[0] <= level)
        a, b = LEVEL_KEYS[k], LEVEL_KEYS[min(k + 1, len(LEVEL_KEYS) - 1)]
        t = (level - a[0]) / (b[0] - a[0]) if b[0] > a[0] else 0.0
        half.append(tuple((1 - t) * a[i] / sum(a[1:]) + t * b[i] / sum(b[1:]) for i in (1, 2, 3)))
    return tuple(half + half[::-1])


def hilbert(width: int, height: int) -> list[int]:
    """Row-major places along a Hilbert curve over the enclosing power of two."""
    side = 1
    while side < max(width, height):
        side *= 2
    out = []
    # an explicit stack of (corner, step along the quarter, step across); quarters outside the image are skipped
    stack = [(0, 0, side, 0, 0, side)]
    while stack:
        x, y, ax, ay, bx, by = stack.pop()
        lx, ly, n = min(x, x + ax + bx, x + ax, x + bx), min(y, y + ay + by, y + ay, y + by), abs(ax + ay)
        if n == 1:
            lx, ly = (x + min(0, ax + bx)), (y + min(0, ay + by))
            if 0 <= lx < width and 0 <= ly < height:
                out.append(ly * width + lx)
            continue
        if lx >= width or ly >= height:
            continue
        hx, hy, kx, ky = ax // 2, ay // 2, bx // 2, by // 2
        stack += [
            (x + hx + ax - hx + kx, y + hy + ay - hy + ky, -kx, -ky, -hx, -hy),
            (x + hx + kx, y + hy + ky, hx, hy, kx, ky),
            (x + kx, y + ky, hx, hy, kx, ky),
            (x, y, kx, ky, hx, hy),
        ]
    return out


def scan(w: int, h: int, serpentine: bool) -> list[tuple[int, int]]:
    """(place, direction) in order."""
    out = []
    for y in range(h):
        back = serpentine and y % 2 == 1
        out += [(y * w + x, -1 if back else 1) for x in (reversed(range(w)) if back else range(w))]
    return out


def jitter_of(n: int, seed: int) -> np.ndarray:
    rng = Pcg32(seed, stream_of("diffusion-threshold-jitter"))
    return np.array([rng.next_f32() for _ in range(n)])


def _nearest(rgb, palette: Palette):
    if palette.metric == "oklab":
        lms = np.cbrt(np.maximum(rgb, 0) @ np.array(color.TO_LMS).T)
        m = lms @ np.array(color.TO_LAB).T
    else:
        c = np.maximum(rgb, 0)
        m = np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055)
    d = ((m[:, None, :] - np.array(palette.match)[None]) ** 2).sum(2)
    return d.argmin(1)


def diffuse(rgb: np.ndarray, w: int, h: int, kernel: str, p: dict, palette: Palette) -> np.ndarray:
    """rgb (images, pixels, 3) of linear light -> indices (images, pixels)."""
    if max(w, h) > SIDE_LIMIT or w * h > PIXEL_LIMIT:
        raise ValueError(f"an image of {w} x {h} exceeds {SIDE_LIMIT} a side or {PIXEL_LIMIT} pixels")
    work, out = rgb.copy(), np.zeros(rgb.shape[:2], np.int32)
    lin = np.array(palette.linear)
    low, high = -p["overshootLimit"], 1 + p["overshootLimit"]
    luma = np.array(color.LUMA)
    shift = (jitter_of(w * h, p["seed"]) - 0.5) * p["jitter"] if p["jitter"] else None

    def resolve(i):
        now = work[:, i]
        idx = _nearest(now if shift is None else now + shift[i], palette)
        out[:, i] = idx
        err = now - lin[idx]
        if p["channels"] == "luma":
            err = np.repeat((err @ luma)[:, None], 3, 1)
        return err * p["strength"]

    if kernel == "riemersma":
        ratio = DECAY ** (1 / (HISTORY - 1))
        weights = np.array([ratio**k for k in range(HISTORY)])
        weights /= weights.sum()
        queue = np.zeros((HISTORY, len(rgb), 3))
        for i in hilbert(w, h):
            work[:, i] = np.clip(work[:, i] + np.tensordot(weights, queue, 1), low, high)
            queue = np.concatenate((queue[1:], resolve(i)[None]))
        return out
    if kernel == "ostromoukhov":
        level = np.floor(np.clip(rgb @ luma, 0, 1) * 255 + 0.5).astype(int)
        shares = np.array(level_shares())
    else:
        fixed = taps(kernel)
    for i, direction in scan(w, h, p["serpentine"]):
        err = resolve(i)
        x, y = i % w, i // w
        if kernel == "ostromoukhov":
            own = shares[level[:, i]]
            spread = [(1, 0, own[:, :1]), (-1, 1, own[:, 1:2]), (0, 1, own[:, 2:])]
        else:
            spread = fixed
        for dx, dy, share in spread:
            nx, ny = x + dx * direction, y + dy
            if 0 <= nx < w and ny < h:
                j = ny * w + nx
                work[:, j] = np.clip(work[:, j] + err * share, low, high)
    return out


def _batches(kernel, p, palette):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            ws, hs = (batch.column(k).to_numpy() for k in (1, 2))
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            size = 3 * ws * hs
            start = np.concatenate(([0], np.cumsum(size)))
            results: list = [None] * len(ws)
            for w, h in {(int(a), int(b)) for a, b in zip(ws, hs, strict=True)}:
                own = np.flatnonzero((ws == w) & (hs == h))
                rgb = np.stack([flat[start[k] : start[k + 1]].reshape(w * h, 3) for k in own])
                for k, row in zip(own, diffuse(rgb, w, h, kernel, p, palette), strict=True):
                    results[k] = row
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), batch.column(2), pa.array(results, pa.list_(pa.int32()))], names=["key", "w", "h", "idx"])

    return run


def on_spark(rel: SparkRel, kernel: str, p: dict, palette: Palette) -> SparkRel:
    from pyspark.sql import functions as F

    one = image(rel)  # every frame is an image of its own
    pixels = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    planes = rel.df.groupBy(*one, "w", "h").agg(pixels.alias("p"))
    planes = planes.select(F.struct(*one).alias("key"), "w", "h", F.flatten(F.transform("p", lambda v: F.array(v["r"], v["g"], v["b"]))).alias("rgb"))
    kind = planes.schema["key"].dataType.simpleString()
    done = planes.mapInArrow(_batches(kernel, p, palette), f"key {kind}, w long, h long, idx array<int>")
    out = done.select("key.*", "w", "h", F.posexplode("idx").alias("pos", "idx"))
    return SparkRel(out.select(*one, (F.col("pos") % F.col("w")).alias("x"), F.expr("pos div w").alias("y"), "w", "h", "idx"))


def on_duck(rel: DuckRel, kernel: str, p: dict, palette: Palette, w: int = 8, h: int = 8) -> DuckRel:
    """The same rule as a recursive query, for images of one known small size."""
    framed = "frame" in rel.columns
    if framed:  # one number for both until the end
        rel = rel.let(image_id=f"image_id * {FRAMES} + frame").drop("frame")
    n = w * h
    low, high = num(-p["overshootLimit"]), num(1 + p["overshootLimit"])
    order = [(i, 1) for i in hilbert(w, h)] if kernel == "riemersma" else scan(w, h, p["serpentine"])
    at = f"[{', '.join(str(i) for i, _ in order)}][n + 1]"
    way = f"[{', '.join(str(d) for _, d in order)}][n + 1]"
    planes = ", ".join(f"list({c} order by y, x) as p{c}" for c in "rgb")
    rel = rel._next(f"select image_id, {planes} from {rel.name} group by image_id", ["image_id", "pr", "pg", "pb"])
    zero = f"list_resize([cast(0 as double)], {HISTORY}, cast(0 as double))"
    first = f"select image_id, 0 as n, pr, pg, pb, pr as sr, pg as sg, pb as sb, [0][:0] as idx, {zero} as qr, {zero} as qg, {zero} as qb from {rel.name}"
    cur = {c: f"p{c}[i + 1]" for c in "rgb"}
    if kernel == "riemersma":
        ratio = DECAY ** (1 / (HISTORY - 1))
        weights = [ratio**k for k in range(HISTORY)]
        shares = [v / sum(weights) for v in weights]
        cur = {c: f"least(greatest(p{c}[i + 1] + ({' + '.join(f'q{c}[{k + 1}] * {num(v)}' for k, v in enumerate(shares))}), {low}), {high})" for c in "rgb"}
    lab = [" + ".join(f"({num(k)}) * cbrt({' + '.join(f'greatest(c{c}, 0) * {num(v)}' for c, v in zip('rgb', lms, strict=True))})" for k, lms in zip(row, color.TO_LMS, strict=True)) for row in color.TO_LAB]
    dist = [" + ".join(f"(m{k} - ({num(v)})) * (m{k} - ({num(v)}))" for k, v in enumerate(m)) for m in palette.match]
    names = [f"d{k}" for k in range(len(dist))]
    pick = "case " + " ".join(f"when {d} <= least({', '.join(names)}) then {k}" for k, d in enumerate(names)) + " end"
    entry = {c: "case k " + " ".join(f"when {i} then {num(v[j])}" for i, v in enumerate(palette.linear)) + " end" for j, c in enumerate("rgb")}
    dx, dy = f"(((j - 1) % {w}) - i % {w}) * way", f"((j - 1) // {w} - i // {w})"
    if kernel == "ostromoukhov":
        lum = f"(sr[i + 1] * {num(color.LUMA[0])} + sg[i + 1] * {num(color.LUMA[1])} + sb[i + 1] * {num(color.LUMA[2])})"
        table = "[" + ", ".join(f"[{', '.join(num(v) for v in row)}]" for row in level_shares()) + "]"
        own = f"{table}[cast(floor(least(greatest({lum}, 0), 1) * 255.0 + 0.5) as int) + 1]"
        spots = [(1, 0, "own[1]"), (-1, 1, "own[2]"), (0, 1, "own[3]")]
    else:
        own, spots = "[0.0]", [] if kernel == "riemersma" else [(a, b, num(v)) for a, b, v in taps(kernel)]
    share = "case " + " ".join(f"when {dy} = {b} and {dx} = {a} then {v}" for a, b, v in spots) + " end" if spots else "null"
    update = {c: f"list_transform(p{c}, lambda v, j: case when ({share}) is null then v else least(greatest(v + e{c} * ({share}), {low}), {high}) end)" for c in "rgb"} if spots else {c: f"p{c}" for c in "rgb"}
    queue = {c: f"list_append(q{c}[2:], e{c})" if kernel == "riemersma" else f"q{c}" for c in "rgb"}
    step = f"""
      select image_id, n + 1, {', '.join(update[c] for c in 'rgb')}, sr, sg, sb, list_append(idx, k), {', '.join(queue[c] for c in 'rgb')}
      from (select *, {', '.join(f'(c{c} - {entry[c]}) * {num(p["strength"])} as e{c}' for c in 'rgb')}
      from (select *, {pick} as k
      from (select *, {', '.join(f'{d} as d{k}' for k, d in enumerate(dist))}
      from (select *, {', '.join(f'{v} as m{k}' for k, v in enumerate(lab))}
      from (select *, {', '.join(f'{cur[c]} as c{c}' for c in 'rgb')}
      from (select *, {at} as i, {way} as way from walk where n < {n}) u0) u1) u2) u3) u4
      ) u5"""
    if kernel == "ostromoukhov":
        step = step.replace(f"{way} as way from walk", f"{way} as way, {own.replace('i + 1', f'{at} + 1')} as own from walk")
    walk = f"select image_id, idx from (with recursive walk as ({first} union all {step}) select image_id, idx from walk where n = {n})"
    rel = rel._next(walk, ["image_id", "idx"])
    places = ", ".join(str(i) for i, _ in order)
    sql = f"select image_id, cast(pos % {w} as bigint) as x, cast(pos // {w} as bigint) as y, cast({w} as bigint) as w, cast({h} as bigint) as h, idx from (select image_id, unnest([{places}]) as pos, unnest(idx) as idx from {rel.name})"
    rel = rel._next(sql, ["image_id", "x", "y", "w", "h", "idx"])
    return rel.let(frame=f"image_id % {FRAMES}", image_id=f"image_id // {FRAMES}") if framed else rel


def _register(kernel: str):
    spec = CONTROLS if kernel == "riemersma" else f"serpentine:bool=true; {CONTROLS}"

    @effect(kernel, "dither", spec, access="serial", produces_index=True)
    def run(rel, p, ctx):
        """Colours are joined back from the palette; alpha is the input's."""
        from pixelmill.operators.palettes import paint

        p = {"serpentine": False} | p
        index = (on_spark if isinstance(rel, SparkRel) else on_duck)(rel, kernel, p, ctx.palette)
        alpha = rel.keep(*place(rel), "a")
        return paint(index.join(alpha, place(rel)), ctx.palette, "idx")


for _kernel in (*KERNELS, "ostromoukhov", "riemersma"):
    _register(_kernel)

assert math.isclose(sum(level_shares()[5]), 1.0)
