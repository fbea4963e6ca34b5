"""Waves that meet the picture's subject: a signed distance field of the picture, and a pattern drawn over it.

The subject is where a smoothed mask reaches a threshold; its boundary pixels are the
seeds. On Spark the nearest seed of every pixel is found exactly, a way at a time: the
nearest in its row by a window, then, of its column's rows, the one whose seed is nearest,
for all columns of an Arrow batch at once. Tasks hold a row or a column of one image. On
DuckDB every pixel is compared with every seed of its image.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelmill.functions import color
from pixelmill.functions.color import clamp, fract
from pixelmill.operators.contours import pieces
from pixelmill.operators.dithers import lightest_darkest
from pixelmill.operators.palettes import paint
from pixelmill.operators.pointwise import TAU, done
from pixelmill.operators.registry import effect
from pixelmill.operators.spatial import image, place
from pixelmill.plans.rel import SparkRel, num

#: The distance where an image has no boundary.
FAR = 1.0e9
#: Steps of a ray; a fixed value.
STEPS = 64
#: How far the subject's delay is felt, in wavelengths.
BEND_REACH = 1.5


def subject(rel, source: str, threshold: float, invert: bool, smoothing: float):
    """Adds inside (0 or 1) and seed (1 where a pixel's neighbour, within the image, is on the other side)."""
    radius = round(min(max(smoothing, 0.0), 32.0))
    rel = rel.let(mask="a" if source == "alpha" else color.lightness())
    for way, line, size in (("x", "y", "w"), ("y", "x", "h")):
        if radius:
            over = f"over (partition by {', '.join(image(rel))}, {line} order by {way} rows between"
            box = f"sum(mask) {over} {radius} preceding and {radius} following)"
            first = f"first_value(mask) {over} unbounded preceding and unbounded following)"
            last = f"last_value(mask) {over} unbounded preceding and unbounded following)"
            rel = rel.let(box=box, low=first, high=last)
            rel = rel.let(mask=f"(box + greatest({radius} - {way}, 0) * low + greatest({way} + {radius} - {size} + 1, 0) * high) / {num(2 * radius + 1)}").drop("box", "low", "high")
    rel = rel.let(inside=f"case when mask >= {num(threshold)} then {0 if invert else 1} else {1 if invert else 0} end").drop("mask")
    sides = {}
    for way, line in (("x", "y"), ("y", "x")):
        for move in ("lag", "lead"):
            sides[f"{move}_{way}"] = f"coalesce({move}(inside) over (partition by {', '.join(image(rel))}, {line} order by {way}), inside)"
    rel = rel.let(**sides)
    return rel.let(seed="case when " + " or ".join(f"inside <> {s}" for s in sides) + " then 1 else 0 end").drop(*sides)


def _lowest(entries, start, columns, heights):
    """For every y of some columns the entry with the least d + (y - its y)**2, the first of equals.

    ``entries`` has y and d, by column and y; ``start`` is where each column's begin. That entry never moves up as y
    grows, so the middle y of a stretch halves the entries that either side needs: a level of halves a round.
    """
    ey, d = entries
    first = np.cumsum(heights) - heights
    out = np.empty(int(heights.sum()), np.int64)
    column, low, high = columns, np.zeros(len(columns), np.int64), heights - 1
    least, most = start[:-1], start[1:] - 1
    while len(column):
        y = (low + high) // 2
        size = most - least + 1
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        e = np.arange(len(of)) - begin[of] + least[of]
        cost = d[e] + (y[of] - ey[e]) ** 2
        found = np.minimum.reduceat(np.where(cost == np.minimum.reduceat(cost, begin)[of], e, len(ey)), begin)
        out[first[column] + y] = found
        column, low, high = np.tile(column, 2), np.concatenate((low, y + 1)), np.concatenate((y - 1, high))
        least, most = np.concatenate((least, found)), np.concatenate((found, most))
        left = low <= high
        column, low, high, least, most = (c[left] for c in (column, low, high, least, most))
    return out


def _column_batches(batches):
    """The nearest seed of every pixel of a column, from each row's nearest one."""
    for batch in batches:
        key, x, h = (batch.column(i) for i in range(3))
        x, h, lists = x.to_numpy(), h.to_numpy(), batch.column(3)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        for low, high in pieces(offsets + np.concatenate(([0], np.cumsum(h)))):
            own = slice(int(offsets[low]), int(offsets[high]))
            start = offsets[low : high + 1] - offsets[low]
            at = np.repeat(np.arange(high - low), np.diff(start))
            y, sx = (lists.values.field(i).to_numpy()[own] for i in range(2))
            order = np.lexsort((y, at))
            y, sx = y[order], sx[order]
            found = _lowest((y, (sx - x[low:high][at]) ** 2), start, np.arange(high - low), h[low:high])
            ends = pa.array(np.concatenate(([0], np.cumsum(h[low:high]))), pa.int32())
            near = pa.ListArray.from_arrays(ends, pa.array(y[found] * 65536 + sx[found]))
            yield pa.RecordBatch.from_arrays([key.slice(low, high - low), batch.column(1).slice(low, high - low), near], names=["key", "x", "near"])


def _seeded(rel):
    """(image, x, y, near): the nearest seed of each pixel, the first of equals, as y * 65536 + x; none where an image has none."""
    k = image(rel)
    row = f"over (partition by {', '.join(k)}, y order by x rows between"
    rel = rel.let(before=f"last(case when seed = 1 then x end, true) {row} unbounded preceding and current row)", after=f"first(case when seed = 1 then x end, true) {row} current row and unbounded following)")
    rel = rel.let(sx="case when after is null or x - before <= after - x then before else after end").where("sx is not null")
    columns = rel.df.groupBy(*k, "x", "h").agg(F.collect_list(F.struct("y", "sx")).alias("rows")).select(F.struct(*k).alias("key"), "x", "h", "rows")
    kind = columns.schema["key"].dataType.simpleString()
    found = columns.mapInArrow(_column_batches, f"key {kind}, x long, near array<long>").select("key.*", "x", F.posexplode("near").alias("y", "near"))
    return SparkRel(found.select(*k, "x", F.col("y").cast("long").alias("y"), "near"))


def _nearest(rel):
    """The same seeds, by comparing every pixel with every seed of its image."""
    k = image(rel)
    same = " and ".join(f"s.{c} = p.{c}" for c in k)
    sql = f"""select {", ".join(f"p.{c}" for c in (*k, "x", "y"))}, min_by(s.y * 65536 + s.x, (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) + (s.y * 65536 + s.x) / 1e11) as near
      from {rel.name} p join {rel.name} s on {same} and s.seed = 1 group by {", ".join(f"p.{c}" for c in (*k, "x", "y"))}"""
    return rel._next(sql, [*k, "x", "y", "near"])


def distance_field(rel):
    """Adds fd, the signed distance in pixels to the subject's boundary (negative inside), and gx, gy, its gradient:
    out of the subject on both sides, zero on the boundary. Without a boundary fd is ``FAR``. rel: as ``subject`` gives."""
    if isinstance(rel, SparkRel):
        from pixelmill.plans.scratch import settled

        rel = SparkRel(settled(rel.df))
        near = _seeded(rel)
    else:
        near = _nearest(rel)
    rel = rel.join(near, place(rel), "left").let(side="case when inside = 1 then -1.0 else 1.0 end")
    rel = rel.let(sx=f"cast(near % 65536 as double) - x", sy=f"cast({rel.d.div('near', 65536)} as double) - y").let(away="sqrt(sx * sx + sy * sy)")
    rel = rel.let(
        fd=f"case when near is null then side * {num(FAR)} when away < 0.000001 then 0.0 else side * away end",
        gx="case when near is null or away < 0.000001 then 0.0 else -side * sx / away end",
        gy="case when near is null or away < 0.000001 then 0.0 else -side * sy / away end",
    )
    return rel.drop("near", "side", "sx", "sy", "away", "inside", "seed")


def _source(rel, p):
    """Adds td, the distance from the source, and tx, ty, the direction back to it."""
    px, py = "(x + 0.5)", "(y + 0.5)"
    if p["sourceKind"] == "line":
        nx, ny = -math.sin(p["sourceAngle"] * TAU), math.cos(p["sourceAngle"] * TAU)
        rel = rel.let(q=f"({px} - {num(p['sourceX'])} * w) * {num(nx)} + ({py} - {num(p['sourceY'])} * h) * {num(ny)}")
        return rel.let(td="abs(q)", tx=f"case when q > 0 then {num(-nx)} else {num(nx)} end", ty=f"case when q > 0 then {num(-ny)} else {num(ny)} end").drop("q")
    if p["sourceKind"] == "edge":
        rel = rel.let(td=f"least({px}, w - {px}, {py}, h - {py})")
        way = f"case when td = {px} then 0 when td = w - {px} then 1 when td = {py} then 2 else 3 end"
        return rel.let(way=way).let(tx="case way when 0 then -1.0 when 1 then 1.0 else 0.0 end", ty="case way when 2 then -1.0 when 3 then 1.0 else 0.0 end").drop("way")
    rel = rel.let(ux=f"{num(p['sourceX'])} * w - {px}", uy=f"{num(p['sourceY'])} * h - {py}").let(td="sqrt(ux * ux + uy * uy)")
    return rel.let(tx="case when td > 0.000001 then ux / td else 0.0 end", ty="case when td > 0.000001 then uy / td else 0.0 end").drop("ux", "uy")


def _clear_spark(rel, wavelength: float):
    """(image, x, y, clear): how freely the source is seen. Rays advance by their clearance, all of them a step a job."""
    from pixelmill.plans.scratch import settled

    k = image(rel)
    field = settled(rel.df.select(*k, "x", "y", "w", "h", "fd", "tx", "ty", "td"))
    no_ray = (F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") < 0.5) | (F.abs("fd") >= FAR)
    start = F.when(no_ray, F.lit(1.0)).when(F.col("fd") <= 0, F.lit(0.0))
    rays = settled(field.withColumns({"clear": start, "gone": F.greatest("fd", F.lit(1.0)), "least": F.lit(1.0)}))
    there = field.select(*k, F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("fd").alias("near"))
    ended = [rays.where("clear is not null").select(*k, "x", "y", "clear")]
    rays = rays.where("clear is null").drop("fd", "clear")
    for _ in range(STEPS):
        if rays.isEmpty():
            break
        cell = {"cx": F.floor(F.col("x") + 0.5 + F.col("tx") * F.col("gone")), "cy": F.floor(F.col("y") + 0.5 + F.col("ty") * F.col("gone"))}
        moved = rays.withColumns(cell).join(there, [*k, "cx", "cy"], "left")
        over = (F.col("gone") >= F.col("td")) | F.col("near").isNull()
        moved = moved.withColumn("clear", F.when(over, F.col("least")).when(F.col("near") <= 0, F.lit(0.0)))
        least = F.least("least", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("near") / wavelength)))
        moved = settled(moved.withColumns({"least": F.when(F.col("clear").isNull(), least).otherwise(F.col("least")), "gone": F.col("gone") + F.greatest("near", F.lit(1.0))}))
        ended.append(moved.where("clear is not null").select(*k, "x", "y", "clear"))
        rays = moved.where("clear is null").drop("cx", "cy", "near", "clear")
    ended.append(rays.select(*k, "x", "y", F.col("least").alias("clear")))
    out = ended[0]
    for part in ended[1:]:
        out = out.unionAll(part)
    return SparkRel(out)


def _clear_duck(rel, wavelength: float):
    k = image(rel)
    base = rel._next(f"select {', '.join(k)}, x, y, w, h, fd, tx, ty, td from {rel.name}", [*k, "x", "y", "w", "h", "fd", "tx", "ty", "td"])
    b, own = base.name, ", ".join(f"r.{c}" for c in (*k, "x", "y", "tx", "ty", "td"))
    step = "r.{0} + 0.5e0 + r.t{0} * r.gone"
    sql = f"""select {", ".join(k)}, x, y, coalesce(max(clear), min(least)) as clear from (
      with recursive ray as (
        select {", ".join(k)}, x, y, tx, ty, td, 0 as i, greatest(fd, 1e0) as gone, 1e0 as least,
          case when tx * tx + ty * ty < 0.5e0 or abs(fd) >= {FAR!r} then 1e0 when fd <= 0 then 0e0 end as clear from {b}
        union all
        select {own}, r.i + 1, r.gone + greatest(f.fd, 1e0), case when r.gone >= r.td or f.fd is null or f.fd <= 0 then r.least else least(r.least, greatest(0e0, least(1e0, f.fd / {wavelength!r}))) end,
          case when r.gone >= r.td or f.fd is null then r.least when f.fd <= 0 then 0e0 end
        from ray r left join {b} f on {" and ".join(f"f.{c} = r.{c}" for c in k)} and f.x = floor({step.format("x")}) and f.y = floor({step.format("y")})
        where r.clear is null and r.i < {STEPS}
      ) select * from ray) group by {", ".join(k)}, x, y"""
    return base._next(sql, [*k, "x", "y", "clear"])


@effect(
    "wave-field",
    "dither",
    "sourceKind:enum{point/line/edge}=point; sourceX:float[-1,2]=0.2; sourceY:float[-1,2]=0.15; sourceAngle:float[0,1]=0; wavelength:float[3,400]=28; amplitude:float[0,4]=1; "
    "falloff:float[0.02,4]=0.9; thickness:float[0.5,32]=3; mode:enum{flow-around/shadow}=flow-around; strength:float[-1,1]=0.9; phase:float[-8,8]=0; invert:bool=false; "
    "maskSource:enum{luminance/alpha}=luminance; maskThreshold:float[0,1]=0.42; maskSmoothing:float[0,32]=8; maskInvert:bool=false",
    access="global",
    produces_index=True,
)
def wave_field(rel, p, ctx):
    """Crests of a wave from a source as strokes; the subject delays it (flow-around) or hides the source from what lies behind (shadow)."""
    wavelength = max(p["wavelength"], 0.5)
    rel = distance_field(subject(rel, p["maskSource"], p["maskThreshold"], p["maskInvert"], p["maskSmoothing"]))
    rel = _source(rel, p)
    if p["mode"] == "flow-around":
        delay = f"{num(p['strength'] * wavelength)} * exp(-abs(fd) / {num(wavelength * BEND_REACH)})"
        facing = "(case when tx * tx + ty * ty > 0.5 then -(gx * tx + gy * ty) else 1.0 end)"
        rel = rel.let(far=f"td + case when abs(fd) < {num(FAR)} then {delay} * {facing} else 0.0 end", seen=num(1))
    else:
        clear = _clear_spark(rel, wavelength) if isinstance(rel, SparkRel) else _clear_duck(rel, wavelength)
        part = num(min(abs(p["strength"]), 1.0))
        rel = rel.join(clear, place(rel)).let(far="td", seen=f"1.0 + (clear - 1.0) * {part}")
    crest = f"abs({fract(f'(far / {num(wavelength)} + {num(p['phase'])} + 0.5)')} - 0.5) * {num(wavelength)}"
    reach = f"({num(max(p['falloff'], 0.001))} * sqrt(cast(w * w + h * h as double)))"
    half = f"{num(p['thickness'] / 2)} * {clamp(f'({num(p['amplitude'])} * exp(-far / {reach}) * seen)')}"
    rel = rel.let(crest=crest, half=half)
    light, dark = lightest_darkest(ctx.palette)
    stroke, ground = (dark, light) if p["invert"] else (light, dark)
    return done(paint(rel, ctx.palette, f"case when crest <= half then {stroke} else {ground} end"))
