"""Vector tracing of index maps: regions, minimum feature size, contours, simplification, SVG.

Everything is a table. A layer is one palette index of one image or frame.

* Runs are maximal stretches of a layer in a row. Runs that touch across rows are found
  by looking up, in the other row, the run at the places where either begins; regions
  are the components of that relation. Blocks of rows and columns link their own pairs;
  only images of several blocks take rounds of star contraction.
* Below a minimum area regions are dropped and the enclosed holes of what is left are
  filled, so a dropped speck goes to the colour around it.
* A pixel's sides that face another colour are edges with the layer on their right.
  At a corner an edge goes on to the right, else straight, else to the left, which is a
  permutation: its cycles are the contours. Squares of bounded size, with a border of one
  pixel, link their own edges to chains; chains that leave a square are joined by pointer
  doubling, in as many rounds as the contour with most chains has binary digits.
* A contour is a row from then on. Simplification is Douglas-Peucker on all rings of an
  Arrow batch at once, one level of splits a round.

Regions are 4-connected, holes 8-connected. Tasks hold a row, a square or a ring of one
image, never more; no image has to fit in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.palettes import Palette
from pixelmill.plans.scratch import settled

#: Pixels on a side of the squares whose edges are linked in one place. Fixed value.
SQUARE = 64
#: Columns of a block in which touching runs are linked; it has ``SQUARE`` rows. Fixed value.
BLOCK = 1024


def keys(df: DataFrame) -> list[str]:
    """What names an image: its id, and its frame if there is one."""
    return [c for c in ("image_id", "frame") if c in df.columns]


def layer_runs(pixels: DataFrame) -> DataFrame:
    """(image, layer, y, x0, x1, w, h): maximal runs of one index; x1 is the last pixel."""
    k = keys(pixels)
    isle = F.col("x") - F.row_number().over(Window.partitionBy(*k, "y", "idx").orderBy("x"))
    rows = pixels.withColumn("isle", isle).groupBy(*k, "y", "idx", "isle", "w", "h").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return rows.select(*k, F.col("idx").cast("long").alias("layer"), *(F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1", "w", "h")))


def gaps(runs: DataFrame) -> DataFrame:
    """The runs of a layer's background, in every row of its image, also in rows without the layer."""
    k = [*keys(runs), "layer"]
    run = F.struct("x0", "x1").alias("run")
    every = runs.select(*k, "w", "h").distinct().select(*k, F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("y"), "w", "h")
    rows = runs.select(*k, "y", "w", "h", run).unionByName(every.withColumn("run", F.lit(None).cast("struct<x0:bigint,x1:bigint>")))
    rows = rows.groupBy(*k, "y", "w", "h").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    begin, end = F.expr("concat(array(0L), transform(runs, r -> r.x1 + 1))"), F.expr("concat(transform(runs, r -> r.x0 - 1), array(w - 1))")
    between = rows.select(*k, "y", "w", "h", F.explode(F.arrays_zip(begin.alias("x0"), end.alias("x1"))).alias("gap"))
    return between.select(*k, "y", "gap.x0", "gap.x1", "w", "h").where("x0 <= x1")


def touching(runs: DataFrame, reach: int) -> DataFrame:
    """(image, layer, u, v, whole): runs in neighbouring rows that share a column (``reach`` 1: or a corner), as stars.

    Of two that touch, one begins within ``reach`` of the other, so each run's beginning is looked up
    in the rows above and below: the last run that begins there or before it. The pairs found in one block of an
    image are replaced by stars around each component's smallest place, u; ``whole`` where the image has one block only.
    """
    k = keys(runs)
    band = F.floor(F.col("y") / SQUARE).alias("band")
    own = runs.select(*k, "layer", "y", "x0", "x1", "w", "h", place())
    asked = own.select(*k, "layer", "w", "h", F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y"), "x0", F.col("place").alias("asks")).where("y >= 0 and y < h")
    asked = asked.select(*k, "layer", "w", "h", "y", F.explode(F.sequence(F.col("x0") - reach, F.col("x0") + reach)).alias("x"), "asks")
    both = own.select(*k, "layer", "w", "h", "y", F.col("x0").alias("x"), F.lit(None).cast("long").alias("asks"), F.struct("x1", "place").alias("run"))
    both = both.unionByName(asked.withColumn("run", F.lit(None).cast(both.schema["run"].dataType)))
    both = both.select("*", band).repartition(*k, "band")  # the windows and the blocks need no shuffle of their own
    found = Window.partitionBy(*k, "band", "layer", "y").orderBy("x", F.col("asks").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("run", F.last("run", ignorenulls=True).over(found)).where("asks is not null and run.x1 >= x")
    whole = ((F.col("h") <= SQUARE) & (F.col("w") <= BLOCK)).alias("whole")
    pair = F.struct("layer", F.col("asks").alias("u"), F.col("run.place").alias("v"))
    blocks = hit.groupBy(*k, "band", F.floor(F.col("x") / BLOCK).alias("block"), whole).agg(F.collect_list(pair).alias("pairs"))
    blocks = blocks.select(F.struct(*k).alias("key"), "whole", "pairs")
    kind = blocks.schema["key"].dataType.simpleString()
    return blocks.mapInArrow(_star_batches, f"key {kind}, layer long, u long, v long, whole boolean").select("key.*", "layer", "u", "v", "whole")


def _rooted(a, b, n: int):
    """The smallest number that each of n nodes is connected to by the pairs a, b."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _star_batches(batches):
    """The pairs of each block as stars: every place but the smallest of its component, with that one."""
    for batch in batches:
        key, whole, lists = (batch.column(i) for i in range(3))
        offsets = lists.offsets.to_numpy()
        for low, high in pieces(offsets):
            own = slice(int(offsets[low]), int(offsets[high]))
            layer, u, v = (lists.values.field(i).to_numpy()[own] for i in range(3))
            block = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
            if not len(u):
                continue
            nodes = np.concatenate([np.stack([block, layer, end]) for end in (u, v)], axis=1)
            sort = np.lexsort(nodes[::-1])
            nodes = nodes[:, sort]
            fresh = np.concatenate(([True], (np.diff(nodes) != 0).any(axis=0)))
            number = np.empty(len(sort), np.int64)
            number[sort] = np.cumsum(fresh) - 1
            nodes = nodes[:, fresh]
            root = _rooted(number[: len(u)], number[len(u) :], nodes.shape[1])
            leaf = np.flatnonzero(root != np.arange(len(root)))
            at = pa.array(nodes[0, leaf] + low)
            columns = [key.take(at), pa.array(nodes[1, leaf]), pa.array(nodes[2, root[leaf]]), pa.array(nodes[2, leaf]), whole.take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "layer", "u", "v", "whole"])


def place() -> Column:
    """A run's number: that of its first pixel."""
    return (F.col("y") * F.col("w") + F.col("x0")).alias("place")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (image, layer, place) with ``root``, the smallest place each is connected to by ``edges`` (u < v).

    Edges that are ``whole`` are stars already. The others take large and small stars in turn: every node's larger
    neighbours are tied to its smallest one, then its smaller ones, until all are stars.
    """
    k = [*keys(nodes), "layer"]
    edges = settled(edges)
    now = edges.where("not whole").drop("whole")
    while not now.isEmpty():
        both = now.select(*k, F.col("u").alias("a"), F.col("v").alias("b")).unionAll(now.select(*k, F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy(*k, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, [*k, "a"]).select(*k, F.col("m").alias("u"), F.col("b").alias("v")).distinct()
        low = large.groupBy(*k, "v").agg(F.min("u").alias("m"))
        small = large.join(low, [*k, "v"]).where("u <> m").select(*k, F.col("m").alias("u"), F.col("u").alias("v"))
        following = settled(small.unionAll(low.select(*k, F.col("m").alias("u"), "v")).distinct())
        tops, leaves = following.select(*k, "u").distinct(), following.select(*k, F.col("v").alias("u"))
        many = following.groupBy(*k, "v").count().where("count > 1")
        now = following
        if many.isEmpty() and tops.join(leaves, [*k, "u"], "left_semi").isEmpty():
            break
    now = now.unionByName(edges.where("whole").drop("whole"))
    return nodes.join(now.select(*k, F.col("v").alias("place"), F.col("u").alias("root")), [*k, "place"], "left").withColumn("root", F.coalesce("root", "place"))


def regions(runs: DataFrame, reach: int = 0) -> DataFrame:
    """Runs with ``root`` and the ``area`` of their region; 4-connected, or 8-connected with ``reach`` 1."""
    k = [*keys(runs), "layer"]
    rooted = components(runs.withColumn("place", place()), touching(runs, reach))
    return rooted.withColumn("area", F.sum(F.col("x1") - F.col("x0") + 1).over(Window.partitionBy(*k, "root")))


def without_specks(runs: DataFrame, least_area: int) -> tuple[DataFrame, DataFrame]:
    """(runs, report): regions below ``least_area`` dropped, then enclosed holes below it filled.

    The report has image, layer, regions_dropped, region_pixels_dropped, holes_filled, hole_pixels_filled. A hole that
    reaches the border is not enclosed. A filled pixel was dropped from another layer, and is filled by one only.
    """
    k = [*keys(runs), "layer"]
    columns = [*k, "y", "x0", "x1", "w", "h"]
    if least_area <= 1:
        none = [F.lit(0).cast("long").alias(c) for c in ("regions_dropped", "region_pixels_dropped", "holes_filled", "hole_pixels_filled")]
        return runs.select(*columns), runs.select(*k).distinct().select(*k, *none)
    found = settled(regions(runs))
    kept = found.where(F.col("area") >= least_area)
    lost = found.where(F.col("area") < least_area).groupBy(*k).agg(F.countDistinct("root").alias("regions_dropped"), F.sum(F.col("x1") - F.col("x0") + 1).alias("region_pixels_dropped"))
    holes = regions(gaps(kept), reach=1)
    at_border = (F.col("y") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("w") - 1)
    outside = F.max(at_border).over(Window.partitionBy(*k, "root"))
    filled = settled(holes.where(F.col("area") < least_area).withColumn("outside", outside).where("not outside"))
    grown = filled.groupBy(*k).agg(F.countDistinct("root").alias("holes_filled"), F.sum(F.col("x1") - F.col("x0") + 1).alias("hole_pixels_filled"))
    report = runs.select(*k).distinct().join(lost, k, "left").join(grown, k, "left").fillna(0)
    return kept.select(*columns).unionByName(filled.select(*columns)), report


def _squares(runs: DataFrame) -> DataFrame:
    """(key, w, sx, sy, runs): the runs in each square of ``SQUARE`` pixels a side and in a border of one pixel around it."""
    k = keys(runs)

    def reached(low: Column, high: Column, size: str) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(low - 1, F.lit(0)) / SQUARE), F.floor(F.least(high + 1, F.col(size) - 1) / SQUARE)))

    p = runs.withColumn("sx", reached(F.col("x0"), F.col("x1"), "w")).withColumn("sy", reached(F.col("y"), F.col("y"), "h"))
    piece = {"y": F.col("y"), "x0": F.greatest("x0", F.col("sx") * SQUARE - 1), "x1": F.least("x1", (F.col("sx") + 1) * SQUARE), "layer": F.col("layer")}
    one = F.struct(*[c.cast("int").alias(n) for n, c in piece.items()])
    return p.groupBy(*k, "w", "sx", "sy").agg(F.collect_list(one).alias("runs")).select(F.struct(*k).alias("key"), "w", "sx", "sy", "runs")


def _edges(square, home, width, x, y, layer):
    """Edges of the pixels that are at home in their squares: (pixel, id, next, corner).

    Arrays of pixels come in, ordered by square. An edge is a side that faces another layer, with its pixel on the right,
    in direction d: 0 right, 1 down, 2 left, 3 up. ``id`` and ``next`` number it and the edge after it by the corner where
    they begin and d; ``corner`` is false where the edge before goes in the same direction.
    """
    first = np.flatnonzero(np.diff(square, prepend=-1))
    column, row = x - np.minimum.reduceat(x, first)[square] + 1, y - np.minimum.reduceat(y, first)[square] + 1
    stride, lines = np.maximum.reduceat(column, first) + 2, np.maximum.reduceat(row, first) + 2
    base = np.cumsum(stride * lines) - stride * lines
    cell = base[square] + row * stride[square] + column
    of = np.full(int((stride * lines).sum()), -1, np.int64)
    of[cell] = layer
    own = np.flatnonzero(home)
    cell, mine, wide = cell[own], layer[own], stride[square[own]]
    one = np.ones(len(own), np.int64)
    steps = (one, wide, -one, -wide)
    out = []
    for d in range(4):
        facing = np.flatnonzero(of[cell + steps[d - 1]] != mine)
        at, its, by, side = cell[facing], mine[facing], steps[d][facing], steps[d - 1][facing]
        ahead, aside = of[at + by] == its, of[at + by + side] == its
        # to the right around the pixel, else along the next one, else to the left around the one beside that
        turn = np.where(~ahead, 1, np.where(~aside, 0, 3))
        dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[d]
        lx, ly = ((0, -1), (1, 0), (0, 1), (-1, 0))[d]
        p = own[facing]
        nx, ny = x[p] + dx * ahead + lx * (turn == 3), y[p] + dy * ahead + ly * (turn == 3)
        straight = (of[at - by] == its) & (of[at - by + side] != its)
        out.append((p, _number(x[p], y[p], d, width[p]), _number(nx, ny, (d + turn) % 4, width[p]), ~straight))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _number(x, y, d, width):
    """An edge's number: the corner where it begins, by rows, times 4, and its direction."""
    d = np.asarray(d)
    return ((y + (d >= 2)) * (width + 1) + x + ((d == 1) | (d == 2))) * 4 + d


def _chained(group, ids, after):
    """Links edges that are in one group: (order, start, head, tail).

    ``order`` lists the edges chain after chain, ``start`` where each begins in it; a cycle begins with its least id.
    Pointers are doubled, as in ``rings``.
    """
    m = len(ids)
    self = np.arange(m)
    sort = np.lexsort((ids, group))
    gap = np.flatnonzero(np.diff(group[sort], prepend=-1))
    top = int(max(ids.max(), after.max())) + 1
    rank = np.zeros(m, np.int64)
    rank[gap] = 1
    flat = (np.cumsum(rank) - 1) * top + ids[sort]  # one number for group and id
    dense = np.empty(m, np.int64)
    dense[sort] = np.cumsum(rank) - 1
    want = dense * top + after
    at = np.minimum(np.searchsorted(flat, want), m - 1)
    following = np.where(flat[at] == want, sort[at], -1)
    end = following < 0
    hop, best = np.where(end, self, following), np.where(end, -1, ids)
    while True:
        far = best[hop]
        if (end[hop] | (far == best)).all():
            break
        best, hop = np.minimum(best, far), hop[hop]
    best = np.minimum(best, best[hop])  # -1 where an end was met, else the cycle's least id
    following[(following >= 0) & (best[following] == ids[following])] = -1
    end = following < 0
    hop, left = np.where(end, self, following), (~end).astype(np.int64)
    while not end[hop].all():
        left, hop = left + left[hop], hop[hop]
    leads = np.ones(m, bool)
    leads[following[~end]] = False
    head = np.flatnonzero(leads)
    tail = hop[head]
    length = left[head] + 1
    start = np.cumsum(length) - length
    chain = np.empty(m, np.int64)
    chain[tail] = np.arange(len(head))
    chain = chain[hop]
    order = np.empty(m, np.int64)
    order[start[chain] + length[chain] - 1 - left] = self
    return order, start, head, tail, best[head] < 0


def pieces(offsets, limit=1 << 17):
    """Ranges of rows whose lists have about ``limit`` entries together, a row at least."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def _chain_batches(batches):
    """The edges of each square linked as far as they stay in it: a row a chain, with the corners it turns at."""
    for batch in batches:
        key, w, sx, sy = (batch.column(i) for i in range(4))
        w, sx, sy = (c.to_numpy() for c in (w, sx, sy))
        lists = batch.column(4)
        offsets = lists.offsets.to_numpy()
        y, x0, x1, layer = (lists.values.field(i).to_numpy().astype(np.int64) for i in range(4))
        for low, high in pieces(offsets):
            n = np.diff(offsets[low : high + 1])
            run = slice(int(offsets[low]), int(offsets[high]))
            square = np.repeat(np.arange(high - low), n)
            long = x1[run] - x0[run] + 1
            of = np.repeat(np.arange(len(long)), long)
            x = np.arange(len(of)) - np.repeat(np.cumsum(long) - long, long) + x0[run][of]
            at, py, index = square[of], y[run][of], layer[run][of]
            home = (x // SQUARE == sx[low:high][at]) & (py // SQUARE == sy[low:high][at])
            pixel, ids, after, corner = _edges(at, home, w[low:high][at], x, py, index)
            if not len(ids):
                continue
            order, start, head, tail, opened = _chained(at[pixel] * (int(index.max()) + 1) + index[pixel], ids, after)
            turns = corner[order]
            count = np.add.reduceat(turns, start, dtype=np.int64)
            owner = pixel[head]
            yield pa.RecordBatch.from_arrays(
                [
                    key.take(pa.array(at[owner] + low)),
                    pa.array(index[owner]),
                    pa.array(w[low:high][at[owner]]),
                    pa.array(ids[head]),
                    pa.array(after[tail], mask=~opened),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids[order][turns])),
                ],
                names=["key", "layer", "w", "id", "next", "corners"],
            )


def rings(corners: DataFrame) -> DataFrame:
    """``corners`` with ``ring``, the least id of their cycle, and ``seq``, the steps from it.

    After r rounds a corner knows the least id of the 2**r corners from it on, how far it is, and
    the corner behind these.
    """
    k = [*keys(corners), "layer"]
    now = settled(corners.withColumns({"best": F.struct("id", F.lit(0).cast("long").alias("off")), "hop": F.col("next"), "closed": F.lit(False)}))
    length = 1
    while not now.where("not closed").isEmpty():
        there = now.select(*k, F.col("id").alias("hop"), F.col("best").alias("far"), F.col("hop").alias("hop2"))
        far = F.struct(F.col("far.id").alias("id"), (F.col("far.off") + length).alias("off"))
        # when every stretch of a cycle has the same least id, it is the cycle's
        same = F.col("best.id") == F.col("far.id")
        now = settled(now.join(there, [*k, "hop"]).select(*k, "w", "id", "next", F.least("best", far).alias("best"), F.col("hop2").alias("hop"), same.alias("closed")))
        length *= 2
    n = F.count("*").over(Window.partitionBy(*k, "best.id"))
    return now.select(*k, "w", "id", "next", F.col("best.id").alias("ring"), ((n - F.col("best.off")) % n).alias("seq"))


def contours(runs: DataFrame) -> DataFrame:
    """(image, layer, ring, xs, ys): the corners of every contour, in order, from the first in reading order.

    Regions have their points clockwise (y grows downwards), holes counter-clockwise. Squares link their own edges;
    chains that leave a square are linked by ``rings``.
    """
    k = [*keys(runs), "layer"]
    squares = _squares(runs)
    kind = squares.schema["key"].dataType.simpleString()
    chains = settled(squares.mapInArrow(_chain_batches, f"key {kind}, layer long, w long, id long, next long, corners array<long>").select("key.*", "layer", "w", "id", "next", "corners"))
    found = chains.where("next is null").select(*k, "w", F.col("id").alias("ring"), "corners")
    parts = chains.where("next is not null")
    if not parts.isEmpty():
        linked = rings(parts.select(*k, "w", "id", "next")).select(*k, "id", "ring", "seq").join(parts, [*k, "id"])
        whole = linked.groupBy(*k, "w", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "corners"))).alias("parts"))
        whole = whole.withColumn("corners", F.flatten(F.transform("parts", lambda p: p["corners"]))).withColumn("ring", F.array_min("corners"))
        at, size = F.array_position("corners", F.col("ring")).cast("int"), F.size("corners")
        turned = F.concat(F.slice("corners", at, size - at + 1), F.slice("corners", F.lit(1), at - 1))
        found = found.unionByName(whole.select(*k, "w", "ring", turned.alias("corners")))
    xs = F.expr("transform(corners, c -> (c div 4) % (w + 1))")
    return found.select(*k, "ring", xs.alias("xs"), F.expr("transform(corners, c -> (c div 4) div (w + 1))").alias("ys"))


def described(rings: DataFrame) -> DataFrame:
    """(image, layer, ring, points, area2, is_hole, path): each contour as an SVG subpath; area2 is twice its signed area."""
    k = [*keys(rings), "layer", "ring"]
    step = """case when i = 0 then concat('M', x, ' ', get(ys, 0)) when get(ys, i) = get(ys, i - 1) then concat('H', x)
      when x = get(xs, i - 1) then concat('V', get(ys, i)) else concat('L', x, ' ', get(ys, i)) end"""
    cross = "x * get(ys, (i + 1) % size(xs)) - get(xs, (i + 1) % size(xs)) * get(ys, i)"
    area = F.expr(f"aggregate(transform(xs, (x, i) -> {cross}), 0L, (a, c) -> a + c)")
    path = F.concat(F.array_join(F.expr(f"transform(xs, (x, i) -> {step})"), ""), F.lit("Z"))
    out = rings.select(*k, F.size("xs").cast("long").alias("points"), area.alias("area2"), path.alias("path"))
    return out.select(*k, "points", "area2", (F.col("area2") < 0).alias("is_hole"), "path")


def _kept(start, x, y, tolerance: float):
    """Which points of some rings Douglas-Peucker keeps; ``start`` is where each ring begins, and the end of the last."""
    first, n = start[:-1], np.diff(start)
    ring = np.repeat(np.arange(len(n)), n)
    kept = np.zeros(len(x), bool)
    away = (x - x[first][ring]) ** 2 + (y - y[first][ring]) ** 2
    cut = _first_greatest(away, np.arange(len(x)), first)[1]
    kept[n[ring] < 4] = True
    kept[first] = kept[cut] = True
    long = n >= 4
    low, high = np.concatenate((first[long], cut[long])), np.concatenate((cut[long], start[1:][long]))
    # a stretch that ends at ``high`` = the next ring's beginning ends at its own ring's first point
    back = np.concatenate((cut[long], first[long]))
    while True:
        open_ = high - low > 1
        low, high, back = low[open_], high[open_], back[open_]
        if not len(low):
            return kept
        size = high - low - 1
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        p = np.arange(len(of)) - begin[of] + low[of] + 1
        ex, ey, px, py = x[back][of] - x[low][of], y[back][of] - y[low][of], x[p] - x[low][of], y[p] - y[low][of]
        cross, square = ex * py - ey * px, ex * ex + ey * ey
        far = np.where(square > 0, cross * cross / np.where(square > 0, square, 1.0), px * px + py * py)
        worst, middle = _first_greatest(far, p, begin)
        split = worst > tolerance * tolerance
        middle = middle[split]
        kept[middle] = True
        low, high, back = np.concatenate((low[split], middle)), np.concatenate((middle, high[split])), np.concatenate((middle, back[split]))


def _first_greatest(values, places, begin):
    """Of every stretch from ``begin`` on: its greatest value, and the first place that has it."""
    most = np.maximum.reduceat(values, begin)
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(values))))
    return most, np.minimum.reduceat(np.where(values == most[of], places, np.iinfo(np.int64).max), begin)


def _neighbours(start):
    """The places before and after each point of some rings."""
    at = np.arange(start[-1])
    before, after = at - 1, at + 1
    before[start[:-1]], after[start[1:] - 1] = start[1:] - 1, start[:-1]
    return before, after


def _fewer(start, keep):
    """Where rings begin when only the points of ``keep`` are left."""
    return np.concatenate(([0], np.cumsum(keep)))[start]


def _simplified_batches(tolerance):
    def run(batches):
        for batch in batches:
            key, xs, ys = (batch.column(i) for i in range(3))
            offsets = xs.offsets.to_numpy()
            for low, high in pieces(offsets):
                own = slice(int(offsets[low]), int(offsets[high]))
                start = (offsets[low : high + 1] - offsets[low]).astype(np.int64)
                x, y = (c.values.to_numpy()[own].astype(float) for c in (xs, ys))
                short = np.repeat(np.diff(start) < 4, np.diff(start))
                keep = _kept(start, x, y, tolerance)
                start, x, y, short = _fewer(start, keep), x[keep], y[keep], short[keep]
                b, a = _neighbours(start)
                keep = short | ((x - x[b]) * (y[a] - y) - (y - y[b]) * (x[a] - x) != 0)
                start, x, y = _fewer(start, keep), x[keep], y[keep]
                left = np.flatnonzero(np.diff(start) >= 3)  # an empty ring has no place among the sums
                point = np.repeat(np.diff(start) >= 3, np.diff(start))
                x, y, n = x[point], y[point], np.diff(start)[left]
                start = np.concatenate(([0], np.cumsum(n)))
                if not len(left):
                    continue
                _, a = _neighbours(start)
                real = np.add.reduceat(x * y[a] - x[a] * y, start[:-1]) != 0
                point = np.repeat(real, n)
                ends = pa.array(np.concatenate(([0], np.cumsum(n[real]))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(c[point].astype(np.int64))) for c in (x, y)]
                yield pa.RecordBatch.from_arrays([key.take(pa.array(left[real] + low)), *lists], names=["key", "xs", "ys"])

    return run


def simplified(rings: DataFrame, tolerance: float) -> DataFrame:
    """The points that Douglas-Peucker keeps of every ring; rings that collapse are gone.

    A ring is cut at its first point and at the one farthest from it (the first of equals). Each round
    splits every open stretch at its farthest point, if that is farther than ``tolerance``.
    """
    own = rings.select(F.struct(*keys(rings), "layer", "ring").alias("key"), "xs", "ys")
    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(_simplified_batches(tolerance), f"key {kind}, xs array<long>, ys array<long>").select("key.*", "xs", "ys")


def traced(pixels: DataFrame, *, least_area: int = 0, tolerance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(contours as ``described``, report) of index maps: rows (image, [frame,] x, y, w, h, idx).

    The report has a row an image and layer: what was dropped and filled, contours and points, and
    contours_dropped, those that simplification collapsed.
    """
    if tolerance is not None and not 0 < tolerance < float("inf"):
        raise ValueError("tolerance must be finite and positive")
    runs = layer_runs(pixels)
    runs, report = without_specks(settled(runs) if least_area > 1 else runs, least_area)
    exact = contours(runs)
    k = [*keys(pixels), "layer"]
    shown = described(simplified(exact, tolerance) if tolerance else exact)
    counts = shown.groupBy(*k).agg(F.count("*").alias("contours"), F.sum("points").alias("points"))
    before = exact.groupBy(*k).agg(F.count("*").alias("all_rings"))
    report = report.join(before, k, "left").join(counts, k, "left").fillna(0)
    return shown, report.withColumn("contours_dropped", F.col("all_rings") - F.col("contours")).drop("all_rings")


def svg(shown: DataFrame, size: DataFrame, palette: Palette, *, exact: bool = True, stroke: float | None = None) -> DataFrame:
    """(image, svg): one document an image; ``size`` has its image, w and h. A layer's contours are one path."""
    k = keys(shown)
    layer = shown.groupBy(*k, "layer").agg(F.array_sort(F.collect_list(F.struct("ring", "path"))).alias("paths"))
    names = F.array(*[F.lit(bytes(c).hex()) for c in palette.colors])
    hexes = F.element_at(names, F.col("layer").cast("int") + 1)
    paint = F.format_string('fill="none" stroke="#%s" stroke-width="' + f"{stroke or 0:g}" + '"', hexes) if stroke else F.format_string('fill="#%s" fill-rule="evenodd"', hexes)
    head = F.format_string('<g id="colour-%d-%s" inkscape:groupmode="layer" inkscape:label="#%s" data-palette-index="%d" ', "layer", hexes, hexes, "layer")
    group = F.concat(head, paint, F.lit('><path d="'), F.array_join(F.transform("paths", lambda p: p["path"]), ""), F.lit('"/></g>\n'))
    body = layer.withColumn("group", group).groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("layer", "group"))).alias("groups"))
    crisp = ' shape-rendering="crispEdges"' if exact else ""
    top = F.format_string(
        '<svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://www.inkscape.org/namespaces/inkscape" width="%d" height="%d" viewBox="0 0 %d %d"' + crisp + ">\n", "w", "h", "w", "h"
    )
    text = F.concat(top, F.coalesce(F.array_join(F.transform("groups", lambda g: g["group"]), ""), F.lit("")), F.lit("</svg>\n"))
    return size.select(*k, "w", "h").distinct().join(body, k, "left").select(*k, text.alias("svg"))


__all__ = ["contours", "described", "gaps", "layer_runs", "regions", "rings", "simplified", "svg", "traced", "without_specks"]
