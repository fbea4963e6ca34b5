"""Palette extraction: a histogram of each image in Spark, then a few entries from its bounded bins.

The histogram has at most 32**3 bins an image, so what one task holds of an image
does not grow with its pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelmill.functions import color
from pixelmill.operators import census
from pixelmill.operators.dithers import Pcg32, stream_of
from pixelmill.plans.rel import SparkRel

GRID = 32
CORNERS = list(np.ndindex(2, 2, 2))
ROUNDS = 64


class Bins:
    """The occupied bins of one image in order: place in the grid, pixels, mean linear light, mean OKLab, mean squared length."""

    def __init__(self, rows: np.ndarray):
        self.at = rows[:, 0].astype(int)
        self.n, self.rgb, self.lab, self.square = rows[:, 1], rows[:, 2:5], rows[:, 5:8], rows[:, 8]

    def distance(self, centre) -> np.ndarray:
        return ((self.lab - centre) ** 2).sum(1)


def median_cut(bins: Bins, entries: int, seed: int) -> list[np.ndarray]:
    """The box of most pixels (the first of equals) that has two bins is split at its weighted median along its longest axis."""
    boxes = [np.arange(len(bins.n))]
    while len(boxes) < entries:
        weight = [bins.n[b].sum() if len(b) > 1 else 0 for b in boxes]
        k = int(np.argmax(weight))
        if not weight[k]:
            break
        b = boxes[k]
        axis = np.ptp(bins.lab[b], axis=0).argmax()
        b = b[np.lexsort((b, bins.lab[b, axis]))]
        half = min(int(np.searchsorted(np.cumsum(bins.n[b]) * 2, weight[k])) + 1, len(b) - 1)
        boxes[k] = b[:half]
        boxes.append(b[half:])
    return boxes


def wu(bins: Bins, entries: int, seed: int) -> list[np.ndarray]:
    """Boxes of the grid, cut where the two parts' summed squared means are greatest; the box of most variance is next.

    Only planes of the grid that have bins are laid out: the others would add nothing to any sum.
    """
    used = [np.unique(a, return_inverse=True) for a in np.unravel_index(bins.at, (GRID,) * 3)]
    place, whole_grid = np.stack([own for _, own in used]), [len(planes) for planes, _ in used]
    sums = np.zeros((5, *(n + 1 for n in whole_grid)))
    sums[(slice(None), *(place + 1))] = np.concatenate(([bins.n], (bins.lab * bins.n[:, None]).T, [bins.square * bins.n]))
    for axis in (1, 2, 3):
        np.cumsum(sums, axis=axis, out=sums)

    def inside(low, high):
        """Sums over a box, or over boxes, a column each, where an edge is a slice of planes."""
        total = 0.0
        for corner in CORNERS:
            x, y, z = (h if c else lo for c, lo, h in zip(corner, low, high, strict=True))
            total = total + (-1) ** (3 - sum(corner)) * sums[:, x, y, z].reshape(5, -1)
        return total

    def variance(box):
        n, *m, square = inside(*box)[:, 0]
        return square - sum(v * v for v in m) / n if n > 1 else 0.0

    def cut(box):
        low, high = box
        whole, best = inside(low, high), None
        for axis in range(3):
            if high[axis] - low[axis] < 2:
                continue
            planes = slice(low[axis] + 1, high[axis])
            part = inside(low, [planes if k == axis else h for k, h in enumerate(high)])
            rest = whole - part
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (part[1:4] ** 2).sum(0) / part[0] + (rest[1:4] ** 2).sum(0) / rest[0]
            score[(part[0] <= 0) | (rest[0] <= 0)] = -1
            k = int(score.argmax())
            if score[k] >= 0 and (best is None or score[k] > best[0]):
                best = score[k], axis, planes.start + k
        if best is None:
            return None
        _, axis, plane = best
        return (low, [plane if k == axis else v for k, v in enumerate(high)]), ([plane if k == axis else v for k, v in enumerate(low)], high)

    boxes, priority, k = [([0] * 3, whole_grid)], [0.0], 0
    while len(boxes) < entries:
        parts = cut(boxes[k])
        if parts:
            boxes[k] = parts[0]
            boxes.append(parts[1])
            priority[k] = variance(parts[0])
            priority.append(variance(parts[1]))
        else:
            priority[k] = 0.0
        k = int(np.argmax(priority))
        if priority[k] <= 0:
            break
    return [np.flatnonzero(np.all([(place[a] >= lo[a]) & (place[a] < hi[a]) for a in range(3)], axis=0)) for lo, hi in boxes]


def _drawn(weights: np.ndarray, rng: Pcg32) -> int | None:
    """A place, drawn in proportion to the weights."""
    upto = np.cumsum(weights)
    return int(np.searchsorted(upto, rng.next_f32() * upto[-1], "right")) if upto[-1] > 0 else None


def k_means(bins: Bins, entries: int, seed: int) -> list[np.ndarray]:
    """Seeded k-means++, then Lloyd's rounds; a centre without bins moves to the bin that fits worst."""
    rng = Pcg32(seed, stream_of("palette-kmeans-init"))
    centres = [bins.lab[_drawn(bins.n, rng)]]
    away = bins.distance(centres[0])
    while len(centres) < entries and (k := _drawn(bins.n * away, rng)) is not None:
        centres.append(bins.lab[k])
        away = np.minimum(away, bins.distance(centres[-1]))
    centres, own = np.array(centres), None

    def nearest():
        return np.stack([bins.distance(c) for c in centres]).argmin(0)

    for _ in range(ROUNDS):
        new = nearest()
        if own is not None and np.array_equal(new, own):
            break
        own = new
        weight = np.bincount(own, bins.n, len(centres))
        for axis in range(3):
            total = np.bincount(own, bins.n * bins.lab[:, axis], len(centres))
            centres[weight > 0, axis] = total[weight > 0] / weight[weight > 0]
        cost = ((bins.lab - centres[own]) ** 2).sum(1) * bins.n
        for k in np.flatnonzero(weight == 0):
            worst = int(cost.argmax())
            centres[k], cost[worst] = bins.lab[worst], -1
    own = nearest()
    return [np.flatnonzero(own == k) for k in range(len(centres)) if (own == k).any()]


METHODS = {"median-cut": median_cut, "wu": wu, "k-means": k_means}


def entries_of(rows: np.ndarray, entries: int, method: str, seed: int) -> np.ndarray:
    """(entries, 3): the linear means of an image's parts, in the method's order."""
    bins = Bins(rows)
    return np.array([np.average(bins.rgb[b], axis=0, weights=bins.n[b]) for b in METHODS[method](bins, entries, seed)])


def extract(rel: SparkRel, entries: int = 4, method: str = "median-cut", seed: int = 0) -> SparkRel:
    """(image_id, entry, r, g, b): up to ``entries`` colours of each image. Alpha takes no part."""
    rows = census.histogram(rel, GRID, moments=True).df
    rows = rows.select("image_id", F.array(*[F.col(c).cast("double") for c in rows.columns[1:]]).alias("v"))
    rows = rows.groupBy("image_id").agg(F.flatten(F.array_sort(F.collect_list("v"))).alias("bins"))

    def run(batches):
        for batch in batches:
            found = [entries_of(v.values.to_numpy().reshape(-1, 9), entries, method, seed) for v in batch.column(1)]
            size = [len(f) for f in found]
            rgb = np.concatenate(found) if found else np.zeros((0, 3))
            entry = np.concatenate([np.arange(k) for k in size]) if size else np.zeros(0, int)
            image = np.repeat(batch.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(image), pa.array(entry), *map(pa.array, rgb.T)], names=["image_id", "entry", "r", "g", "b"])

    return SparkRel(rows.mapInArrow(run, "image_id long, entry long, r double, g double, b double"))


def populations(rel: SparkRel, palettes: SparkRel) -> SparkRel:
    """(image_id, entry, r, g, b, pixels): how many pixels of its image each entry is nearest to (the first of equals)."""
    lab = color.oklab(palettes, ("l", "a", "o")).df
    own = lab.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("entry", "l", "a", "o"))).alias("entries"))
    pixels = color.oklab(rel, ("l", "a", "o")).df.select("image_id", "l", "a", "o").join(own, "image_id")
    away = "transform(entries, e -> struct(pow(e.l - l, 2) + pow(e.a - a, 2) + pow(e.o - o, 2) as d, e.entry as entry))"
    counts = pixels.select("image_id", F.expr(f"array_min({away}).entry").alias("entry")).groupBy("image_id", "entry").agg(F.count("*").alias("pixels"))
    out = palettes.df.join(counts, ["image_id", "entry"], "left")
    return SparkRel(out.withColumn("pixels", F.coalesce("pixels", F.lit(0))))
