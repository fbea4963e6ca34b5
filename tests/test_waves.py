"""Distance fields against every seed of the image, on several sizes and frames, and what the pattern does with them."""

import math
import random

import pytest

from pixelmill.operators import waves
from pixelmill.operators.context import Context
from pixelmill.operators.registry import apply
from pixelmill.plans.rel import Spark, SparkRel

SIZES = {(0, 0): (23, 17), (0, 1): (23, 17), (1, 0): (40, 9), (2, 0): (1, 1), (3, 0): (12, 12), (4, 0): (31, 33)}
COLUMNS = ["image_id", "frame", "x", "y", "w", "h", "r", "g", "b", "a"]


def masks():
    rng = random.Random(9)
    out = {}
    for (i, f), (w, h) in SIZES.items():
        spots = [(rng.random() * w, rng.random() * h, 1 + rng.random() * 5) for _ in range(4)]
        out[i, f] = {(x, y): 1.0 if i == 3 or any((x - a) ** 2 + (y - b) ** 2 < r * r for a, b, r in spots) else 0.0 for x in range(w) for y in range(h)}
    return out


@pytest.fixture(scope="module")
def rel(spark):
    rows = [(i, f, x, y, *SIZES[i, f], v, v, v, v) for (i, f), m in masks().items() for (x, y), v in m.items()]
    return Spark(spark, "").values(COLUMNS, rows)


def test_distance_field(rel):
    found = {}
    for r in waves.distance_field(waves.subject(rel, "alpha", 0.5, False, 0.0)).df.collect():
        found[r.image_id, r.frame, r.x, r.y] = (r.fd, r.gx, r.gy)
    assert len(found) == sum(w * h for w, h in SIZES.values())
    for (i, f), m in masks().items():
        seeds = [(x, y) for (x, y), v in m.items() if any(m.get((x + dx, y + dy), v) != v for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))]
        for (x, y), v in m.items():
            fd, gx, gy = found[i, f, x, y]
            if not seeds:
                assert (fd, gx, gy) == ((-1 if v else 1) * waves.FAR, 0.0, 0.0)
                continue
            d = min(math.dist((x, y), s) for s in seeds)
            assert abs(abs(fd) - d) < 1e-9 and (fd <= 0 if v else fd >= 0)
            assert abs(math.hypot(gx, gy) - (d > 0)) < 1e-9
            if d:  # the gradient leads out of the subject: to the nearest seed from inside, away from it outside
                sx, sy = x + gx * d * (1 if v else -1), y + gy * d * (1 if v else -1)
                assert (round(sx), round(sy)) in seeds


def test_nearest_seed_is_the_first_of_equals(spark):
    """Scattered seeds with many ties, by comparing all pairs, and without rounds: few jobs."""
    rng = random.Random(1)
    w, h = 37, 90
    seeds = {(rng.randrange(w), rng.randrange(h)) for _ in range(60)}
    df = spark.createDataFrame([(0, 0, x, y, w, h, int((x, y) in seeds)) for x in range(w) for y in range(h)], "image_id long, frame long, x long, y long, w long, h long, seed long")
    spark.sparkContext.setJobGroup("seeded", "")
    try:
        found = {(r.x, r.y): r.near for r in waves._seeded(SparkRel(df.repartition(3))).df.collect()}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("seeded")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for x in range(w):
        for y in range(h):
            assert found[x, y] == min(((sx - x) ** 2 + (sy - y) ** 2, sy * 65536 + sx) for sx, sy in seeds)[1]


def test_smoothing_repeats_the_edges(rel):
    """A box of radius 3 over a mask whose borders go on: few specks are left, and a flat image stays flat."""
    found = waves.subject(rel, "alpha", 0.5, False, 3.0).df.collect()
    by = {(r.image_id, r.frame, r.x, r.y): r.inside for r in found}
    for (i, f), m in masks().items():
        w, h = SIZES[i, f]
        for x, y in m:
            box = [m[min(max(x + dx, 0), w - 1), min(max(y + dy, 0), h - 1)] for dx in range(-3, 4) for dy in range(-3, 4)]
            assert abs(sum(box) / 49 - 0.5) < 1e-9 or by[i, f, x, y] == int(sum(box) / 49 >= 0.5)


def test_shadow_lies_behind_the_subject(rel, spark):
    """With full strength and a long wave, pixels that a subject hides from the source have no ink."""
    w = h = 21
    rows = [(0, 0, x, y, w, h, v, v, v, 1.0) for x in range(w) for y in range(h) for v in [1.0 if 8 <= x <= 12 and 8 <= y <= 12 else 0.0]]
    one = Spark(spark, "").values(COLUMNS, rows)
    params = {"sourceKind": "line", "sourceX": 0.0, "sourceAngle": 0.25, "mode": "shadow", "strength": 1.0, "wavelength": 3.0, "thickness": 3.0, "falloff": 4.0, "amplitude": 4.0, "maskSmoothing": 0.0}
    ink = {(r.x, r.y): r.idx for r in apply(one, "wave-field", params, Context(one)).df.collect()}
    assert len(ink) == w * h
    assert {ink[x, 10] for x in range(13, 19)} == {0}  # and behind it
    assert {ink[x, y] for x in range(9, 13) for y in range(9, 12)} == {0}  # ground within the subject
    assert any(ink[x, 1] == 3 for x in range(13, 21))
