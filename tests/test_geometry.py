"""Replication, reduction, sheets and locked swatches against plain Python."""

import random

from pixelmill.operators import geometry, palettes
from pixelmill.plans.rel import SparkRel

SCHEMA = "image_id long, frame long, x long, y long, w long, h long, r double, g double, b double, a double"


def pictures(w, h, frames=3, images=2):
    rng = random.Random(w * 100 + h)
    return [(i, f, x, y, w, h, rng.random(), rng.random(), rng.random(), 1.0) for i in range(images) for f in range(frames) for y in range(h) for x in range(w)]


def collected(rel):
    return rel.df.collect()


def test_reduced_is_the_area_mean(spark):
    w, h, tw, th = 7, 5, 3, 2
    rows = pictures(w, h)
    out = geometry.reduced(SparkRel(spark.createDataFrame(rows, SCHEMA)), str(tw), str(th))
    got = {(r.image_id, r.frame, r.x, r.y): (r.r, r.w, r.h) for r in collected(out)}
    assert len(got) == 6 * tw * th
    for (i, f, x, y), (red, nw, nh) in got.items():
        total = 0.0
        for r in rows:
            if r[:2] == (i, f):
                kx = min(r[2] + 1, (x + 1) * w / tw) - max(r[2], x * w / tw)
                ky = min(r[3] + 1, (y + 1) * h / th) - max(r[3], y * h / th)
                total += r[6] * max(kx, 0) * max(ky, 0)
        assert abs(red - total * tw * th / (w * h)) < 1e-12 and (nw, nh) == (tw, th)


def test_reduced_never_enlarges(spark):
    rows = pictures(3, 2, 1, 1)
    out = geometry.reduced(SparkRel(spark.createDataFrame(rows, SCHEMA)), "w * 4", "0")
    assert {(r.w, r.h) for r in collected(out)} == {(3, 1)} and out.df.count() == 3


def test_sheet_places_every_frame_and_leaves_the_rest_clear(spark):
    rows = pictures(3, 2)
    out = geometry.sprite_sheet(SparkRel(spark.createDataFrame(rows, SCHEMA)), 3, 2, 2)
    got = {(r.image_id, r.x, r.y): r for r in collected(out)}
    assert len(got) == 2 * (3 * 2 * 2) * (2 * 2 * 2) == out.df.count()
    source = {r[:4]: r for r in rows}
    for (i, x, y), r in got.items():
        assert (r.w, r.h) == (12, 8)
        frame = (y // 4) * 2 + x // 6
        expect = source[i, frame, x % 6 // 2, y % 4 // 2][6:] if frame < 3 else (0.0,) * 4
        assert (r.r, r.g, r.b, r.a) == expect
    assert geometry.sheet_grid(5, 0) == (1, 5) and geometry.sheet_grid(2, 9) == (2, 1) and geometry.sheet_grid(5, 3) == (3, 2)


def brute_merge(previous, found):
    total, out, k = sum(locked for _, locked in previous) + len(found), [], 0
    for i in range(max(total, len(previous))):
        if i < len(previous) and previous[i][1]:
            out.append((previous[i][0], None, True))
        elif k < len(found):
            out.append((*found[k], False))
            k += 1
    return out


def test_locked_swatches_hold_their_places(spark):
    rng = random.Random(9)
    for case in range(4):
        previous = [(1000 + k, rng.random() < 0.4) for k in range(rng.randint(0, 7))]
        found = [[(rng.randrange(999), rng.randint(1, 50)) for _ in range(n)] for n in (1, 3, 9)]
        rows = [(i, k, c, n) for i, x in enumerate(found) for k, (c, n) in enumerate(x)]
        rel = SparkRel(spark.createDataFrame(rows, "image_id long, place long, code long, population long"))
        got = collected(palettes.merge_locked(rel, previous))
        for i, x in enumerate(found):
            own = sorted((r for r in got if r.image_id == i), key=lambda r: r.position)
            assert [r.position for r in own] == list(range(len(own)))
            assert [(r.code, r.population, r.locked) for r in own] == brute_merge(previous, x), case
