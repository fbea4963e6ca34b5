"""Product codes against plain Lloyd rounds on Python integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from pixelmill.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, q string, codes string, sums string, error string, of_label string"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = []
    for i, v, label, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [max(-(2**31), min(2**31 - 1, math.floor(4096 * float(np.float32(x))))) for x in v]))
    if not kept:
        return []
    deep = max(1, -(-max(len(q) for *_, q in kept) // parts))
    cut = [[(q + [0] * (deep * parts))[p * deep : (p + 1) * deep] for p in range(parts)] for *_, q in kept]
    by_id = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, np.array(kept[i][2], np.int32).tobytes()))[:entries]
    books = [[list(cut[i][p]) for i in by_id] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(x[p], books[p])[1] for x in cut]
            for k in range(len(books[p])):
                if k in own:
                    members = [x[p] for x, a in zip(cut, own, strict=True) if a == k]
                    books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for (i, label, _), x in zip(kept, cut, strict=True):
        best = [nearest(x[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), error))
    return [(*r, by_label[r[1]], digest) for r in out]


def check(spark, rows):
    given = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(3)
    found = codes.compress(given)
    assert Counter(tuple(r) for r in found.collect()) == Counter(plain(rows))


def vectors(rng, n, wide=16, spread=1.0):
    centres = [[rng.gauss(0, spread) for _ in range(wide)] for _ in range(9)]
    return [[c + rng.gauss(0, 0.1 * spread) for c in rng.choice(centres)] for _ in range(n)]


def test_codes(spark):
    rng = random.Random(5)
    rows = [(1000 - i, v, [0, 1, None][i % 3]) for i, v in enumerate(vectors(rng, 150))]
    rows += [(i, [round(x) / 2 for x in v], 7) for i, v in enumerate(vectors(rng, 80))]  # many ties
    rows += [rows[3]] * 4 + [(rows[5][0], rows[6][1], 1)]  # repeated rows, an id with two vectors
    rows += [(-5, None, 1), (-4, [None] * 16, 1), (-3, [math.nan] * 16, 1), (-2, [1.0] * 15 + [math.inf], None), (None, [0.25] * 16, None)]
    check(spark, rows)


def test_large_short_and_few_vectors(spark):
    rng = random.Random(6)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(rng, 40, spread=5e4))]  # beyond 2**28: Python's integers
    check(spark, rows)
    check(spark, [(i, v[: rng.choice([0, 1, 9, 16])], None) for i, v in enumerate(vectors(rng, 30))])
    check(spark, [(i, v, 1) for i, v in enumerate(vectors(rng, 5))])
    check(spark, [(1, None, 1)])
    none = codes.compress(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    huge = codes.compress(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(r.code for r in huge) == ["0" * 16, "01" * 8] and all(r.error == 0 for r in huge)


def test_bounds_spare_scans():
    """Later rounds look at few groups, and the codes are those of full scans."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (4, 8))
    q = (centres[rng.integers(0, 4, 3000)] + rng.integers(-150, 150, (3000, 8))).reshape(3000, 1, 8)
    books = q[:16].swapaxes(0, 1).copy()
    groups = np.stack([codes.grouped(b, 4) for b in books])
    state, before, scanned = (None, None), None, []
    for _ in range(6):
        step = codes.Round(books, groups, before)
        if before is not None:
            own = np.sqrt(((q[:, 0] - books[0][state[0][:, 0]]) ** 2).sum(1).astype(float))
            scanned.append(float((state[1][:, 0] - step.drift[0] <= own[:, None]).mean()))
        code, error, bound = step.assign(q, *state)
        full = ((q[:, 0, None] - books[0]) ** 2).sum(2)
        assert (code[:, 0] == full.argmin(1)).all() and (error[:, 0] == full.min(1)).all()
        sums = np.zeros((1, 16, 9), object)
        for k in range(16):
            sums[0, k] = [*map(int, q[code[:, 0] == k, 0].sum(0)), int((code[:, 0] == k).sum())]
        state, before, books = (code, bound), books, codes.moved(books, sums)
    assert scanned[-1] < 0.6
