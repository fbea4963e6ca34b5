"""Searches over a table against every token and word compared."""

import random
import re
from collections import defaultdict

from pixelmill.operators import search


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return row[-1]


def budget(t):
    return 2 if len(t) >= 7 else 1 if len(t) >= 4 else 0


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(queries, entries):
    fields = defaultdict(dict)
    for e, text, weight in entries:
        for w in words(text):
            fields[e][w] = max(weight, fields[e].get(w, 0))
    out = set()
    for q, text in queries:
        tokens, scores, whole = words(text), {}, {}
        for e, own in fields.items():
            total, direct = 0.0, 0
            for t in tokens:
                best = max((k * (1.0 if w == t else 0.7 if w.startswith(t) else 0.4) for w, k in own.items() if t in w), default=0)
                direct += best > 0
                total += best or max((0.4 * k for w, k in own.items() if budget(t) and edits(t, w) <= budget(t)), default=0)
            if total:
                scores[e] = total
                whole[e] = direct == len(tokens)
        found = {e: s for e, s in scores.items() if whole[e]}
        rows = sorted((found or scores).items(), key=lambda x: (-round(x[1], 9), x[0]))
        kind = "found" if found else "nearest"
        out |= {(q, kind, k, e, round(s, 9)) for k, (e, s) in enumerate(rows if found else rows[: search.NEAREST], 1)}
        if not scores:
            out.add((q, "unknown", None, None, None))
    return out


def test_searches(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(60)] + ["échelle", "zebra", "zzz"]
    entries = [(i // 2, " ".join(rng.choices(vocabulary, k=3)), [3.0, 1.0][i % 2]) for i in range(60)] + [(90, None, 1.0), (91, "", 2.0)]

    def typed(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w, w[:k] + "x" + w[k:], w[:k] + w[k + 1 :], w[: max(k - 1, 0)] + "y" + w[k:], w[1:3], w[:4]])

    queries = [(i, rng.choice([" ", "-"]).join(typed(w).upper() for w in rng.choices(vocabulary, k=rng.randint(1, 3)))) for i in range(80)]
    queries += [(100, None), (101, " "), (102, "qqqqqqqqq"), (103, "ECHELLE"), (104, "zebra zebra")]
    got = search.searched(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(entries, "entry_id long, text string, weight double"))
    found = {(r.query_id, r.kind, r["rank"], r.entry_id, None if r.score is None else round(r.score, 9)) for r in got.collect()}
    assert found == plain(queries, entries)
    assert {k for _, k, *_ in found} == {"found", "nearest", "unknown"}


def test_pairs_are_all_within_reach(spark):
    rng = random.Random(18)
    some = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(150)})
    tokens, vocabulary = spark.createDataFrame([(w,) for w in some[::2]], "token string"), spark.createDataFrame([(w,) for w in some], "word string")
    got = {(r.token, r.word) for r in search.typo_pairs(tokens, vocabulary).collect()}
    assert got == {(t, w) for t in some[::2] for w in some if budget(t) and edits(t, w) <= budget(t)}


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "entry_id long, text string, weight double")
    one = spark.createDataFrame([(1, "abc")], "query_id long, text string")
    assert [tuple(r) for r in search.searched(one, none).collect()] == [(1, "unknown", None, None, None)]
    assert search.searched(one.where("false"), none).count() == 0


def test_queries_and_entries_of_the_same_words_are_measured_once(spark):
    """60 copies of each query and entry: the rows that meet on a word stay as few as those of one copy."""
    names = ["large ring", "hot bolt", "blue ring", "old plate"]
    entries = [(i, names[i % 4], 3.0) for i in range(240)]
    queries = [(i, ["large ring", "ht bolt", "bolt", "qqqqqqq"][i % 4]) for i in range(240)]
    seen = []
    plain_settled = search.settled
    search.settled = lambda df: seen.append(plain_settled(df)) or seen[-1]
    try:
        got = search.searched(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(entries, "entry_id long, text string, weight double"))
        found = {(r.query_id, r.kind, r["rank"], r.entry_id, None if r.score is None else round(r.score, 9)) for r in got.collect()}
    finally:
        search.settled = plain_settled
    assert found == plain(queries, entries)
    assert seen[0].count() <= 16
