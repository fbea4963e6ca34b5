"""Personal data: patterns against Python's own matching, the network against plain sums, and held-out spellings."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from pixelmill.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def test_patterns():
    rng = random.Random(8)
    for alphabet in ("a1.@+-() _%\n4é", "@.a", "0123456789.", "4 -1290", "+1 ()-.", "a@b.c+12 4.é🙂"):
        for _ in range(3000):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), text
    for _ in range(300):
        number = pii._card_number(rng) + rng.choice(["", "1", "22"])
        text = f"Xé {number} {rng.choice(['a.b@c.de', '1.2.3.400', '1.2.3.4.5.6.7.8', '+1 (555) 123-4567.', '+1234567', '0009.08.7.255'])}"
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_read_in_linear_time():
    began = time.time()
    for run in ("a", "1", "1.", "@", "a@", "+1", "+1 ", "1-", ".a", " (", "a.a@a"):
        pii.base_spans(run * 200_000)
    assert time.time() - began < 20


def test_gradients():
    rng = np.random.default_rng(3)
    net = pii.Tagger(3)
    x, tags = rng.integers(0, pii.CLASSES, (5, 7)), rng.integers(0, pii.TAGS, (5, 7))
    _, d = net.loss_and_gradients(x, tags)
    for k, g in d.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        a, out = net.p[k], []
        for step in (1e-5, -2e-5):
            a[at] += step
            out.append(net.loss_and_gradients(x, tags)[0])
        a[at] += 1e-5
        assert abs((out[0] - out[1]) / 2e-5 - g[at]) < 1e-5 * max(1, abs(g[at]))


def test_reading_is_the_trained_network_and_the_best_path():
    rng = np.random.default_rng(4)
    net = pii.Tagger(4)
    net.p["tr"] = rng.normal(0, 0.7, net.p["tr"].shape)
    p = net.weights()
    size = np.array([6, 6, 5, 3, 1])
    both = np.zeros((2, 5, 6), np.uint8)
    for j, n in enumerate(size):
        both[0, j, :n] = rng.integers(0, pii.CLASSES, n)
        both[1, j, :n] = both[0, j, :n][::-1]
    e = pii.emissions(p, both, size)
    for shift in (0.0, 1.5, 4.0):  # with more and more windows that hold nothing
        lower = e - np.array([0, *[shift] * 4], np.float32)
        tags = pii.best_paths(p, lower, size)
        for j, n in enumerate(size):
            own = net._emit(net._run(both[:1, j, :n].astype(np.int64))[1])[:, 0]
            assert np.abs(own - e[:n, j]).max() < 1e-4
            best = max(itertools.product(range(pii.TAGS), repeat=n), key=lambda t, j=j: sum(lower[i, j, k] for i, k in enumerate(t)) + sum(p["tr"][a, b] for a, b in zip(t, t[1:], strict=False)))
            assert tags[:n, j].tolist() == list(best) and not tags[n:, j].any()


def _paths_window_by_window(p, e, size):
    """The same search with windows before tags, every tag before every tag kept."""
    steps, n, _ = e.shape
    inside = np.arange(steps)[:, None] < size
    back, score, tags = np.empty((steps, n, pii.TAGS), np.int8), e[0].copy(), np.zeros((steps, n), np.int8)
    for t in range(1, steps):
        whole = score[:, :, None] + p["tr"]
        back[t] = whole.argmax(1)
        score = np.where(inside[t][:, None], whole.max(1) + e[t], score)
    now = score.argmax(1)
    for t in range(steps - 1, -1, -1):
        tags[t] = np.where(inside[t], now, 0)
        if t:
            now = np.where(inside[t], back[t][np.arange(n), now], now)
    return tags


def test_best_paths_equal_a_plain_search_at_less_cost():
    rng = np.random.default_rng(4)
    for n, steps, plain in ((700, 300, False), (90, 40, True), (1, 1, True)):
        e, p = rng.normal(0, 2, (steps, n, pii.TAGS)).astype(np.float32), {"tr": rng.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)}
        if plain:  # many equal scores: the first tag counts
            e, p = np.round(e), {"tr": np.round(p["tr"])}
        size = np.sort(rng.integers(1, steps + 1, n))[::-1]
        spent = {pii.best_paths: [], _paths_window_by_window: []}
        for _ in range(3 if n > 100 else 1):
            found = []
            for way in spent:
                start = time.process_time()
                found.append(way(p, e, size))
                spent[way].append(time.process_time() - start)
            assert np.array_equal(*found)
        if n > 100:
            assert min(spent[pii.best_paths]) < 0.75 * min(spent[_paths_window_by_window]), spent


def test_windows_and_reconciliation():
    for n in (0, 1, 500, 512, 513, 900, 5000):
        starts = pii.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + pii.WINDOW))} == set(range(n))
    assert pii.reconciled([(1, 5, 20), (1, 18, 30), (2, 28, 33), (3, 40, 41), (3, 41, 44), (2, 39, 42)]) == [(1, 5, 30), (3, 40, 44)]
    assert pii.reconciled([(1, 0, 4), (2, 0, 4), (1, 0, 4)]) == [(1, 0, 4)]


SCHEMA = "doc_id long, text string, row string, spans string, kind string"


def texts():
    rng = random.Random(31)
    words = "the outh stre erheti enon ingly thand ofre wasth".split()
    out = []
    for i in range(160):
        line = [" ".join(rng.choices(words, k=rng.randint(20, 120)))]
        if i % 3 == 0:
            line.append(rng.choice(["a.7@mail.example.com", "10.2.30.255", "4111 1111 1111 1111", "+1 (415) 555-2671", "token 88 v1.2.3 2024-01-05"]))
        out.append(". ".join([*line, " ".join(rng.choices(words, k=30))]))
    out += [None, "", " ", "é🙂" * 50, "a@b.c", "x " * 30_000 + "me@home.org" + " y" * 10_000, out[3], out[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i % 50 else None, t, "r", "s", "k") for i, t in enumerate(texts())], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def model(docs):
    return pii.train(docs, steps=500)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1])))


def test_digests(docs, model, spark):
    found = sorted(map(tuple, pii.digests(docs, model).collect()), key=str)
    expect = []
    for i, text in enumerate(texts()):
        base = plain_spans(text or "")
        every = base + pii.added_spans(model, [text or ""], [base])[0]
        counts = [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
        expect.append((i if i % 50 else None, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
    assert found == sorted(expect, key=str)
    none = spark.createDataFrame([], SCHEMA)
    assert pii.digests(none, model).count() == 0


def test_training_copes_with_nothing(spark):
    blank = spark.createDataFrame([(1, None, "r", "s", "k")], SCHEMA)
    assert [r.spans for r in pii.digests(blank, pii.train(blank, steps=3)).collect()] == [""]


def test_other_spellings_are_found(model):
    """Spans in spellings that no pattern has, in texts of their own; and little is found where nothing is."""
    rng = random.Random(77)
    hit = total = 0
    lines = [t for t in texts() if t and len(t) > 300][:100]
    for i in range(400):
        what = pii._written(rng, rng.choice(pii.KINDS), ["erheti", "outh", "stre"])
        text = f"{lines[i % len(lines)][:150]} {what} {lines[(i + 1) % len(lines)][:150]}"
        base = pii.base_spans(text)
        if not base:
            total += 1
            found = pii.added_spans(model, [text], [base])[0]
            hit += any(text[s:e] == what for _, s, e in found)
    assert total > 150 and hit / total > 0.7
    clean = [re.sub(r"[^a-z ]", "", t) for t in lines]
    assert sum(map(len, pii.added_spans(model, clean, [[] for _ in clean]))) <= 1


def test_masked(docs, model):
    found = pii.masked(docs, model)
    assert found.columns == docs.columns and found.count() == len(texts())
    by_text = [r.text for r in found.collect()]
    assert None in by_text and "[EMAIL]" in by_text and not any("me@home.org" in (t or "") for t in by_text)
