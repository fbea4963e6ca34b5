"""A quality classifier from weak labels.

Overlapping heuristics vote bad (0), good (1) or abstain (2) on every document.
Two questions are asked: is the text of poor quality, and is it toxic. For each,
the votes of all documents are counted by pattern (at most 3**labellers patterns),
and expectation-maximisation over that table estimates every labeller's chances of
each vote in either class. The posteriors then label documents, and a linear scorer
over hashed words and shapes learns them, so it also judges texts on which the
heuristics are silent.

The scorer is fitted on about ``sample`` documents, half from either side, chosen
by hash (documented bound), and corrected for that choice; counts, votes and scores
cover all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, blocks, mix64, text_buffer, words

FEATURES = 1 << 15
BLOCK = 1_500_000
BAD, GOOD, NONE = 0, 1, 2
#: Features of a whole text, behind those of its words: shapes and votes.
WHOLE = 6 + 9 + 6
#: The feature of an abstention; its weight is 0.
SILENT = 0
#: No labeller is believed to call more than this share of good texts bad.
FALSE_ALARMS = 0.02
#: Insults in two overlapping lists; fixed values.
INSULTS = (
    "idiot moron stupid dumb fool loser clown imbecile dimwit retard jerk",
    "trash scum disgusting worthless pathetic garbage vermin filth filthy ugly hate",
)


def _hash_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


def measures(data: np.ndarray, at: np.ndarray):
    """Per text: counts by byte kind, its words and their offsets."""

    def count(mask):
        run = np.concatenate(([0], np.cumsum(mask)))
        return run[at[1:]] - run[at[:-1]]

    kind = np.zeros(256, np.uint8)
    for bit, chars in enumerate((b"#*$%&<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"|", b"abcdefghijklmnopqrstuvwxyz")):
        for c in chars:
            kind[c] |= 1 << bit
    k = kind[data]
    w, o = words(data, at)
    return [count(k & (1 << b) > 0) for b in range(5)], w, o


def _distinct(w: np.ndarray, o: np.ndarray):
    """(hashed feature, text) once each, sorted by text; and each text's number of distinct words."""
    doc = np.repeat(np.arange(len(o) - 1), np.diff(o))
    both = np.unique(doc * FEATURES + (w % np.uint64(FEATURES)).astype(np.int64))
    return both % FEATURES, both // FEATURES


def _band(value, bad, good, enough):
    """A vote: bad from ``bad`` on, good up to ``good`` (whichever side), else none."""
    if bad > good:
        vote = np.where(value >= bad, BAD, np.where(value <= good, GOOD, NONE))
    else:
        vote = np.where(value <= bad, BAD, np.where(value >= good, GOOD, NONE))
    return np.where(enough, vote, NONE)


def votes(data: np.ndarray, at: np.ndarray, keywords: np.ndarray):
    """(quality votes, toxicity votes, words' features, their texts, shapes): labellers in columns."""
    (symbols, upper, bangs, pipes, lower), w, o = measures(data, at)
    n = np.maximum(np.diff(o), 1)
    some = np.diff(o) > 0
    feature, text = _distinct(w, o)
    distinct = np.bincount(text, minlength=len(n))
    cap = upper / np.maximum(upper + lower, 1)
    doc = np.repeat(np.arange(len(n)), np.diff(o))
    stutter = np.bincount(doc[1:][(w[1:] == w[:-1]) & (doc[1:] == doc[:-1])], minlength=len(n)) / n
    shapes = np.stack([symbols / n, cap, bangs / n, pipes / n, 1 - distinct / n, stutter], 1)
    quality = np.stack(
        [
            _band(symbols / n, 0.2, 0.02, some),
            _band((symbols + pipes) / n, 0.25, 0.03, some),
            _band(cap, 0.4, 0.15, upper + lower > 20),
            _band(bangs / n, 0.2, 0.05, some),
            _band(cap + bangs / n, 0.5, 0.2, some),
            _band(distinct / n, 0.15, 0.35, np.diff(o) >= 30),
            _band(pipes / n, 0.3, 0.02, some),
            _band(stutter, 0.1, 0.02, some),
            _band(stutter + 1 - distinct / n, 0.95, 0.7, np.diff(o) >= 20),
        ],
        1,
    )
    lists = [np.unique(_hash_words(x)) for x in INSULTS]
    hits = [np.bincount(doc[np.isin(w, x)], minlength=len(n)) for x in lists]
    learned = np.bincount(doc[np.isin(w, keywords)], minlength=len(n))
    toxic = np.stack(
        [
            np.where(hits[0] > 0, BAD, GOOD),
            np.where(hits[1] > 0, BAD, GOOD),
            np.where(hits[0] + hits[1] >= 2, BAD, np.where(hits[0] + hits[1] == 0, GOOD, NONE)),
            np.where(learned > 0, BAD, GOOD),
            np.where(learned >= 2, BAD, np.where(learned == 0, GOOD, NONE)),
            np.where((hits[0] + hits[1]) / n > 0.004, BAD, np.where(hits[0] + hits[1] == 0, GOOD, NONE)),
        ],
        1,
    )
    return quality, toxic, feature, text, shapes, np.diff(o) < 20


def _labelled_words(batches):
    """(word, toxic) once for each labelled document with the word."""
    for batch in batches:
        data, at = text_buffer(batch.column(0))
        toxic = batch.column(1).to_numpy()
        for i, j in blocks(at, BLOCK):
            w, o = words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            doc = np.repeat(np.arange(j - i), np.diff(o))
            order = np.lexsort((doc, w))
            w, doc = w[order], doc[order]
            once = np.ones(len(w), bool)
            once[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(w[once].view(np.int64)), pa.array(toxic[i:j][doc[once]].astype(np.int64))], names=["word", "toxic"])


def toxic_keywords(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, rows: int = 40_000) -> np.ndarray:
    """Hashes of words that stand in at least 5 labelled documents, 90 % of them toxic.

    Read from about ``rows`` labelled documents, chosen by hash, which bounds the words too.
    """
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1_000_000)) < F.lit(min(1.0, rows / max(n, 1)) * 1_000_000))
    own = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    texts = own.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("text", "toxic")
    seen = texts.mapInArrow(_labelled_words, "word long, toxic long").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    found = seen.where("bad >= 5 and bad >= 0.9 * n").select("word").toArrow()
    return np.sort(found["word"].to_numpy().astype(np.int64)).view(np.uint64)


def _read(shared):
    def run(batches):
        keywords = shared.value
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            q, t, raw = [], [], []
            for i, j in blocks(at, BLOCK):
                quality, toxic, feature, text, shapes, few = votes(data[at[i] : at[j]], at[i : j + 1] - at[i], keywords)
                q.append(quality @ 3 ** np.arange(quality.shape[1]))
                t.append(toxic @ 3 ** np.arange(toxic.shape[1]))
                # shapes in eighths and the votes themselves are hashed features too
                kinds = np.concatenate((np.minimum((shapes * 8).astype(np.int64), 7), quality + 8, toxic + 8), 1)
                shape = 1 + mix64((kinds + 16 * np.arange(WHOLE)).astype(np.uint64)) % np.uint64(FEATURES - 1)
                shape[kinds == 8 + NONE] = SILENT
                shape[:, :6][few] = SILENT
                cut = np.searchsorted(text, np.arange(j - i + 1))
                f = feature.astype(np.uint16)
                for k in range(j - i):
                    raw.append(f[cut[k] : cut[k + 1]].tobytes() + shape[k].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(q) if q else np.zeros(0, np.int64)), pa.array(np.concatenate(t) if t else np.zeros(0, np.int64)), pa.array(raw, pa.binary())],
                names=["doc_id", "quality", "toxic", "features"],
            )

    return run


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int, steps: int = 200):
    """(chance of the bad class for each pattern, chances [labeller, class, vote] given that it votes, share of bad)."""
    vote = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
    ballots = [(vote == v).astype(float) for v in range(3)]
    p = np.where(ballots[BAD].sum(1) > 0, 0.9, 0.02)
    for _ in range(steps):
        share = np.clip((counts * p).sum() / counts.sum(), 1e-4, 1 - 1e-4)
        chance = np.empty((labellers, 2, 2))
        for v in (BAD, GOOD):
            chance[:, 0, v] = (counts * p) @ ballots[v] + 1.0
            chance[:, 1, v] = (counts * (1 - p)) @ ballots[v] + 1.0
        chance /= chance.sum(2, keepdims=True)
        chance[:, 1, BAD] = np.minimum(chance[:, 1, BAD], FALSE_ALARMS)
        chance[:, 1, GOOD] = 1 - chance[:, 1, BAD]
        log = np.log(chance)
        side = [np.log(s) + sum(ballots[v] @ log[:, k, v] for v in (BAD, GOOD)) for k, s in ((0, share), (1, 1 - share))]
        new = 1 / (1 + np.exp(np.clip(side[1] - side[0], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, chance, share


def values(size: np.ndarray) -> np.ndarray:
    """The value of each feature of texts with ``size`` features: words share length 1, the last WHOLE have 1 each."""
    end = np.cumsum(size)
    out = np.repeat(1 / np.sqrt(np.maximum(size - WHOLE, 1)), size)
    out[(end[:, None] - 1 - np.arange(WHOLE)).ravel()] = 1.0
    return out


def fit_linear(features: list[np.ndarray], target: np.ndarray, weight: np.ndarray, steps: int = 120, ridge: float = 1e-3):
    """Logistic regression over present features, by accelerated gradient with Adagrad scaling."""
    flat = np.concatenate(features).astype(np.int64)
    size = np.array([len(f) for f in features])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    w, bias = np.zeros(FEATURES), 0.0
    squares, bias_square = np.full(FEATURES, 1e-8), 1e-8
    value = values(size)
    for _ in range(steps):
        z = np.add.reduceat(w[flat] * value, first) + bias
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target)
        gw = np.bincount(flat, np.repeat(g, size) * value, FEATURES) + ridge * w
        squares += gw * gw
        bias_square += g.sum() ** 2
        w -= 0.5 * gw / np.sqrt(squares)
        w[SILENT] = 0
        bias -= 0.5 * g.sum() / np.sqrt(bias_square)
    return w, bias


def _apply(shared):
    def run(batches):
        models = shared.value
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            flat = np.frombuffer(data.tobytes(), np.uint16)
            at = at // 2
            value = values(np.diff(at))
            out = []
            for w, bias in models:
                z = np.add.reduceat(w[flat] * value, at[:-1]) + bias if len(flat) else np.zeros(0)
                out.append(pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["doc_id", "p_bad", "p_toxic"])

    return run


LABELLERS = {"quality": 9, "toxic": 6}


def classify(docs: DataFrame, labels: DataFrame | None = None, *, id_col="doc_id", text_col="text", sample: int = 8000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_bad, p_toxic, score, kept): one row for each row of ``docs``.

    With ``labels`` (doc_id, toxic) two more toxicity labellers look for words that
    marked toxic documents there; without, they find none.

    score is the chance that a text is neither poor nor toxic; it is kept if both
    chances are below ``threshold``. Null and empty texts are read as texts without
    words. Repeated rows get equal results. Other columns are not read. Without
    documents: no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keywords = np.zeros(0, np.uint64) if labels is None else toxic_keywords(docs, labels, id_col=id_col, text_col=text_col)
    words_of_toxic = docs.sparkSession.sparkContext.broadcast(keywords)
    read = Table(own.mapInArrow(_read(words_of_toxic), "doc_id long, quality long, toxic long, features binary")).df
    models = []
    for question, labellers in LABELLERS.items():
        seen = read.groupBy(question).count().toArrow()
        patterns, counts = seen[question].to_numpy(), seen["count"].to_numpy().astype(float)
        if not len(patterns):
            models.append((np.zeros(FEATURES), 0.0))
            continue
        p, _, share = expectation_maximisation(patterns, counts, labellers)
        side = {int(k): bool(v >= 0.5) for k, v in zip(patterns, p, strict=True)}
        n_bad = sum(c for k, c in zip(patterns, counts, strict=True) if side[int(k)])
        n_good = counts.sum() - n_bad
        bad = F.col(question).isin([k for k, v in side.items() if v])
        part = F.when(bad, F.lit(min(1.0, sample / 2 / max(n_bad, 1)))).otherwise(F.lit(min(1.0, sample / 2 / max(n_good, 1))))
        chosen = read.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < part * 1_000_000).select(question, "features").toArrow()
        posterior = dict(zip(patterns.tolist(), p.tolist(), strict=True))
        target = np.array([posterior[k] for k in chosen[question].to_pylist()])
        features = [np.frombuffer(f, np.uint16) for f in chosen["features"].to_pylist()]
        got_bad = sum(side[k] for k in chosen[question].to_pylist())
        if not len(features):
            models.append((np.zeros(FEATURES), float(np.log(share / (1 - share)))))
            continue
        # both sides weigh the same while weights are learned, then the intercept returns to the corpus's shares
        even = np.where([side[k] for k in chosen[question].to_pylist()], 0.5 / max(got_bad, 1), 0.5 / max(len(target) - got_bad, 1))
        w, bias = fit_linear(features, target, even * len(target))
        models.append((w, bias + float(np.log(max(n_bad, 1) / max(n_good, 1)) / 2)))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    scored = read.select("doc_id", "features").mapInArrow(_apply(shared), "doc_id long, p_bad double, p_toxic double")
    keep = (F.col("p_bad") < threshold) & (F.col("p_toxic") < threshold)
    return scored.withColumn("score", (1 - F.col("p_bad")) * (1 - F.col("p_toxic"))).withColumn("kept", keep)
