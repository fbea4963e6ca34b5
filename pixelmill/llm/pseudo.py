"""Document scores by masked pseudo-likelihood.

Every token is predicted from ``SIDE`` tokens on either side of it, never from
itself; a document's score is the sum of those conditional log-probabilities.

The words of the corpus are counted exactly, each by its 64-bit hash; this table is
as large as the vocabulary, stays distributed and is joined by word. For the
network, words fall into ``buckets`` and these into classes: the most frequent ones
are a class of their own, the rest share classes of equal mass. The network predicts
the class (position-wise embeddings of the neighbours' classes, summed, tanh,
softmax); within a class a word has its exact share of the corpus:

    log p(token | neighbours) = log p(class | neighbours) + log (count of the word / count of its class)

The counts of the ``known_words`` most frequent words (a documented bound) travel
with the job; the other words of a document, each once, are joined to the table.

Training covers all tokens of all documents: every partition starts from the same
weights, runs Adagrad over its texts once, and the results are averaged, weighted
by tokens; ``rounds`` repeats this. So scores depend a little on how rows are
partitioned. The network's weights have a fixed size.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, blocks, mix64, shared, text_buffer, words

SIDE = 2
OFFSETS = (*range(-SIDE, 0), *range(1, SIDE + 1))
BLOCK = 1_500_000
BATCH = 2048
#: Parts of the weights that are averaged on their own.
STRIPES = 16


def _token_blocks(batch, column: int):
    """(first row, word hashes, offsets)."""
    data, at = text_buffer(batch.column(column))
    for i, j in blocks(at, BLOCK):
        yield i, *words(data[at[i] : at[j]], at[i : j + 1] - at[i])


def _count(batches):
    for batch in batches:
        for _, t, _ in _token_blocks(batch, 0):
            w, n = np.unique(t, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])


@dataclass
class Classes:
    of: np.ndarray  # bucket -> class
    log_mass: np.ndarray  # class -> log of its count
    number: int

    @classmethod
    def from_counts(cls, counts: np.ndarray, number: int, own: int) -> Classes:
        rank = np.argsort(-counts, kind="stable")
        of = np.zeros(len(counts), np.uint8)
        of[rank[:own]] = np.arange(own)
        rest = rank[own:]
        mass = np.cumsum(counts[rest] + 0.5)
        of[rest] = own + np.minimum((mass - counts[rest] - 0.5) * (number - own) // mass[-1], number - own - 1).astype(int)
        return cls(of, np.log(np.maximum(np.bincount(of, counts, number), 1)), number)

    def of_words(self, w: np.ndarray) -> np.ndarray:
        return self.of[(w % np.uint64(len(self.of))).astype(np.int64)]


class Network:
    """Weights as one flat vector, with views for its parts."""

    def __init__(self, classes: int, width: int, flat: np.ndarray | None = None):
        self.classes, self.width = classes, width
        sizes = [(len(OFFSETS), classes + 1, width), (width,), (width, classes), (classes,)]
        ends = np.cumsum([int(np.prod(s)) for s in sizes])
        if flat is None:
            rng = np.random.default_rng(1)
            flat = np.zeros(ends[-1], np.float32)
            flat[: ends[0]] = rng.normal(0, 0.3, ends[0])
            flat[ends[1] : ends[2]] = rng.normal(0, 0.1, ends[2] - ends[1])
        self.flat = flat
        self.parts = [flat[e - int(np.prod(s)) : e].reshape(s) for s, e in zip(sizes, ends, strict=True)]

    def hidden(self, near: np.ndarray) -> np.ndarray:
        embed, bias = self.parts[:2]
        return np.tanh(sum(embed[k][near[:, k]] for k in range(len(OFFSETS))) + bias)

    def log_probs(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        z = self.hidden(near) @ self.parts[2] + self.parts[3]
        top = z.max(1, keepdims=True)
        return z[np.arange(len(z)), target] - top[:, 0] - np.log(np.exp(z - top).sum(1))

    def gradient(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = Network(self.classes, self.width, np.zeros_like(self.flat))
        h = self.hidden(near)
        z = h @ self.parts[2] + self.parts[3]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), target] -= 1
        p /= len(p)
        out.parts[2][:] = h.T @ p
        out.parts[3][:] = p.sum(0)
        dh = (p @ self.parts[2].T) * (1 - h * h)
        out.parts[1][:] = dh.sum(0)
        for k in range(len(OFFSETS)):
            order = np.argsort(near[:, k], kind="stable")
            seen, first = np.unique(near[order, k], return_index=True)
            out.parts[0][k][seen] = np.add.reduceat(dh[order], first, axis=0)
        return out.flat


def neighbours(c: np.ndarray, offsets: np.ndarray, outside: int) -> np.ndarray:
    """The classes around each token; beyond its text's ends ``outside``."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    low, high = offsets[:-1][doc], offsets[1:][doc]
    place = np.arange(len(c))
    near = np.empty((len(c), len(OFFSETS)), np.uint8)
    for k, d in enumerate(OFFSETS):
        at = place + d
        inside = (at >= low) & (at < high)
        near[:, k] = np.where(inside, c[np.clip(at, 0, max(len(c) - 1, 0))], outside)
    return near


def _train(classes: Classes, width: int, start: np.ndarray, rate: float):
    def run(batches):
        net = Network(classes.number, width, start.copy())
        squares = np.full_like(net.flat, 1e-6)
        tokens = 0
        rng = np.random.default_rng(2)
        for batch in batches:
            for _, t, o in _token_blocks(batch, 0):
                c = classes.of_words(t)
                near = neighbours(c, o, classes.number)
                order = rng.permutation(len(c))
                for i in range(0, len(c), BATCH):
                    own = order[i : i + BATCH]
                    g = net.gradient(near[own], c[own])
                    squares += g * g
                    net.flat -= rate * g / np.sqrt(squares)
                tokens += len(c)
        if tokens:
            parts = [x.tobytes() for x in np.array_split(net.flat, STRIPES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(STRIPES), pa.int32()), pa.array([tokens] * STRIPES), pa.array(parts)], names=["stripe", "tokens", "weights"]
            )

    return run


def _averaged(rows: pa.Table) -> pa.Table:
    """One stripe's weights of all partitions -> their mean by tokens."""
    total, tokens = 0.0, 0
    for n, w in zip(rows["tokens"].to_pylist(), rows["weights"], strict=True):
        total, tokens = total + n * np.frombuffer(w.as_buffer(), np.float32).astype(float), tokens + n
    mean = pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())
    return pa.table({"stripe": rows["stripe"][:1], "tokens": pa.array([tokens], pa.int64()), "weights": mean})


PARTS = "doc_id long, h int, w long, times int, n_tokens long, part double"


def _score(model_of, width: int):
    """(doc_id, h, text) -> a row with n_tokens and the network's and known words' part of log_prob for each text, and
    one with n_tokens -1 for each of its other words, to which times * log(count of the word) is due."""

    def run(batches):
        classes, flat, known, log_count = pickle.loads(model_of.value)
        net = Network(classes.number, width, flat)
        for batch in batches:
            for first, t, o in _token_blocks(batch, 2):
                texts = len(o) - 1
                c = classes.of_words(t)
                near = neighbours(c, o, classes.number)
                logs = np.empty(len(c), np.float64)
                for i in range(0, len(c), 4 * BATCH):
                    s = slice(i, i + 4 * BATCH)
                    logs[s] = net.log_probs(near[s], c[s])
                logs -= classes.log_mass[c]
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                is_known = known[at] == t
                logs += np.where(is_known, log_count[at], 0.0)
                upto = np.concatenate(([0.0], np.cumsum(logs)))
                rest = np.flatnonzero(~is_known)
                text, word = np.searchsorted(o, rest, "right") - 1, t[rest]
                order = np.lexsort((word, text))
                text, word = text[order], word[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(new)))
                text, word = text[new], word[new]
                ids, h = (batch.column(k).slice(first, texts).take(pa.array(np.concatenate((np.arange(texts), text)))) for k in (0, 1))
                own = mix64(np.arange(first, first + texts, dtype=np.uint64) ^ mix64(t[np.minimum(o[:-1], len(t) - 1)] if len(t) else np.zeros(texts, np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        h,
                        pa.array(np.concatenate((own, word)).view(np.int64)),
                        pa.array(np.concatenate((np.zeros(texts, np.int32), times.astype(np.int32)))),
                        pa.array(np.concatenate((np.diff(o), np.full(len(word), -1)))),
                        pa.array(np.concatenate((upto[o[1:]] - upto[o[:-1]], np.zeros(len(word))))),
                    ],
                    names=[x.split()[0] for x in PARTS.split(", ")],
                )

    return run


def fit(docs: DataFrame, *, text_col="text", buckets=65536, number=128, own=96, width=24, rounds=1, rate=0.05, known_words=20_000):
    """(classes, weights, the hashes of the most frequent words in order, the logs of their counts, the table of all counts)."""
    texts = docs.select(F.col(text_col).alias("text"))
    table = Table(texts.mapInArrow(_count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    by_bucket = table.df.groupBy(F.col("w").bitwiseAND(F.lit(buckets - 1)).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets)  # a power of two, so that the low bits are the rest
    counts[by_bucket["bucket"].to_numpy()] = by_bucket["n"].to_numpy()
    classes = Classes.from_counts(counts, number, own)
    most = table.df.orderBy(F.desc("n"), "w").limit(known_words).toArrow()
    known, n = most["w"].to_numpy().view(np.uint64), most["n"].to_numpy()
    o = np.argsort(known)
    known, log_count = (known[o], np.log(n[o])) if len(o) else (np.zeros(1, np.uint64), np.zeros(1))
    flat = Network(number, width).flat
    for _ in range(rounds):
        parts = texts.mapInArrow(_train(classes, width, flat, rate), "stripe int, tokens long, weights binary")
        mean = parts.groupBy("stripe").applyInArrow(_averaged, "stripe int, tokens long, weights binary").collect()
        if mean:
            flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(mean, key=lambda r: r["stripe"])])
    return classes, flat, known, log_count, table


def score(docs: DataFrame, *, id_col="doc_id", text_col="text", width=24, **how) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob): one row for each row of ``docs``.

    log_prob is in nats, summed over all tokens of the whole text. A null text or
    one without words has no tokens, log_prob 0 and a null mean. Repeated rows get
    equal results. Other columns are not read. Empty input: no rows.
    """
    *model, table = fit(docs, text_col=text_col, width=width, **how)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("h"), text.alias("text"))
    parts = own.mapInArrow(_score(shared(docs.sparkSession, tuple(model)), width), PARTS)
    parts = parts.join(table.df, "w", "left")
    logs = F.sum(F.col("part") + F.when(F.col("n_tokens") < 0, F.col("times") * F.ln(F.coalesce("n", F.lit(1)))).otherwise(0.0))
    rows = F.count(F.when(F.col("n_tokens") >= 0, 1))
    found = parts.groupBy("doc_id", "h").agg(rows.alias("rows"), F.sum(F.greatest("n_tokens", F.lit(0))).alias("tokens"), logs.alias("logs"))
    # repeated rows were added up
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    found = found.select("doc_id", (F.col("tokens") / F.col("rows")).cast("long").alias("n_tokens"), (F.col("logs") / F.col("rows")).alias("log_prob"))
    return found.withColumn("mean_log_prob", F.col("log_prob") / F.nullif("n_tokens", F.lit(0)))
