"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order (0 to 3). A byte's code
length comes from the longest context seen in training; where the byte was not
seen after it, an escape is paid (method C: d / (n + d) for d distinct bytes in n)
and the next shorter context is asked, down to a uniform order. Statistics are
frozen after training, so the code length of a text is exact and does not depend
on other texts. The language with the shortest code wins.

Bytes are read as a small alphabet: ASCII letters in lower case, bytes over 127 as
they are, all else as one blank; blanks in a row count once.

Training reads at most about ``docs_per_language`` labelled documents of each
language, chosen by a hash of their id, and whole texts of them. The trees of all
languages are stored sparsely, only the contexts and bytes seen, about 1 MB a
language; no language and no context is left out.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, shared, text_buffer

ORDER = 3
BLOCK = 1_000_000
#: Languages whose code lengths are found at once.
PART = 16
UNKNOWN = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reduced bytes of each text behind ORDER blanks, and the new offsets."""
    f = _FOLD[data]
    keep = np.ones(len(f), bool)
    if len(f):
        keep[1:] = (f[1:] != 32) | (f[:-1] != 32)
        keep[offsets[:-1][offsets[:-1] < len(f)]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    out = np.full(kept[-1] + ORDER * (len(offsets) - 1), 32, np.uint8)
    place = np.arange(kept[-1]) + ORDER * np.repeat(np.arange(1, len(offsets)), np.diff(kept))
    out[place] = f[keep]
    return out, kept + ORDER * np.arange(len(offsets))


def _grams(f: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER before it, as one number; padding left out."""
    x = f.astype(np.uint32)
    code = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    real = np.ones(len(f), bool)
    for p in range(ORDER):
        real[offsets[:-1] + p] = False
    return code[real[ORDER:]]


def _count(batches):
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, at = text_buffer(batch.column(1))
        for i, j in blocks(at, BLOCK):
            f, o = folded(data[at[i] : at[j]], at[i : j + 1] - at[i])
            for lang in sorted(set(langs[i:j])):
                own = [f[o[k] : o[k + 1]] for k in np.flatnonzero(langs[i:j] == lang)]
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in own])))
                code, n = np.unique(_grams(np.concatenate(own), sizes), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"]
                )


class Lists:
    """For some keys, the languages that have them, each with a value."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, value: np.ndarray):
        o = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[o], return_index=True)
        self.bounds = np.append(first, len(o))
        self.lang, self.value = lang[o].astype(np.int32), value[o].astype(np.float32)

    def of(self, asked: np.ndarray):
        """(places in ``asked``, languages, values)."""
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == asked)
        at = at[hit]
        count = self.bounds[at + 1] - self.bounds[at]
        entry = np.arange(count.sum()) + np.repeat(self.bounds[at] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        return np.repeat(hit, count), self.lang[entry], self.value[entry]


@dataclass
class Model:
    langs: list[str]
    uniform: float  # nats of a byte in the uniform order
    #: For each PART of languages and each order: what escapes cost by context, and bytes by context and byte.
    parts: list[list[tuple[Lists, Lists]]]

    def costs(self, part: int, code: np.ndarray) -> np.ndarray:
        """(codes, languages of the part): nats of each code's last byte after the others."""
        number = min(PART, len(self.langs) - part * PART)
        cost = np.full((len(code), number), self.uniform, np.float32)
        for order, (escapes, bytes_) in enumerate(self.parts[part]):
            at, lang, nats = escapes.of((code >> 8) & ((1 << 8 * order) - 1))
            cost[at, lang] += nats
            at, lang, nats = bytes_.of(code & ((1 << 8 * (order + 1)) - 1))
            cost[at, lang] = nats
        return cost

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): nats."""
        f, at = folded(data, offsets)
        code, own = np.unique(_grams(f, at), return_inverse=True)
        code = code.astype(np.int64)
        bounds = at - ORDER * np.arange(len(at))  # without the padding
        full = np.diff(bounds) > 0
        out = np.zeros((len(full), len(self.langs)))
        if full.any():
            for part in range(len(self.parts)):
                nats = self.costs(part, code)[own]
                out[full, part * PART : part * PART + nats.shape[1]] = np.add.reduceat(nats, bounds[:-1][full], axis=0, dtype=np.float64)
        return out


def build(langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """Exact code lengths from counts of (language, four bytes)."""
    seen = np.unique(np.concatenate([np.unique((code >> s) & 255) for s in (24, 16, 8, 0)]))
    parts = []
    for low in range(0, len(langs), PART):
        mine = (lang >= low) & (lang < low + PART)
        l_, c, m = lang[mine].astype(np.int64) - low, code[mine], n[mine]
        tables = []
        for order in range(ORDER + 1):
            bits = 8 * (order + 1)
            key, at = np.unique(l_ << bits | (c & ((1 << bits) - 1)), return_inverse=True)
            count = np.bincount(at, m)
            ctx, of = np.unique(key >> 8, return_inverse=True)
            distinct = np.bincount(of)
            whole = np.log(np.bincount(of, count) + distinct)
            escapes = Lists(ctx & ((1 << (bits - 8)) - 1), ctx >> (bits - 8), whole - np.log(distinct))
            tables.append((escapes, Lists(key & ((1 << bits) - 1), key >> bits, whole[of] - np.log(count))))
        parts.append(tables)
    return Model(langs, float(np.log(len(seen) + 1)), parts)


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2


def train(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", docs_per_language: int = 4000) -> Model | None:
    """The model of the languages in ``docs``; None without a labelled text."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = known.groupBy("lang").count().select("lang", (F.lit(float(docs_per_language)) / F.col("count")).alias("part"))
    chosen = known.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < F.col("part") * 1_000_000)
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    if not got.num_rows:
        return None
    named = got["lang"].combine_chunks().dictionary_encode()
    found = named.dictionary.to_pylist()
    langs = sorted(found)
    lang = np.array([langs.index(x) for x in found])[named.indices.to_numpy()]
    return build(langs, lang, got["code"].to_numpy(), got["n"].to_numpy())


def _score(model_of):
    def run(batches):
        model = pickle.loads(model_of.value)
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for i, j in blocks(at, BLOCK):
                nats = model.code_lengths(data[at[i] : at[j]], at[i : j + 1] - at[i])
                best = nats.argmin(1)
                share = 1 / np.exp(nats.min(1)[:, None] - nats).sum(1)
                own = letters[i:j]
                pred[i:j][own] = np.array(model.langs, object)[best[own]]
                score[i:j][own] = share[own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["key", "text", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, model: Model | None, *, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``key_cols`` with lang_pred and score (the winner's share of the languages' probabilities).

    A null text, one without a letter, or no model at all: ``und`` with score 0.
    Every row gets its own result, from its text alone.
    """
    found = _predicted(docs, model, list(key_cols), text_col)
    return found.select("key.*", "lang_pred", "score")


def _predicted(docs: DataFrame, model: Model | None, key_cols: list[str], text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*key_cols).alias("key"), text.alias("text"), text.rlike("\\p{L}").alias("letters"))
    if model is None:
        return rows.select("key", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    model_of = shared(docs.sparkSession, model)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_score(model_of), f"key {kind}, text string, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, *, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language: not ``und``, and scored ``least_score`` or more.

    Columns pass unchanged; nothing is shuffled.
    """
    others = [c for c in docs.columns if c != text_col]
    found = _predicted(docs, model, others, text_col).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("key")[c].alias(c) for c in docs.columns])
