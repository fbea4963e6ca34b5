"""Benchmark decontamination by latent semantic retrieval.

1. Every document becomes its word hashes (32 bits), written once. Document
   frequencies of ``features`` hashed words are counted over all documents.
2. A randomised SVD of TF-IDF passages gives ``rank`` latent directions. Every word
   of every document stands in one passage, and every passage is fitted: first
   their sums with random signs, in ``SKETCH`` times as many columns as the range
   has, then one power iteration, from which Nystroem's formula takes the
   directions. Both run in Spark; only the features x columns sums, whose size is
   fixed, meet at the driver. Every passage is then indexed with the basis.
3. Each benchmark item is held against all passages of its own length, in blocks
   of items. Passages start every ``SEGMENT`` words and are as many segments long as
   the item (short items: one more), so that some passage contains most of any copy
   and little else. Those with cosine of
   ``cosine`` or more (short items: a little less) are candidates. So is every passage
   that holds enough words of the item's rarer ones: without them no check can
   succeed, so this second way misses nothing that the check accepts.
4. A candidate passage, with a segment on either side, is checked word by word: the
   longest common subsequence with the item covers ``verbatim`` of it, or for a
   paraphrase ``paraphrase`` of it together with the item's answer (its last
   sentence, of which ``verbatim`` must stand there in order).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, blocks, mix64, text_buffer, words

SEGMENT = 8
#: Items of fewer words make up less of any passage, so their cosine may be lower by SHORTFALL.
SHORT_ITEM, SHORTFALL = 24, 0.05
OVERSAMPLE = 16
#: Columns of the sketch for each column of the range that is taken from it.
SKETCH = 2
PASSAGE = 48
BLOCK = 1_500_000
ITEMS_AT_ONCE = 2048
#: So few that the latent sums of a block stay in a core's cache.
TOKENS_AT_ONCE = 25_000


def _tokens(batches):
    for batch in batches:
        data, at = text_buffer(batch.column(1))
        out = []
        for i, j in blocks(at, BLOCK):
            w, o = words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            raw = (w & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "tokens"])


def _token_batches(batch, column: int, limit: int = 200_000):
    """(first row, tokens, offsets) of rows of a batch, a limited number of tokens at once."""
    data, at = text_buffer(batch.column(column))
    for i, j in blocks(at, 4 * limit):
        yield i, np.frombuffer(data[at[i] : at[j]].tobytes(), np.uint32), (at[i : j + 1] - at[i]) // 4


def _frequencies(features: int):
    def run(batches):
        df, docs = np.zeros(features, np.int64), 0
        for batch in batches:
            for _, t, o in _token_batches(batch, 0):
                row = np.repeat(np.arange(len(o) - 1), np.diff(o))
                df += np.bincount(np.unique(row * features + t % features) % features, minlength=features)
                docs += len(o) - 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(features), -1]), pa.array([*df.tolist(), docs])], names=["feature", "n"])

    return run


def _passages(o: np.ndarray) -> np.ndarray:
    """The offsets of the passages of documents: each document in equal parts of about PASSAGE words, none left over."""
    n = np.diff(o)
    parts = np.maximum((n + PASSAGE // 2) // PASSAGE, n > 0)
    row = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(o[row] + k * n[row] // parts[row], o[-1])


def _weighted(t, o, idf):
    """TF-IDF of passages, scaled to length 1: (passage, feature, weight) in order, and how far each passage's entries go."""
    features = len(idf)
    row = np.repeat(np.arange(len(o) - 1), np.diff(o))
    key, count = np.unique(row * features + t % features, return_counts=True)
    row, feature = np.divmod(key, features)
    weight = count * idf[feature]
    norm = np.sqrt(np.bincount(row, weight * weight, len(o) - 1))
    return row, feature, weight / np.maximum(norm, 1e-9)[row], np.searchsorted(row, np.arange(len(o)))


#: Rows of a product that are added up as one.
STRIPE = 32
#: Passages that are multiplied at once, over the features they have.
PASSAGES_AT_ONCE = 32


def _stripes(out: np.ndarray) -> pa.RecordBatch:
    parts = [out[i : i + STRIPE].astype(np.float32).tobytes() for i in range(0, len(out), STRIPE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=["stripe", "part"])


def _sketch(idf: np.ndarray, width: int):
    """Passages A -> A.T @ S, where S gives each passage one of ``width`` columns and a sign; a partial sum a partition."""

    def run(batches):
        out = np.zeros(len(idf) * width)
        for batch in batches:
            for _, t, o in _token_batches(batch, 0):
                o = _passages(o)
                if len(o) > 1:
                    row, feature, weight, _ = _weighted(t, o, idf)
                    h = mix64(t[o[:-1]].astype(np.uint64) << np.uint64(32) | t[o[1:] - 1])
                    column, sign = (h % np.uint64(width)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)
                    out += np.bincount(feature * width + column[row], weight * sign[row], len(out))
        yield _stripes(out.reshape(-1, width))

    return run


def _gram_product(idf: np.ndarray, basis: np.ndarray):
    """Passages A -> A.T @ (A @ basis), one partial sum a partition, in stripes of rows."""

    def run(batches):
        out = np.zeros(basis.shape, np.float32)
        place = np.zeros(len(idf), np.int64)
        for batch in batches:
            for _, t, o in _token_batches(batch, 0):
                o = _passages(o)
                row, feature, weight, upto = _weighted(t, o, idf)
                for i in range(0, len(o) - 1, PASSAGES_AT_ONCE):
                    j = min(i + PASSAGES_AT_ONCE, len(o) - 1)
                    k = slice(upto[i], upto[j])
                    there = np.zeros(len(idf), bool)
                    there[feature[k]] = True
                    kinds = np.flatnonzero(there)
                    place[kinds] = np.arange(len(kinds))
                    a = np.zeros((j - i, len(kinds)), np.float32)
                    a[row[k] - i, place[feature[k]]] = weight[k]
                    out[kinds] += a.T @ (a @ basis[kinds])
        yield _stripes(out)

    return run


def _added(rows: pa.Table) -> pa.Table:
    """The partial sums of one stripe -> their sum."""
    total = np.sum([np.frombuffer(x.as_buffer(), np.float32) for x in rows["part"]], axis=0, dtype=np.float32)
    return pa.table({"stripe": rows["stripe"][:1], "part": pa.array([total.tobytes()], pa.binary())})


def latent_basis(tokens: DataFrame, *, features: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, rank): a word's weights in the latent directions, scaled to equal variance; and the words' weights.

    Every word of every document counts. Fewer directions where the passages have fewer, none where no word tells them apart.
    """
    counts = {r["feature"]: r["n"] for r in tokens.select("tokens").mapInArrow(_frequencies(features), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    n = counts.get(-1, 0)
    df = np.array([counts.get(f, 0) for f in range(features)], float)
    idf = np.log((n + 1) / (df + 1)) ** 2
    width = rank + OVERSAMPLE

    def added(run, columns):
        parts = tokens.select("tokens").mapInArrow(run, "stripe int, part binary")
        out = np.zeros((features, columns))
        for r in parts.groupBy("stripe").applyInArrow(_added, "stripe int, part binary").collect():
            out[r["stripe"] * STRIPE : (r["stripe"] + 1) * STRIPE] = np.frombuffer(r["part"], np.float32).reshape(-1, columns)
        return out

    q = np.linalg.svd(added(_sketch(idf, SKETCH * width), SKETCH * width), full_matrices=False)[0][:, :width]
    return _directions(q, added(_gram_product(idf, q.astype(np.float32)), width), rank) * idf[:, None].astype(np.float32), idf


def _directions(q: np.ndarray, product: np.ndarray, rank: int) -> np.ndarray:
    """q, A.T A q -> the first eigenvectors of A.T A over their singular values, by Nystroem's formula."""
    small = q.T @ product
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    kept = values > max(values.max(), 1e-9) * 1e-6
    if not kept.any():
        return np.zeros((len(q), 0), np.float32)
    left, singular, _ = np.linalg.svd(product @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    top = singular[:rank] > singular[0] * 1e-3
    return (left[:, :rank][:, top] / singular[:rank][top]).astype(np.float32)


def word_masks(words_: list[int]) -> dict[int, int]:
    """Where each word stands, as bits."""
    at: dict[int, int] = {}
    for i, w in enumerate(words_):
        at[w] = at.get(w, 0) | 1 << i
    return at


def common_subsequence(a: list[int], b: list[int], at: dict[int, int] | None = None) -> int:
    """The length of the longest common subsequence, by bit vectors over ``a`` (``at``: its word_masks)."""
    at = word_masks(a) if at is None else at
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = v & at.get(w, 0)
        if m:
            v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


class Shared:
    """An upper bound of common subsequences: how many of an item's words stand in a passage at all."""

    CHUNK = 20_000

    def __init__(self, lists: list[np.ndarray]):
        kinds = [np.unique(t) for t in lists]
        # repeats of a word in the item count as found
        self.repeats = np.array([len(t) - len(k) for t, k in zip(lists, kinds, strict=True)])
        item = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds])
        place = np.concatenate([np.arange(len(k)) for k in kinds])
        pair = item.astype(np.uint64) << np.uint64(32) | np.concatenate(kinds)
        o = np.argsort(pair)
        self.pairs, self.place = pair[o], place[o]
        self.parts = int(place.max(initial=0)) // 64 + 1

    def bound(self, t: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = self.repeats[item]
        for i in range(0, len(item), self.CHUNK):
            k = slice(i, i + self.CHUNK)
            at = low[k][:, None] + np.arange((high[k] - low[k]).max())
            inside = at < high[k][:, None]
            pair = item[k].astype(np.uint64)[:, None] << np.uint64(32) | t[np.minimum(at, len(t) - 1)]
            found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = inside & (self.pairs[found] == pair)
            place = self.place[found]
            for part in range(self.parts):
                bit = np.where(hit & (place // 64 == part), np.uint64(1) << (place % 64).astype(np.uint64), np.uint64(0))
                out[k] += np.bitwise_count(np.bitwise_or.reduce(bit, axis=1))
        return out


class Rarer:
    """Finds the passages that share enough words with an item for the check to succeed.

    The check needs ``c`` of an item's words. The ``c // 2`` commonest places are left
    out; of the rest at least c - c // 2 are in any passage that succeeds.
    """

    def __init__(self, lists: list[np.ndarray], width: np.ndarray, weights: np.ndarray, paraphrase: float):
        c = np.array([int(np.ceil(paraphrase * len(t) - 1e-9)) for t in lists])
        self.need = np.maximum(c - c // 2, 1)
        self.width = width
        kept = [np.unique(t[np.argsort(-weights[t % len(weights)], kind="stable")][: len(t) - k // 2]) for t, k in zip(lists, c, strict=True)]
        word, item = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(x) for x in kept])
        o = np.argsort(word, kind="stable")
        self.item = item[o]
        self.words, first = np.unique(word[o], return_index=True)
        self.bounds = np.append(first, len(o))

    def passages(self, t: np.ndarray, o: np.ndarray) -> np.ndarray:
        """(document, item, first segment) of the passages of some documents."""
        at = np.minimum(np.searchsorted(self.words, t), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == t)
        at = at[hit]
        count = self.bounds[at + 1] - self.bounds[at]
        entry = np.arange(count.sum()) + np.repeat(self.bounds[at] - np.cumsum(count) + count, count)
        key = np.sort(self.item[entry] * len(t) + np.repeat(hit, count))
        item, place = np.divmod(key, max(len(t), 1))
        last = np.arange(len(key)) + self.need[item] - 1
        first = np.flatnonzero(last < len(key))
        last = last[first]
        w = self.width[item[first]]
        near = (item[last] == item[first]) & (place[last] - place[first] < SEGMENT * (w + 2))
        first, last, w = first[near], last[near], w[near]
        doc = np.searchsorted(o, place[first], "right") - 1
        own = place[last] < o[doc + 1]
        first, last, w, doc = first[own], last[own], w[own], doc[own]
        n = o[doc + 1] - o[doc]
        low = np.maximum((place[last] - o[doc] - SEGMENT * (w + 1)) // SEGMENT + 1, 0)
        high = np.minimum((place[first] - o[doc]) // SEGMENT + 1, np.maximum(-(-n // SEGMENT) - w, 0))
        number = np.maximum(high - low + 1, 0)
        s = np.arange(number.sum()) + np.repeat(low - np.cumsum(number) + number, number)
        return np.stack([np.repeat(doc, number), np.repeat(item[first], number), s], 1)


def _near(t, o, begin, basis, vectors, width, least):
    """(document, item, first segment) of the passages with a cosine of ``least`` or more to an item as wide.

    ``begin`` counts segments. The last row of ``basis`` stands for no word.
    """
    features = len(basis) - 1
    segments = np.diff(begin)
    row = np.repeat(np.arange(len(segments)), segments)
    at = o[row] + SEGMENT * (np.arange(begin[-1]) - begin[row])
    place = at[:, None] + np.arange(SEGMENT)
    word = np.where(place < o[row + 1][:, None], (t % features)[np.minimum(place, len(t) - 1)], features)
    sums = basis[word[:, 0]]
    for k in range(1, SEGMENT):
        sums += basis[word[:, k]]
    upto = np.concatenate((np.zeros((1, basis.shape[1]), np.float32), np.cumsum(sums, axis=0)))
    out = []
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        starts = np.flatnonzero(row[: max(len(row) - w + 1, 0)] == row[w - 1 :]) if len(row) >= w else np.zeros(0, np.int64)
        short = begin[:-1][(segments < w) & (segments > 0)]  # a short text is one passage
        for s, p in ((starts, (upto[w:] - upto[:-w])[starts] if len(starts) else None), (short, upto[begin[row[short] + 1]] - upto[short])):
            if len(s):
                size = np.maximum(np.sqrt(np.einsum("ij,ij->i", p, p)), np.float32(1e-9))
                k, i = np.nonzero((p @ vectors[own].T) / size[:, None] >= least[own])
                out.append(np.stack([row[s[k]], own[i], s[k] - begin[row[s[k]]]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _search(items, basis, weights, cosine: float, verbatim: float, paraphrase: float):
    """items: (item_id, tokens, answer tokens)."""
    features = len(basis)
    padded = np.concatenate((basis, np.zeros((1, basis.shape[1]), np.float32)))
    vectors = np.stack([basis[t % features].sum(0) for _, t, _ in items])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    width = np.array([-(-len(t) // SEGMENT) + (len(t) < SHORT_ITEM) for _, t, _ in items])
    least = np.array([cosine - SHORTFALL * (len(t) < SHORT_ITEM) for _, t, _ in items], np.float32)
    needed = np.array([paraphrase * len(t) - 1e-9 for _, t, _ in items])
    lists = [(t.tolist(), a.tolist()) for _, t, a in items]
    masks = [(word_masks(t), word_masks(a)) for t, a in lists]
    shared = Shared([t for _, t, _ in items])
    rarer = Rarer([t for _, t, _ in items], width, weights, paraphrase)

    def check(item: int, there: list[int]):
        """(share, answer found) of an item that stands there, else None."""
        (words_, answer), (at, answer_at) = lists[item], masks[item]
        share = common_subsequence(words_, there, at) / len(words_)
        if share < paraphrase:
            return None
        answered = common_subsequence(answer, there, answer_at) >= verbatim * len(answer)
        return (share, answered) if share >= verbatim or answered else None

    def cosine_of(tokens: np.ndarray, item: int) -> float:
        p = padded[tokens % features].sum(0, dtype=np.float64)
        return float(p @ vectors[item] / max(np.linalg.norm(p), 1e-9))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            found = []
            for first, t, o in _token_batches(batch, 1, TOKENS_AT_ONCE):
                begin = np.concatenate(([0], np.cumsum(-(-np.diff(o) // SEGMENT))))
                if not begin[-1]:
                    continue
                doc, item, segment = np.concatenate((_near(t, o, begin, padded, vectors, width, least), rarer.passages(t, o))).T
                pair, segment = np.divmod(np.unique((doc * len(items) + item) << 32 | segment), 2**32)
                doc, item = np.divmod(pair, len(items))
                low = o[doc] + SEGMENT * segment
                high = np.minimum(low + SEGMENT * width[item], o[doc + 1])
                wide_low, wide_high = np.maximum(low - SEGMENT, o[doc]), np.minimum(high + SEGMENT, o[doc + 1])
                best: dict[tuple[int, int], tuple] = {}
                for k in np.flatnonzero(shared.bound(t, item, wide_low, wide_high) >= needed[item]).tolist():
                    got = check(int(item[k]), t[wide_low[k] : wide_high[k]].tolist())
                    pair = first + int(doc[k]), int(item[k])
                    if got and got > best.get(pair, ((0.0, False),))[0]:
                        best[pair] = got, t[low[k] : high[k]]
                found += [(d, i, cosine_of(passage, i), *got) for (d, i), (got, passage) in best.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([items[f[1]][0] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.float64()),
                    pa.array([f[3] for f in found], pa.float64()),
                    pa.array([f[4] for f in found], pa.bool_()),
                ],
                names=["doc_id", "item_id", "cosine", "lcs_share", "answer_found"],
            )

    return run


FOUND = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"


def hashed(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    w, o = words(np.frombuffer(b"".join(raw), np.uint8), at)
    w = (w & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [w[a:b] for a, b in zip(o[:-1], o[1:], strict=True)]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    features: int = 8192,
    rank: int = 96,
    cosine: float = 0.52,
    verbatim: float = 0.8,
    paraphrase: float = 0.6,
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found): the items each document contains.

    A document without a match has no row. Null or empty texts and items match
    nothing. Repeated rows give repeated results. ``benchmark`` has item_id and
    text; its items are searched in blocks of about ``ITEMS_AT_ONCE``.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = Table(own.mapInArrow(_tokens, "doc_id long, tokens binary")).df
    basis, weights = latent_basis(tokens, features=features, rank=rank)
    asked = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, -(-asked.count() // ITEMS_AT_ONCE))
    out = spark.createDataFrame([], FOUND)
    for part in range(parts):  # one block of items at a time at the driver
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        texts = [r["text"] for r in rows]
        answers = [t.rstrip(" .!?\n").replace("!", ".").replace("?", ".").replace("\n", ".").rsplit(".", 1)[-1] for t in texts]
        items = [
            (r["item_id"], t, a if len(a) else t)
            for r, t, a in zip(rows, hashed(texts), hashed(answers), strict=True)
            if len(t)
        ]
        if items:
            found = tokens.mapInArrow(_search(items, basis, weights, cosine, verbatim, paraphrase), FOUND)
            out = out.unionAll(found if parts == 1 else Table(found).df)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found; a null id is an id like any other.

    Rows are told apart by a 64-bit hash of id and text. Each travels as one struct, so no
    column name of the input clashes.
    """
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("_row_key"), F.col(text_col).alias("_text"), F.struct(*docs.columns).alias("_row"))
    found = contaminated(keyed, benchmark, id_col="_row_key", text_col="_text", **how).select(F.col("doc_id").alias("_found")).distinct()
    kept = keyed.join(found, F.col("_row_key") == F.col("_found"), "left_anti")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
