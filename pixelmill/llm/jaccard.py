"""Near copies by the Jaccard similarity of their word shingles, candidates by SimHash, then MinHash, links verified exactly.

1. Each text becomes the set of its ``k``-word shingles (64-bit hashes; words as in
   SimHash: ASCII white space apart, A-Z read as a-z). ``BANDS`` x ``ROWS`` minima of
   it give one list key a band. A pair of similarity 0.8 shares none of the lists
   with chance (1 - 0.8 ** ROWS) ** BANDS = 0.0002.
2. Texts of equal words are one node, so copies never meet in a list. The first links
   come by SimHash: the majority bits of the shingle hashes, and the index of
   ``simhash`` over fingerprints up to ``DISTANCE`` bits apart, which misses none.
   64 bits do not tell 0.8 apart, so MinHash serves what these links leave. Within a list
   the low bytes of all minima estimate similarities. Pairs are asked for in rounds
   of falling estimates (``ESTIMATES``). In the first, nodes take turns as leader and
   go with each member still waiting, so a list of n gives less than n pairs. No round
   gives pairs that earlier links have joined. Later ones give all those of nodes
   outside the list's largest component, each from the first list it shares (told by
   32 bits of the list keys, so one is missed with chance 1e-8). A pair of similarity 0.8 is estimated below
   the last value with chance 1e-5, the less the more alike it is. A list also holds how many shingles a set has and,
   for each of ``PARITIES`` residues of their hashes, whether an odd number has it. Two sets differ in at least as
   many shingles as parities, so a pair whose parities differ too often for ``least`` is left out, and none that would link.
3. Every such pair is held to the exact similarity of the sets. Pairs of
   ``least`` or more link; groups are the components of these links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Rolling, Table, blocks, mix64, text_buffer
from .components import connected_components
from .simhash import link_fingerprints, majority

BANDS, ROWS = 28, 6
#: Minima of a text: those of the list keys.
MINIMA = BANDS * ROWS
ESTIMATES = (0.81, 0.7)
#: Bits in which fingerprints of SimHash may differ.
DISTANCE = 6
#: Bits of a set's parities.
PARITIES = 1024
#: Where parities begin in the bytes of a list's member, behind the low bytes and half keys; the set's size follows them.
ODD = MINIMA + 4 * BANDS
BLOCK = 500_000
#: Stands for a null id, behind all others.
LAST_ID = 2**63 - 1
_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 2**64, MINIMA, np.uint64)
_TIMES = _RNG.integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True


def shingles(data: np.ndarray, at: np.ndarray, k: int):
    """(hash of all words in order, shingle hashes, offsets) of some texts; k words or fewer are one shingle."""
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = Rolling(_LOWER[data]).spans(start, end) if len(start) else np.zeros(0, np.uint64)
    o = np.searchsorted(start, at)
    n = np.diff(o)
    # all words in order: a polynomial in their hashes
    row = np.repeat(np.arange(len(n)), n)
    place = (np.arange(len(word)) - o[:-1][row]).astype(np.uint64)
    whole = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        whole[full] = np.add.reduceat(mix64(word ^ mix64(place + np.uint64(1))), o[:-1][full])
    whole[full] = mix64(whole[full] ^ n[full].astype(np.uint64))
    number = np.where(n > k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate(([0], np.cumsum(number)))
    row = np.repeat(np.arange(len(n)), number)
    first = o[:-1][row] + np.arange(out[-1]) - out[:-1][row]
    gram = np.zeros(out[-1], np.uint64)
    for j in range(k):
        w = word[np.minimum(first + j, len(word) - 1)] if len(word) else gram
        gram = mix64(gram + w + np.uint64(j))
    short = n[row] < k
    gram[short] = whole[row[short]]
    return whole, gram, out


def _blocks(column, k: int):
    data, at = text_buffer(column)
    for i, j in blocks(at, BLOCK):
        yield i, j, *shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], k)


def _parities(gram: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Each set's parities and, in four bytes, its size."""
    sets = [np.unique(gram[a:b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
    size = np.array([len(s) for s in sets], np.uint32)
    place = np.repeat(np.arange(len(sets)) * PARITIES, size) + (np.concatenate(sets) % np.uint64(PARITIES)).astype(np.int64)
    odd = np.bincount(place, minlength=len(sets) * PARITIES).astype(np.uint8) & 1
    return np.hstack([np.packbits(odd.reshape(len(sets), PARITIES), axis=1), size.view(np.uint8).reshape(-1, 4)])


def may_link(low: np.ndarray, i: int, near: np.ndarray, least: float) -> np.ndarray:
    """Which of the members ``near`` can have similarity ``least`` to one: their sets differ in no fewer shingles than parities."""
    end = ODD + PARITIES // 8
    apart = np.bitwise_count((low[near, ODD:end] ^ low[i, ODD:end]).view(np.uint64)).sum(1, dtype=np.int64)
    size = np.ascontiguousarray(low[np.append(near, i), end:]).view(np.uint32)[:, 0].astype(np.int64)
    both = size[:-1] + size[-1]
    return both - apart >= (least - 1e-9) * (both + apart)


def _signatures(k: int):
    """(id, text) -> (id, t, keys, low, fp): the text's hash, its list keys, the low bytes of its minima, half of each key and its set's parities and size, its fingerprint."""

    def run(batches):
        for batch in batches:
            whole_, keys, low, fp = [], [], [], []
            for _, _, whole, gram, o in _blocks(batch.column(1), k):
                least = np.zeros((len(whole), MINIMA), np.uint64)
                full = np.diff(o) > 0
                if full.any():
                    at = o[:-1][full]
                    for m in range(MINIMA):
                        x = (gram ^ _XOR[m]) * _TIMES[m]
                        least[full, m] = np.minimum.reduceat(x, at)
                least = mix64(least)
                key = np.zeros((len(whole), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix64(key + least[:, r : BANDS * ROWS : ROWS])
                whole_.append(whole)
                keys.append(key)
                fp.append(majority(gram, np.diff(o)))
                low += [x.tobytes() for x in np.hstack([least.astype(np.uint8), key.astype(np.uint32).view(np.uint8), _parities(gram, o)])]
            n = batch.num_rows
            flat = np.concatenate(keys).reshape(-1).view(np.int64) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(flat))
            t, fp = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (whole_, fp))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t), lists, pa.array(low, pa.binary()), pa.array(fp)], names=["id", "t", "keys", "low", "fp"])

    return run


def _shares(low: np.ndarray, i: int) -> np.ndarray:
    """Estimated similarities of all members of a list to one."""
    return np.concatenate([(low[p : p + 100_000, :MINIMA] == low[i, :MINIMA]).mean(1) for p in range(0, len(low), 100_000)])


def _met(low: np.ndarray, i: int, near: np.ndarray, band: int) -> np.ndarray:
    """Which of the members ``near`` share a list of an earlier band with one."""
    upto = MINIMA + 4 * band
    same = low[near, MINIMA:upto] == low[i, MINIMA:upto]
    return same.reshape(len(near), band, 4).all(2).any(1)


def led_pairs(t: np.ndarray, component: np.ndarray, low: np.ndarray, least: float, able=None) -> tuple[np.ndarray, np.ndarray]:
    """Leaders and the members of other components that follow each, of which ``able(leader, members)`` holds."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    waiting = np.ones(len(t), bool)
    for i in range(len(t)):
        if waiting[i]:
            waiting[i] = False
            near = waiting & (_shares(low, i) >= least)
            waiting &= ~near
            near = np.flatnonzero(near & (component != component[i]))
            near = near[able(i, near)] if able else near
            a.append(np.full(len(near), t[i]))
            b.append(t[near])
    return np.concatenate(a), np.concatenate(b)


def open_pairs(t: np.ndarray, component: np.ndarray, low: np.ndarray, least: float, band: int, able=None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of different components estimated at ``least`` or more that no list of an earlier band has, of which ``able(one, members)`` holds."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kinds, of, size = np.unique(component, return_inverse=True, return_counts=True)
    if len(kinds) > 1:
        inside = of == size.argmax()
        for i in np.flatnonzero(~inside):
            near = np.flatnonzero((of != of[i]) & (inside | (np.arange(len(t)) > i)) & (_shares(low, i) >= least))
            near = near[able(i, near)] if able else near
            near = near[~_met(low, i, near, band)]
            a.append(np.full(len(near), t[i]))
            b.append(t[near])
    return np.concatenate(a), np.concatenate(b)


def _candidates(estimate: float, first: bool, least: float):
    """(k, t, component, band, low) sorted by k -> (a, b): pairs estimated at ``estimate`` that may have similarity ``least``."""

    def solve(key, t, component, band, low):
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
            if j - i > 1:
                turn = i + np.argsort(mix64(t[i:j].view(np.uint64)))
                own = low[turn]
                able = lambda i, near, own=own: may_link(own, i, near, least)
                if first:
                    x, y = led_pairs(t[turn], component[turn], own, estimate, able)
                else:
                    x, y = open_pairs(t[turn], component[turn], own, estimate, int(band[i]), able)
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, t, component, band = (batch.column(k).to_numpy() for k in range(4))
            columns = (key, t, component, band, text_buffer(batch.column(4))[0].reshape(len(key), -1))
            if held and held[-1][0][-1] == key[-1]:
                held.append(columns)
                continue
            open_at = int(np.searchsorted(key, key[-1]))
            done = [*held, tuple(x[:open_at] for x in columns)]
            if sum(len(x[0]) for x in done):
                yield solve(*(np.concatenate(x) for x in zip(*done, strict=True)))
            held = [tuple(x[open_at:] for x in columns)]
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _sets(k: int):
    """(id, text) -> (t, grams): each text's set of shingles in order."""

    def run(batches):
        for batch in batches:
            t, sets = [], []
            for _, _, whole, gram, o in _blocks(batch.column(1), k):
                t.append(whole)
                sets += [np.unique(gram[a:b]).tobytes() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            t = np.concatenate(t).view(np.int64) if t else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(sets, pa.binary())], names=["t", "grams"])

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verified(least: float):
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [
                similarity(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) >= least
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def fingerprint_pairs(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: texts (t, fp) to be held against each other, by SimHash: those of one fingerprint go with its smallest t,
    and the smallest ones of fingerprints that the index links with one another."""
    first = nodes.groupBy("fp").agg(F.min("t").alias("least"))
    alike = nodes.join(first, "fp").where("t <> least").select(F.col("least").alias("a"), F.col("t").alias("b"))
    named = [first.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_t")) for c in "ab"]
    far = link_fingerprints(first.select("fp"), distance).distinct().join(named[0], "a").join(named[1], "b").select(F.col("a_t").alias("a"), F.col("b_t").alias("b"))
    return alike.unionAll(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _known(k: int):
    def run(batches):
        for batch in batches:
            t = [whole for _, _, whole, _, _ in _blocks(batch.column(1), k)]
            t = np.concatenate(t).view(np.int64) if t else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t)], names=["row", "text", "t"])

    return run


def keep_one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, null behind all others.

    Groups are linked by pairs whose sets of ``k``-word shingles have Jaccard
    similarity ``least`` or more. Texts without words are one group. Rows with the
    same id and words are one document, of which one row stays; the same id with
    other words is another document. Columns pass unchanged.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    texts = docs.select(ids.alias("id"), F.col(text_col).alias("text"))
    own = Table(texts.mapInArrow(_signatures(k), "id long, t long, keys array<long>, low binary, fp long"))
    nodes = Table(own.df.groupBy("t").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("low").alias("low"), F.first("fp").alias("fp")))
    by_simhash = Table(fingerprint_pairs(nodes.df.where("t <> 0").select("t", "fp"))).df
    member = nodes.df.where("t <> 0").select(F.posexplode("keys").alias("band", "k"), "t")
    full = Table(member.join(member.groupBy("k").count().where("count > 1").select("k"), "k"))
    lists = Table(full.df.join(nodes.df.select("t", "low"), "t").select("k", "t", F.col("band").cast("tinyint").alias("band"), "low"))
    asked = full.df.select("t").unionAll(by_simhash.select(F.explode(F.array("a", "b")).alias("t"))).distinct()
    named = nodes.df.select("t", "id").join(asked, "t").select("id").distinct()
    found = texts.join(named, "id", "left_semi").mapInArrow(_sets(k), "t long, grams binary")
    sets = Table(found.join(asked, "t", "left_semi").groupBy("t").agg(F.first("grams").alias("grams"))).df

    def linked(pairs: DataFrame) -> DataFrame:
        both = (
            pairs.join(sets.select(F.col("t").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("t").alias("b"), F.col("grams").alias("y")), "b")
            .select("a", "b", "x", "y")
        )
        return Table(both.mapInArrow(_verified(least), "a long, b long")).df

    links = linked(by_simhash)
    parts = Table(connected_components(links))
    for turn, estimate in enumerate(ESTIMATES):
        members = lists.df.join(parts.df, F.col("t") == F.col("node"), "left").withColumn("component", F.coalesce("component", "t"))
        members = members.select("k", "t", "component", "band", "low").repartition("k").sortWithinPartitions("k")
        new = linked(members.mapInArrow(_candidates(estimate, turn == 0, least), "a long, b long").distinct())
        if new.isEmpty():
            continue
        links = links.unionAll(new)
        parts = Table(connected_components(links))
    parts = parts.df
    grouped = nodes.df.select("t", "id").join(parts, F.col("t") == F.col("node"), "left").select(
        "t", "id", F.coalesce("component", "t").alias("component")
    )
    # the smallest id's words, the smallest hash where it has several
    kept = grouped.groupBy("component").agg(F.min(F.struct("id", "t")).alias("x")).select(F.col("x.t").alias("_t"), F.col("x.id").alias("_id"))
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    rows = rows.mapInArrow(_known(k), f"row {kind}, text string, t long")
    rows = rows.withColumn("id", F.coalesce(F.col("row")[id_col].cast("long"), F.lit(LAST_ID)))
    left = rows.join(kept, (F.col("t") == F.col("_t")) & (F.col("id") == F.col("_id")), "left_semi")
    if not own.df.groupBy("id", "t").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["id", "t"])
    return left.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
