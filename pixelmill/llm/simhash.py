"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints are 64 bits. Two that differ in at most ``d`` bits agree on one of
``d + 1`` blocks, and on one of ``d + 1`` parts of the remaining bits; so every
distinct fingerprint goes to ``(d + 1)**2`` lists, each holding fingerprints that
share about half of their bits. A list is sorted by Gray rank, so neighbours
share long bit patterns. Leaves take runs of 32 fingerprints; each node keeps
the mask of bits its members share and their pattern. Two nodes whose shared
patterns already differ in more than ``d`` bits are pruned with all below them;
the differences of pairs that remain are counted at the leaves.

A list's links leave it as a star to the smallest fingerprint of each of its
local components, so a dense list gives no more rows than it has members, and
no link is lost. Components over the lists are found in Spark.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, text_buffer
from .components import connected_components

BITS = 64
LEAF, FAN = 32, 8


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 (seed 42) of each k-word shingle, repeats included; fewer words: of all of them."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, 42)]
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits set in over half; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    at = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        bits = np.unpackbits(raw[:, byte : byte + 1], axis=1, bitorder="little")
        sums = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        for bit in range(8):
            out[full] |= (2 * sums[:, bit] > counts[full]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprint_of(text: str | None, k: int) -> int:
    h = np.array(shingle_hashes((text or "").encode(), k), np.uint64)
    return int(majority(h, np.array([len(h)]))[0])


def _fingerprint_batches(k: int, limit: int = 250_000):
    def run(batches):
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            raw = data.tobytes()
            found, hashes, counts = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                h = shingle_hashes(raw[a:b], k)
                hashes.extend(h)
                counts.append(len(h))
                if len(hashes) >= limit:
                    found.append(majority(np.array(hashes, np.uint64), np.array(counts)))
                    hashes, counts = [], []
            found.append(majority(np.array(hashes, np.uint64), np.array(counts, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; a text without words has fp 0."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_fingerprint_batches(k), "doc_id long, fp long")


# ------------------------------------------------------------- the Gray index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where each word stands in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask of shared bits) of the nodes, leaves first, until one level fits in a block."""
    ones = np.bitwise_and.reduceat(f, np.arange(0, len(f), LEAF))
    zeros = ~np.bitwise_or.reduceat(f, np.arange(0, len(f), LEAF))
    out = [(ones, ones | zeros)]
    while len(out[-1][0]) > FAN:
        at = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        out.append((ones, ones | zeros))
    return out


class _Labels:
    """Union-find over positions; each label is the smallest position of its set."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while True:
            a, b = p[i], p[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(q := p[p], p):
                p[:] = q


def local_components(f: np.ndarray, distance: int) -> np.ndarray:
    """For distinct fingerprints in Gray order, the smallest position each is linked to."""
    labels = _Labels(len(f))
    levels = _levels(f)
    top = len(levels) - 1
    n = len(levels[top][0])
    i, j = np.triu_indices(n)
    stack = [(top, i, j)]
    step = 4096
    while stack:
        level, i, j = stack.pop()
        if len(i) > step:
            stack.append((level, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        pattern, mask = levels[level]
        keep = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= distance
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        width, below = (FAN, len(levels[level - 1][0])) if level else (LEAF, len(f))
        step_in = np.arange(width)
        ci = (i[:, None, None] * width + step_in[None, :, None]).repeat(width, 2)
        cj = (j[:, None, None] * width + step_in[None, None, :]).repeat(width, 1)
        inside = (ci < below) & (cj < below) & (ci <= cj if level else ci < cj)
        ci, cj = ci[inside], cj[inside]
        if level:
            stack.append((level - 1, ci, cj))
        else:
            near = np.bitwise_count(f[ci] ^ f[cj]) <= distance
            labels.join(ci[near], cj[near])
    return labels.parent


def _masks(distance: int) -> list[int]:
    """The bits two fingerprints must share in each list; any pair within ``distance`` shares one."""
    parts = distance + 1

    def split(bits):
        cut = np.array_split(np.array(bits), parts)
        return [[int(b) for b in c] for c in cut]

    masks = []
    for block in split(range(BITS)):
        rest = [b for b in range(BITS) if b not in block]
        masks += [sum(1 << b for b in block + part) for part in split(rest)]
    return masks


def _link_batches(distance: int):
    def links(key: np.ndarray, f: np.ndarray):
        """Star edges of complete lists; rows come sorted by key."""
        cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(f)]))
        size = end - start
        two = start[size == 2]
        near = two[np.bitwise_count(f[two] ^ f[two + 1]) <= distance]
        a, b = [f[near]], [f[near + 1]]
        for s, e in zip(start[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            own = f[s:e]
            own = own[np.argsort(gray_rank(own))]
            label = local_components(own, distance)
            far = np.flatnonzero(label != np.arange(len(own)))
            a.append(own[far])
            b.append(own[label[far]])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"]
        )

    def run(batches):
        keys, rest, held = [], [], 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy()], 1)
            f = batch.column(2).to_numpy().view(np.uint64)
            final = key[-1]
            if last is not None and (key == last).all():
                keys.append(key)
                rest.append(f)
                continue
            open_at = len(key) - int(np.argmin((key == final).all(1)[::-1])) if not (key == final).all() else 0
            done_k, done_f = [*keys, key[:open_at]], [*rest, f[:open_at]]
            if sum(map(len, done_f)):
                yield links(np.concatenate(done_k), np.concatenate(done_f))
            keys, rest, last = [key[open_at:]], [f[open_at:]], final
        if rest and sum(map(len, rest)):
            yield links(np.concatenate(keys), np.concatenate(rest))

    return run


def link_fingerprints(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): star edges that connect exactly the distinct ``fp`` within ``distance`` bits."""
    rows = distinct.select(
        "fp",
        F.explode(
            F.array(*[
                F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)).alias("k"))
                for c, m in enumerate(_masks(distance))
            ])
        ).alias("x"),
    ).select("x.c", "x.k", "fp")
    dealt = rows.repartition("c", "k").sortWithinPartitions("c", "k")
    return dealt.mapInArrow(_link_batches(distance), "a long, b long")


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = 2
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``distance`` or
    fewer differing bits. Null texts and texts without words have fingerprint 0
    and link like any other; a row with a null doc_id is linked but never names a
    component unless no other row is there. Repeated rows each get a row. Other
    columns of ``docs`` are not read. Empty input: no rows.
    """
    own = Table(fingerprints(docs, id_col=id_col, text_col=text_col, k=k)).df
    first = Table(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = connected_components(link_fingerprints(first.df.select("fp"), distance))
    grouped = first.df.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    names = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = grouped.join(names, "component").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id names their component. Rows with a null id are kept."""
    found = simhash_components(docs, id_col=id_col, text_col=text_col, k=k, distance=distance)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def all_links_brute_force(f: np.ndarray, distance: int):
    """Every pair within ``distance``, for tests."""
    return [(i, j) for i, j in itertools.combinations(range(len(f)), 2) if int(f[i] ^ f[j]).bit_count() <= distance]
