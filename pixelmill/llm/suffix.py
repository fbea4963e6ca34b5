"""Repeated byte strings by depth-limited radix passes over suffixes.

Only suffixes that can share ``length`` bytes are ordered, and only through that
depth, most significant digit first. Spark sorts records by digit; a pass streams
over the sorted rows, and groups of one end there.

1. The first digit of a suffix is the ``gram`` bytes at its minimiser, the
   smallest hashed ``gram`` within its first ``length`` bytes. Equal strings have
   equal minimisers at equal offsets. Consecutive suffixes with one minimiser make
   a run, so about one record leaves for 33 suffixes. Groups of one end here.
2. The second digit is all bytes a run's strings cover. Equal runs are equal
   strings throughout: all but the earliest are repeats.
3. Only distinct runs of one first digit are left, at the edges of repeated
   passages. Their suffixes are ordered by all ``length`` bytes; equal groups are
   exactly the repeated strings.

Digits are held as hashes of their bytes, 96 bits wide where a match removes text
(two polynomials with independent bases and byte words, 64 and 32 bits). Among
10**12 strings a false match of any has a chance below 1e-5. The first digit needs
no exactness: a clash there only sends more runs to pass 3.

No group is held: a pass keeps one row of the group it stands in. Within a batch of
about ``BATCH`` bytes equal runs and strings meet before the shuffle. A first digit
with several second digits in one batch is known to go on, so of these rows only one
is dealt out by the first digit; the rest go by both digits. So a digit that stands
in a third of all documents reaches one task once a batch, not once a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Rolling, Table, blocks, mix64, text_buffer

PLACE_BITS = 24
PLACE = np.uint64((1 << PLACE_BITS) - 1)
BLOCK, SEGMENT, BATCH = 1_000_000, 2_000_000, 16_000_000
#: Windows of pass 3 that meet before the shuffle.
WINDOWS = 1_000_000
#: What ``m`` of a run holds beside 32 bits of its second digit: 20 of its length, and whether it is known to go
#: on and is dealt out by both digits. A range known to repeat has a length of 0 here and its own in b. Rows are
#: packed so, and h is left out where ids are unique, as they are most of what is shuffled.
LENGTH_BITS = 20
GOES_ON, BY_BOTH = 1 << LENGTH_BITS, 1 << LENGTH_BITS + 1
DIGITS = "a long, b long, m long, id long, s long"
RANGES = "id long, h int, s long, n long, kind int"


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minima of all runs of w values, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] values each."""
    return np.arange(count.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)


def runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int):
    """(piece, first suffix, number, first digit, second digit in 64 and 32 bits) of the runs of pieces of ``data``."""
    count = np.maximum(end - start - length + 1, 0)
    if not count.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(np.uint32)
    rolling = Rolling(data)
    grams = rolling.fixed(gram)
    least = window_minimum((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    s = _expand(start, count)
    anchor = (least[s] & PLACE).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    n = np.diff(np.append(first, len(s)))
    s0, at = s[first], anchor[first]
    last = s0 + n - 1 + length
    offset = mix64((at - s0).astype(np.uint64))
    other = (Rolling(data, 1).spans(s0, last) >> np.uint64(32)).astype(np.uint32)
    piece = np.searchsorted(start, s0, "right") - 1
    return piece, s0 - start[piece], n, grams[at], rolling.spans(s0, last) ^ offset, other


def _pieces(offsets: np.ndarray, length: int):
    """(rows, place in the row, start, end) of stretches of text to handle at once."""
    for i, j in blocks(offsets, BLOCK):
        if offsets[j] - offsets[i] <= SEGMENT:
            yield np.arange(i, j), np.zeros(j - i, np.int64), offsets[i:j], offsets[i + 1 : j + 1]
        else:
            for at in range(0, int(offsets[j] - offsets[i]), SEGMENT):
                a = int(offsets[i]) + at
                yield np.array([i]), np.array([at]), np.array([a]), np.array([min(a + SEGMENT + length - 1, int(offsets[j]))])


def _first_of_equal(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _merged(doc: np.ndarray, s: np.ndarray, n: np.ndarray):
    """Touching ranges of suffixes of one document joined; sorted by document and place."""
    o = np.lexsort((s, doc))
    doc, s, n = doc[o], s[o], n[o]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return doc[at], s[at], np.add.reduceat(n, at) if len(at) else n


def _table(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _with_h(schema: str, apart: bool) -> str:
    return schema + ", h int" if apart else schema


def _first_pass(length: int, gram: int, apart: bool):
    """Documents -> runs with their digits; repeats within a batch come as ranges."""

    def flush(ids, hs, rows):
        doc, s, n, a, b, c = (np.concatenate(x) for x in zip(*rows, strict=True))
        o = np.lexsort((hs, ids))
        rank = np.empty(len(ids), np.int64)
        rank[o] = np.cumsum(_first_of_equal(ids[o], hs[o]))
        o = np.lexsort((s, rank[doc]))
        o = o[_first_of_equal(rank[doc[o]], s[o])]  # repeated rows are one document
        o = o[np.lexsort((c[o], b[o], a[o]))]  # stable: the earliest of equal runs first
        doc, s, n, a, b, c = (x[o] for x in (doc, s, n, a, b, c))
        new = _first_of_equal(a, b, c)
        d1, s1, n1 = _merged(doc[~new], s[~new], n[~new])
        doc, s, n, a, b, c = (x[new] for x in (doc, s, n, a, b, c))
        first = _first_of_equal(a)
        group = np.cumsum(first) - 1
        several = np.bincount(group)[group] > 1 if len(group) else first
        known = np.where(several, GOES_ON, 0) + np.where(first, 0, BY_BOTH)
        doc, s = np.concatenate((doc, d1)), np.concatenate((s, s1))
        return _table(
            _with_h(DIGITS, apart),
            np.concatenate((a.view(np.int64), mix64(ids[d1].astype(np.uint64)).view(np.int64))),
            np.concatenate((b.view(np.int64), n1)),
            np.concatenate((c.astype(np.int64) << 32 | known | n, np.zeros(len(d1), np.int64))),
            ids[doc],
            s,
            *([hs[doc].astype(np.int32)] if apart else []),
        )

    def run(batches):
        ids, hs, rows, held, known = [], [], [], 0, 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            ids.append(batch.column(0).to_numpy())
            hs.append(batch.column(1).to_numpy())
            for row, at, start, end in _pieces(offsets, length):
                low, high = int(start[0]), int(end[-1])
                piece, s, n, *digits = runs(data[low:high], start - low, end - low, length, gram)
                rows.append((row[piece] + known, s + at[piece], n, *digits))
                held += high - low
                if held >= BATCH:
                    yield flush(np.concatenate(ids), np.concatenate(hs), rows)
                    rows, held = [], 0
            if held == 0:
                ids, hs, known = [], [], 0
            else:
                known += batch.num_rows
        if rows:
            yield flush(np.concatenate(ids), np.concatenate(hs), rows)

    return run


def _second_pass(apart: bool):
    """Runs sorted by digits, then place -> ranges: kind 1 repeats, kind 0 goes on to the third pass.

    Of the group at hand only its last row is kept, and its first run until a
    second digit shows that it goes on.
    """
    def run(batches):
        last = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, m, ids, s = (batch.column(k).to_numpy() for k in range(5))
            h = batch.column(5).to_numpy() if apart else np.zeros(len(a), np.int32)
            n = m & (GOES_ON - 1)
            sure = n == 0  # a range known to repeat
            n = np.where(sure, b, n)
            digits = np.stack([a, b, m >> 32, ids, h.astype(np.int64), s])
            before = np.concatenate((digits[:, :1] if last is None else last[:, None], digits[:, :-1]), axis=1)
            differs = digits != before
            if last is None:
                differs[:, 0] = True
            new_a = differs[0] | sure  # each of those is a group of its own
            new = new_a | differs[1] | differs[2]
            if last is None:
                new_a[0] = new[0] = True
            group = np.cumsum(new_a) - new_a[0]
            size = int(group[-1]) + 1
            distinct = np.bincount(group, new, size)
            goes_on = (distinct > 1) | (np.bincount(group, m & GOES_ON, size) > 0)
            if not new_a[0]:  # the group began in an earlier batch
                goes_on[0] |= distinct[0] > 0 or held is None
            # the same place of a repeated row is not a repeat of itself
            again = sure | (~new & (differs[3] | differs[4] | differs[5]))
            out = again | (new & goes_on[group])
            rows = [ids[out], h[out], s[out], n[out], again[out].astype(np.int32)]
            if held is not None and (new_a[0] or goes_on[0]):
                if not new_a[0]:
                    rows = [np.append(x, y).astype(x.dtype) for x, y in zip(rows, (*held, 0), strict=True)]
                held = None
            if not goes_on[-1] and not sure[-1] and (size > 1 or new_a[0]):
                k = int(np.flatnonzero(new_a)[-1])
                held = (ids[k], h[k], s[k], n[k])
            last = digits[:, -1]
            yield _table(RANGES, *rows)

    return run


#: vn: 32 bits of the digit, and the length of a range known to repeat (0: a window whose group is yet to be seen).
WHOLE = "w long, vn long, id long, s long"


def _third_digits(length: int, text: int, ranges: int, keys: tuple[int, int], apart: bool):
    """Documents with open ranges -> (whole digit, place); repeats within the batch come as ranges."""

    def flush(rows):
        w, v, ids, h, s = (np.concatenate(x) for x in zip(*rows, strict=True))
        o = np.lexsort((s, h, ids, v, w))
        o = o[_first_of_equal(w[o], v[o], ids[o], h[o], s[o])]
        w, v, ids, h, s = (x[o] for x in (w, v, ids, h, s))
        new = _first_of_equal(w, v)
        o = np.lexsort((s[~new], h[~new], ids[~new]))
        i1, h1, s1 = (x[~new][o] for x in (ids, h, s))
        begin = _first_of_equal(i1, h1, s1 - np.arange(len(s1)))
        n1 = np.diff(np.append(np.flatnonzero(begin), len(s1)))
        i1, h1, s1 = i1[begin], h1[begin], s1[begin]
        w, v, ids, h, s = (x[new] for x in (w, v, ids, h, s))
        return _table(
            _with_h(WHOLE, apart),
            np.concatenate((w.view(np.int64), mix64(i1.astype(np.uint64)).view(np.int64))),
            np.concatenate((v.astype(np.int64) << 32, n1)),
            np.concatenate((ids, i1)),
            np.concatenate((s, s1)),
            *([np.concatenate((h, h1)).astype(np.int32)] if apart else []),
        )

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(text))
            ids, hs = (batch.column(k).to_numpy() for k in keys)
            lists = batch.column(ranges)
            at = np.asarray(lists.offsets)
            s_all, n_all = (np.asarray(lists.values.field(k)) for k in (0, 1))
            for i in range(batch.num_rows):
                s, n = s_all[at[i] : at[i + 1]], n_all[at[i] : at[i + 1]]
                if not len(s):
                    continue
                s, n = np.unique(np.stack([s, n]), axis=1)
                # neighbouring ranges share their bytes
                far = np.flatnonzero(s[1:] > s[:-1] + n[:-1] + length) + 1
                for s1, n1 in zip(np.split(s, far), np.split(n, far), strict=True):
                    for low in range(int(s1[0]), int((s1 + n1).max()), SEGMENT):
                        high = min(low + SEGMENT, int((s1 + n1).max()))
                        own = data[offsets[i] + low : offsets[i] + high + length - 1]
                        p = np.unique(_expand(s1, n1))
                        p = p[(p >= low) & (p < high)] - low
                        w, v = Rolling(own).fixed(length)[p], Rolling(own, 1).fixed(length)[p]
                        rows.append((w, (v >> np.uint64(32)).astype(np.uint32), np.full(len(p), ids[i]), np.full(len(p), hs[i]), p + low))
                        held += len(p)
                        if held >= WINDOWS:
                            yield flush(rows)
                            rows, held = [], 0
        if rows:
            yield flush(rows)

    return run


def document_key(docs: DataFrame, id_col: str, text_col: str) -> tuple:
    """(id, h, names of the key): rows with one id are told apart by a hash h of their texts.

    Equal rows count as one document. Where no id has two texts h is 0 and the id
    is the key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).cast("int")
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    seen = docs.select(ids.alias("id"), h.alias("h")).groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    apart = not seen.where("low <> high").isEmpty()
    return ids, h if apart else F.lit(0), ["id", "h"] if apart else ["id"]


def keyed(docs: DataFrame, key: tuple, text_col: str, *more) -> DataFrame:
    """(id, h, text) and more columns."""
    return docs.select(key[0].alias("id"), key[1].alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def repeated_ranges(texts: DataFrame, by: list[str], *, length: int = 100, gram: int = 36) -> DataFrame:
    """(key, ranges): for each document with any, the starts s .. s + n - 1 of strings of
    ``length`` bytes that also start earlier (smaller id, or the same document and an earlier start).

    ``texts`` has id, h, text and maybe more; ``by`` names its key."""
    apart = "h" in by
    place = ["id", "h", "s"] if apart else ["id", "s"]
    route = F.when(F.col("m").bitwiseAND(F.lit(BY_BOTH)) > 0, F.xxhash64("a", "b")).otherwise(F.col("a"))
    records = texts.select("id", "h", "text").mapInArrow(_first_pass(length, gram, apart), _with_h(DIGITS, apart))
    dealt = records.repartition(route).sortWithinPartitions("a", "b", F.shiftright("m", 32), *place)
    split = Table(dealt.mapInArrow(_second_pass(apart), RANGES)).df
    ranges = F.collect_list(F.struct("s", "n")).alias("ranges")
    open_ = split.where("kind = 0").groupBy(*by).agg(ranges)
    # all columns of the texts pass, so that the last join reads the same shuffle
    asked = texts.join(open_, by)
    at = {c: k for k, c in enumerate(asked.columns)}
    third = _third_digits(length, at["text"], at["ranges"], (at["id"], at["h"]), apart)
    digits = asked.mapInArrow(third, _with_h(WHOLE, apart)).repartition("w")
    digits = digits.withColumn("v", F.shiftright("vn", 32)).withColumn("n", F.col("vn").bitwiseAND(F.lit(2**32 - 1)))
    order = Window.partitionBy("w", "v").orderBy(*place)
    later = digits.withColumn("place", F.rank().over(order)).where("n > 0 or place > 1")
    later = later.select(*place, F.greatest("n", F.lit(1)).cast("long").alias("n"))
    found = split.where("kind = 1").select(*place, "n").unionAll(later)
    return found.groupBy(*by).agg(ranges)


def _covered(size: int, at: np.ndarray, lists, length: int) -> np.ndarray:
    """Which bytes of some texts the ranges cover."""
    change = np.zeros(size + 1, np.int32)
    bounds = np.asarray(lists.offsets)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    s, n = (np.asarray(lists.values.field(k))[bounds[0] : bounds[-1]] for k in (0, 1))
    np.add.at(change, at[row] + s, 1)
    np.add.at(change, at[row] + s + n - 1 + length, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _blocks_with_ranges(batch, text: int, ranges: int, length: int):
    """(rows, bytes, offsets, covered) of about BLOCK bytes at once, so that memory follows BLOCK, not the batch."""
    data, at = text_buffer(batch.column(text))
    lists = _filled(batch.column(ranges))
    for i, j in blocks(at, BLOCK):
        own, o = data[at[i] : at[j]], at[i : j + 1] - at[i]
        yield range(i, j), own, o, _covered(len(own), o[:-1], lists.slice(i, j - i), length)


def _digests(length: int):
    def run(batches):
        for batch in batches:
            size, removed, runs_, digests = [], [], [], []
            for _, data, at, gone in _blocks_with_ranges(batch, 1, 2, length):
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = at[:-1][at[:-1] < len(data)]
                begins[inner] = gone[inner]
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    lost = int(np.count_nonzero(gone[a:b]))
                    size.append(b - a)
                    removed.append(lost)
                    runs_.append(int(np.count_nonzero(begins[a:b])))
                    digests.append(hashlib.sha256(data[a:b][~gone[a:b]] if lost else data[a:b]).hexdigest())
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, runs_)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _filled(lists):
    """A list column with no nulls and its offsets at 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if not lists.null_count and lists.offset == 0:
        return lists
    return pa.array([x or [] for x in lists.to_pylist()], lists.type)


def repeat_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 36) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    Each byte covered by a string of ``length`` bytes that also starts earlier is
    removed; the removed parts and the rest never cross documents. Null text is
    empty. A null id comes before all others. Rows with the same id and text are
    one document and get the same result each; the same id with other texts are
    documents of their own, in the order of a hash. Other columns are not read.
    """
    key = document_key(docs, id_col, text_col)
    texts = keyed(docs, key, text_col)
    texts = texts.join(repeated_ranges(texts, key[2], length=length, gram=gram), key[2], "left")
    known = texts.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "text", "ranges")
    return known.mapInArrow(_digests(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _stripped(length: int):
    def run(batches):
        for batch in batches:
            valid, texts = batch.column(1).is_valid(), []
            for rows, data, at, gone in _blocks_with_ranges(batch, 1, 2, length):
                if gone.any():  # a character goes only if all its bytes do
                    first = np.flatnonzero((data & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(gone, first)
                    gone = np.repeat(whole, np.diff(np.append(first, len(data))))
                for k, a, b in zip(rows, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    left = data[a:b][~gone[a:b]] if gone[a:b].any() else data[a:b]
                    texts.append(left.tobytes().decode() if valid[k].as_py() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 36) -> DataFrame:
    """``docs`` with repeated strings cut from its texts; whole characters only, so texts stay valid.

    Every row stays, one left without text too. Other columns pass unchanged.
    """
    key = document_key(docs, id_col, text_col)
    others = [c for c in docs.columns if c != text_col]
    texts = keyed(docs, key, text_col, F.struct(*others).alias("row"), F.col(text_col).isNull().alias("empty"))
    rows = texts.join(repeated_ranges(texts, key[2], length=length, gram=gram), key[2], "left")
    rows = rows.select("row", F.when(~F.col("empty"), F.col("text")).alias("text"), "ranges")
    kind = rows.schema["row"].dataType.simpleString()
    cut = rows.mapInArrow(_stripped(length), f"row {kind}, text string")
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def brute_force(rows: list[tuple[int, str | None]], length: int = 100) -> list[tuple]:
    """The contract of ``repeat_digests`` by a dictionary over all strings, for tests."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
