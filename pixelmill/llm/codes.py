"""Vector code compression: product codes whose codebooks come from Yinyang Lloyd rounds.

Vectors become integers and are cut into equal parts; each part position has a
codebook of its own. The entries of a codebook are clustered into groups. A vector's
part keeps one lower bound for each group: no entry of the group but its own lies
nearer. When the entries move, the bound falls by the group's largest drift; only
groups whose bound no longer exceeds the distance to the part's own entry are
scanned. Bounds are floating point, with a margin; every distance that decides is an
exact integer, and ties go to the lower index.

The rows with their codes and bounds are a table in the shared folder, written anew
each round; each task adds one row with the sums its parts give to their entries.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, shared

#: Components saturate here; beyond it no sum of squares fits the result's long.
LOW, HIGH = -(2**31), 2**31 - 1
#: Integers below this square and add within 64 bits; others are Python's.
SMALL = 2**28
#: Share by which bounds are kept on the safe side of their rounding.
MARGIN = 1e-5
LARGEST = 2**63 - 1


def _integers(scale: int):
    """(vec_id, label, vector) -> kept rows with their components as 32-bit integers."""

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
            flat = column.flatten()  # of the rows that are not null
            null = column.is_null().to_numpy(zero_copy_only=False)
            size = np.where(null, 0, size)
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
            end = np.cumsum(size)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            keep = ~null & (bad[end] == bad[end - size])
            q = np.zeros(len(x), np.int32)
            ok = np.isfinite(x)
            with np.errstate(over="ignore"):
                q[ok] = np.clip(np.floor(x[ok] * scale), LOW, HIGH)
            rows = np.flatnonzero(keep)
            raw = [q[end[i] - size[i] : end[i]].tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in (0, 1)), pa.array(raw, pa.binary())], names=["vec_id", "label", "q"])

    return run


def _padded(raw: list[bytes], width: int) -> np.ndarray:
    """One row of ``width`` integers a vector; shorter ones end in zeros."""
    return np.frombuffer(b"".join(r.ljust(4 * width, b"\0") for r in raw), np.int32).reshape(len(raw), width).astype(np.int64)


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: farthest-first centres, then a few Lloyd steps. Any grouping gives right codes."""
    e = entries.astype(float)
    centres = [0]
    for _ in range(1, min(groups, len(e))):
        centres.append(int(np.argmax(((e[:, None] - e[centres]) ** 2).sum(2).min(1))))
    c = e[centres]
    for _ in range(5):
        own = ((e[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.stack([e[own == g].mean(0) if (own == g).any() else c[g] for g in range(len(c))])
    return own


class Round:
    """One assignment against ``books`` (part, entry, position); ``before`` are the books that state refers to."""

    def __init__(self, books: np.ndarray, groups: np.ndarray, before: np.ndarray | None):
        self.books, self.groups, self.n_groups = books, groups, int(groups.max(initial=0)) + 1
        self.exact = object if np.abs(books).max(initial=0) >= SMALL else np.int64
        self.drift = None
        if before is not None:
            moved = np.sqrt(((books - before).astype(float) ** 2).sum(2)) * (1 + MARGIN)
            self.drift = np.stack([[moved[p][groups[p] == g].max(initial=0.0) for g in range(self.n_groups)] for p in range(len(books))])

    def assign(self, q: np.ndarray, codes: np.ndarray | None, bound: np.ndarray | None):
        """(codes, exact squared distances, bounds) of vectors ``q`` (row, part, position)."""
        n, parts, _ = q.shape
        exact = object if np.abs(q).max(initial=0) >= SMALL else self.exact
        q, books = q.astype(exact), self.books.astype(exact)
        first = codes is None
        codes = np.zeros((n, parts), np.int64) if first else codes.astype(np.int64)
        error = np.empty((n, parts), exact)
        bound = np.full((n, parts, self.n_groups), -1.0) if first else bound - self.drift
        for p in range(parts):
            old = codes[:, p]
            own = ((q[:, p] - books[p][old]) ** 2).sum(1)
            best, code = own.copy(), old.copy()
            reach = np.sqrt(own.astype(float)) * (1 + MARGIN)
            scans = []
            for g in range(self.n_groups):
                members = np.flatnonzero(self.groups[p] == g)
                rows = np.flatnonzero(bound[:, p, g] <= reach)
                if not len(rows) or not len(members):
                    continue
                d = ((q[rows, p][:, None] - books[p][members]) ** 2).sum(2)
                at = np.argmin(d, 1)  # the first of equals: the lower index
                near, entry = d[np.arange(len(rows)), at], members[at]
                wins = (near < best[rows]) | ((near == best[rows]) & (entry < code[rows]))
                best[rows[wins]], code[rows[wins]] = near[wins], entry[wins]
                scans.append((g, rows, members, d))
            # an entry that was left counts in its group's bound from now on
            left = np.flatnonzero(code != old)
            home = self.groups[p][old[left]]
            bound[left, p, home] = np.minimum(bound[left, p, home], np.sqrt(own[left].astype(float)))
            for g, rows, members, d in scans:
                others = np.where(members == code[rows][:, None], np.inf, np.sqrt(d.astype(float)))
                bound[rows, p, g] = others.min(1) * (1 - MARGIN)
            codes[:, p], error[:, p] = code, best
        return codes, error, bound * np.where(bound > 0, 1 - MARGIN, 1 + MARGIN)


def _round(model, width: int):
    """State -> state, and a row of sums for each task."""

    def run(batches):
        import pickle

        step = Round(*pickle.loads(model.value))
        parts, entries, deep = step.books.shape
        sums = np.zeros((parts, entries, deep + 1), np.int64)
        kinds = None
        for batch in batches:
            kinds = kinds or batch.schema.types
            keep = pa.array(np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)))
            batch = batch.take(keep)
            if not len(batch):
                continue
            n = len(batch)
            q = _padded(batch.column(2).to_pylist(), width).reshape(n, parts, deep)
            codes = bound = None
            if batch.num_columns > 3:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts)
                bound = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(n, parts, step.n_groups).astype(float)
            codes, _, bound = step.assign(q, codes, bound)
            for p in range(parts):
                chosen = (codes[:, p][:, None] == np.arange(entries)).astype(np.int64)
                sums[p, :, :deep] += chosen.T @ q[:, p]
                sums[p, :, deep] += chosen.sum(0)
            state = [codes.astype(np.uint8), bound.astype(np.float32)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array([row.tobytes() for row in s], pa.binary()) for s in state), pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "label", "q", "codes", "bound", "sums"],
            )
        if kinds:
            blank = [pa.nulls(1, k) for k in (*kinds[:3], pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=["vec_id", "label", "q", "codes", "bound", "sums"])

    return run


def _last(model, width: int):
    """State -> codes in hex and errors."""

    def run(batches):
        import pickle

        step = Round(*pickle.loads(model.value))
        parts, _, deep = step.books.shape
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))))
            n = len(batch)
            q = _padded(batch.column(2).to_pylist(), width).reshape(n, parts, deep)
            codes = bound = None
            if batch.num_columns > 3:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts)
                bound = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(n, parts, step.n_groups).astype(float)
            codes, error, _ = step.assign(q, codes, bound)
            total = [min(sum(map(int, e)), LARGEST) for e in error]
            code = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(total, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The tasks' sums, added up by Spark; one number for each component of the codebooks and each count."""
    each = state.where("sums is not null").select(F.posexplode("sums").alias("at", "x"))
    found = each.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = np.zeros(shape[0] * shape[1] * (shape[2] + 1), object)
    for r in found:
        out[r["at"]] = int(r["x"])
    return out.reshape(shape[0], shape[1], shape[2] + 1)


def moved(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries at the floors of their parts' means; unused entries stay."""
    out = books.copy()
    for p, k in zip(*np.nonzero(sums[:, :, -1]), strict=True):
        out[p, k] = [int(s) // int(sums[p, k, -1]) for s in sums[p, k, :-1]]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label", parts=8, entries=16, groups=4, rounds=6, scale=4096) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): one row for each kept row.

    Rows whose vector is null or holds null or non-finite components go; all others
    stay, repeated rows too, each with a row of its own. A component x is
    floor(scale * x), held within 32 bits. Vectors are read as long as the longest,
    rounded up to a multiple of ``parts``; shorter ones end in zeros. Codebooks start
    from the ``entries`` smallest ids (null last; equal ids by their components), so
    fewer rows make smaller codebooks. code has two hex digits a part. error saturates
    at the largest long, and so does label_error, its sum over equal labels (nulls
    together). Other columns are not read. No kept rows: no rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    label = own.schema["label"].dataType.simpleString()
    state = Table(own.mapInArrow(_integers(scale), f"vec_id long, label {label}, q binary"))
    first = state.df.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    longest = state.df.agg(F.max(F.length("q"))).first()[0] or 0
    deep = max(1, -(-longest // (4 * parts)))
    width = parts * deep
    final = f"vec_id long, label {label}, code string, error long"
    if not first:
        empty = spark.createDataFrame([], final)
        return empty.withColumns({"label_error": F.lit(None).cast("long"), "codebooks_sha256": F.lit(digest(np.zeros(0, np.int64)))})
    books = np.ascontiguousarray(_padded([bytes(r.q) for r in first], width).reshape(-1, parts, deep).swapaxes(0, 1))
    kinds = np.stack([grouped(b, groups) for b in books])
    before = None
    for _ in range(rounds):
        model = shared(spark, (books, kinds, before))
        columns = ["vec_id", "label", "q", *(["codes", "bound"] if before is not None else [])]
        following = Table(state.df.select(*columns).mapInArrow(_round(model, width), f"vec_id long, label {label}, q binary, codes binary, bound binary, sums array<long>"))
        state.drop()
        state, before = following, books
        books = moved(books, _sums(state.df, books.shape))
    model = shared(spark, (books, kinds, before))
    columns = ["vec_id", "label", "q", *(["codes", "bound"] if before is not None else [])]
    coded = Table(state.df.select(*columns).mapInArrow(_last(model, width), final)).df
    state.drop()
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = by_label.withColumnRenamed("label", "of_label")
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
    return found.withColumn("codebooks_sha256", F.lit(digest(books)))
