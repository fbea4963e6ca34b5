"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, read up to
``max_repeats`` times. A copy's virtual finish time is the words its source has
given out by then, divided by the source's weight. All copies are sorted by that
time over the whole corpus and the list is cut at the total budget. So sources
are served in proportion to their weights, and what an exhausted source leaves
over goes to the rest in the same proportions.

Running sums need no single task: rows are range-partitioned, each partition is
summed, the few sums are added up, and rows are summed within their partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

#: Rows a range of a sort holds on average.
PER_RANGE = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 bits of an MD5 of the id."""
    text = F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def running_sum(rows: Table, order: list[str], amount: str, within: list[str], n: int) -> DataFrame:
    """``rows`` with ``run``: the sum of ``amount`` of all rows up to this one in ``order``,
    started again for each value of ``within`` (the first columns of ``order``)."""
    ranged = Table(rows.df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    parts = ranged.df.groupBy("part", *within).agg(F.sum(amount).alias("own"))
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    inside = Window.partitionBy("part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.df.withColumn("run", F.sum(amount).over(inside))
    return summed.join(parts, ["part", *within]).withColumn("run", F.col("run") + F.col("before")).drop("part", "before")


def source_targets(sizes: DataFrame, weights: list[int], share: float, max_repeats: int) -> DataFrame:
    """(src, source, source_size, weight, target): sources numbered by code point, null last.

    Targets stand in proportion to the weights, none above ``max_repeats`` times its
    source's size, and add up to ``share`` of all sizes.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("src") % len(weights)) + 1).cast("int"))
    s = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("src", F.row_number().over(order) - 1)
        .withColumn("weight", w)
        .withColumn("most", max_repeats * F.col("source_size"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
    )
    # level: the virtual time at which the budget is used up; sources with full_at <= level are full
    upto = Window.orderBy("full_at", "src").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    s = s.withColumn("budget", share * F.sum("source_size").over(everything))
    s = s.withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
    s = s.withColumn("full", F.sum("most").over(upto) - F.col("most"))
    # the level if this source and all after it stay open; the first one that does fixes it
    s = s.withColumn("try", (F.col("budget") - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("try") <= F.col("full_at"), F.struct("full_at", "src", "try"))).over(everything)["try"]
    s = s.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * level, F.col("most").cast("double"))))
    return s.select("src", "source", "source_size", "weight", "target")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row for each row of ``docs``.

    size counts words (null text: 0), copies is how often the mix takes the
    document, taken is size times copies. Sources by code point, null last, have
    ``weights`` in turn. The order depends on ids, not on how rows are stored, so
    reruns agree; rows with equal id, source and size share their place. Documents
    without words cost nothing and are taken at their place. Empty input: no rows.
    """
    sizes = Table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    n = max(1, -(-sizes.df.count() // PER_RANGE), int(sizes.spark.conf.get("spark.sql.shuffle.partitions")))
    sources = Table(source_targets(sizes.df, list(weights), share, max_repeats))
    known = sizes.df.join(sources.df.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    shuffled = Table(known.withColumn("h", shuffle_key(F.col("doc_id"), seed)))
    queued = Table(running_sum(shuffled, ["src", "h", "doc_id", "size"], "size", ["src"], n))
    copies = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    finish = (F.col("copy") * F.col("source_size") + F.col("run")) / F.col("weight")
    events = Table(queued.df.withColumn("copy", copies).select(finish.alias("finish"), "src", "h", "doc_id", "copy", "size"))
    order = ["finish", "src", "h", "doc_id", "copy", "size"]
    line = running_sum(events, order, "size", [], n)
    budget = (sizes.df.agg(F.sum("size")).first()[0] or 0) * share
    last = line.where(F.col("run") <= budget).agg(F.max(F.struct("finish", "src", "h")).alias("last")).first()["last"]
    copies_taken = F.lit(0)
    if last is not None:
        cut = F.struct(F.lit(last["finish"]), F.lit(last["src"]), F.lit(last["h"]))
        for c in range(max_repeats):
            key = F.struct((c * F.col("source_size") + F.col("run")) / F.col("weight"), F.col("src"), F.col("h"))
            copies_taken = copies_taken + (key <= cut).cast("int")
    return (
        queued.df.withColumn("copies", copies_taken)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
    )


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` the mix takes, with their number of ``copies``; an input column of that name gives way."""
    found = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how)
    found = found.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    found = found.select(F.struct("doc_id", "source", "size").alias("key"), "copies")
    # each side in one column, so that no name of the input clashes
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = (
        F.col("row")[id_col].eqNullSafe(F.col("key.doc_id"))
        & F.col("row")[source_col].eqNullSafe(F.col("key.source"))
        & (word_count(F.col("row")[text_col]) == F.col("key.size"))
    )
    return rows.join(found, same).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "copies"], "copies")
