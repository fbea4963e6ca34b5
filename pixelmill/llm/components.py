"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each hi has one lo, and no lo is a hi."""
    sides = edges.select(F.col("hi").alias("node"), F.lit(1).alias("as_hi"), F.lit(0).alias("as_lo")).unionAll(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("as_hi"), F.lit(1).alias("as_lo"))
    )
    by_node = sides.groupBy("node").agg(F.sum("as_hi").alias("hi"), F.max("as_lo").alias("lo"))
    return by_node.where("hi > 1 or (hi > 0 and lo > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component, for every node of an edge.

    ``edges`` has long columns ``a`` and ``b``. Each round sends every node at
    most its own edges; minima are combined before the shuffle, and the joins
    are plain equi-joins, which adaptive execution splits where a node is hot.
    Each round's edges are written to the shared folder. Empty input: no rows.
    """
    current = Table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    while not _is_forest_of_stars(current.df):
        e = current.df
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = Table(large)
        low = large.df.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.df.join(low, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(low.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        following = Table(small)
        large.drop()
        current.drop()
        current = following
    e = current.df
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
