"""The corpus pipeline: documents through five operators, each stage's rows written and read again.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the
columns of ``documents``; the last adds ``copies``, how often the mix takes a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import common, decontaminate, jaccard, mixing, ppm, suffix


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return ppm.keep_known(docs, ppm.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays.

    Groups link where the sets of 5-word shingles have Jaccard similarity 0.8 or more.
    """
    return jaccard.keep_one_of_each_group(docs, k=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stood earlier in the corpus are cut; n_chars follows the text."""
    cut = suffix.remove_repeats(docs, length=100)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item was found go."""
    return decontaminate.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their copies."""
    return mixing.take_mix(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash", near_duplicates),
    ("suffix_array", repeated_passages),
    ("decontamination", benchmark_passages),
    ("mixing", mix),
]
#: Models and hashes of several stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.Table(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
