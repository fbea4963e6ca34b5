"""Batches: one document over many images, names by template, an error for each image that fails."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a template; fixed values, as are the characters no file system takes and the longest name.
TOKENS = ("name", "index", "preset", "width", "height", "format")
ILLEGAL = '[\\x00-\\x1F\\x7F<>:"/\\\\|?*]'
LONGEST = 120


def template_problem(template: str) -> str | None:
    """Why a template cannot be used."""
    if not template.strip():
        return "empty-template"
    return "unknown-token" if set(re.findall(r"\{([^{}]*)\}", template)) - set(TOKENS) else None


def sanitised(name: Column) -> Column:
    """Without characters no file system takes, outer blanks and leading dots; at most LONGEST characters."""
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, ILLEGAL, "")), "^\\.+", ""))
    return F.when(clean == "", F.lit("untitled")).otherwise(F.substring(clean, 1, LONGEST))


def planned(inputs: DataFrame, template: str, preset: str, extension: str = "png") -> DataFrame:
    """``inputs`` (path, width, height, any others) with output and status: ok, or collision where names agree regardless of case.

    Indices follow the paths' order and are padded to the number of inputs.
    """
    if fault := template_problem(template):
        raise ValueError(fault)
    base = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")
    # numbers by ranges of paths, so that no task sees all inputs
    ranged = inputs.repartitionByRange(F.col("path")).withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    total = F.sum("count").over(Window.partitionBy())
    parts = parts.select("_part", "_before", F.length(total.cast("string")).alias("_digits"))
    rows = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("path"))).join(parts, "_part")
    number = (F.col("_nth") + F.col("_before")).cast("string")
    values = {"name": base, "preset": F.lit(preset), "width": F.col("width").cast("string"), "height": F.col("height").cast("string"), "format": F.lit(extension)}
    values["index"] = F.lpad(number, F.greatest(F.col("_digits"), F.length(number)), F.lit("0"))
    # all tokens at once: the template's pieces are joined, so a value is never read as a token
    pieces = [values[p[1:-1]] if p[1:-1] in TOKENS and p.startswith("{") else F.lit(p) for p in re.split(r"(\{[^{}]*\})", template) if p]
    named = rows.withColumn("output", F.concat(sanitised(F.concat(*pieces)), F.lit(f".{extension}")))
    copies = named.groupBy(F.lower("output").alias("_same")).agg(F.count("*").alias("_copies"))
    named = named.join(copies, F.lower("output") == F.col("_same"))
    status = F.when(F.col("_copies") > 1, F.lit("collision")).otherwise(F.lit("ok"))
    return named.withColumn("status", status).select(*inputs.columns, "output", "status")


def run(spark, path: str, document, context, template: str = "{name}-dither", preset: str = "untitled") -> DataFrame:
    """(path, output, png, error): every file below ``path`` through a document. A file that cannot be read, or whose name
    collides, has its error and no bytes; the others are not touched by it."""
    from pixelmill.plans import document as documents
    from pixelmill.sources import images

    pixels, errors = images.read_images(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = planned(images.probe(files).select("path", "width", "height"), template, preset).withColumn("image_id", F.xxhash64("path"))
    made = images.png_files(documents.plan(document, pixels, context)).select("image_id", "png")
    out = known.join(made, "image_id", "left").join(errors.select("image_id", "error"), "image_id", "left")
    error = F.when(F.col("status") == "collision", F.lit("name-collision")).otherwise(F.col("error"))
    return out.select("path", "output", F.when(error.isNull(), F.col("png")).alias("png"), error.alias("error"))
