"""License scans by diagonal voting, in DataFrame operations only.

Every text's rolling two-word grams are joined, by hash, to the grams of known
license phrases. A hit at word p of the text and place q of a template votes for
the diagonal p - q. Votes are counted by diagonal; diagonals no more than ``gap``
apart merge, so that a few inserted or missing words do not split a notice. Only
votes that stand together count: where the next one of a notice is farther than its
missing words and a shift can explain, a new stretch begins. A merged span is
verified: it stands if it has enough of its template's grams and at most twice as
many words as the template, so grams scattered over a text make no notice.

Templates are constants, so the broadcast side has a fixed size. Texts are split
once, their grams stream through the join, and only hits and one row a document
are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM = 2
#: Phrases that must stand whole; fixed values.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices of which most must stand; label by text; fixed values.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced": "reserved",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words; letters of both cases are in words, as A-Z is read as a-z.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def templates(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(gram, q, template, label, grams, whole): one row for each gram of each template."""
    rows = []
    texts = [(t, label, True) for t, label in phrases.items()] + [(t, label, False) for t, label in notices.items()]
    for template, (text, label, whole) in enumerate(texts):
        words = text.split()
        n = len(words) - GRAM + 1
        rows += [(" ".join(words[q : q + GRAM]), q, template, label, n, whole) for q in range(n)]
    return spark.createDataFrame(rows, "t_gram string, q int, template int, label string, grams int, whole boolean")


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    least_share: float = 0.85,
    gap: int = 3,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    spans lists (label, first word, last word, share of the template) of all
    findings. score is the largest share found, 0 without one. Null text is empty:
    no words, no labels. Every row of ``docs`` gets a row; repeated rows get equal
    ones. Extra columns are not read. Empty input: no rows.
    """
    spark = docs.sparkSession
    known = templates(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.array_remove(F.split(text, BETWEEN), "").alias("words"))
    grams = split.select(
        "doc_id",
        "h",
        F.size("words").cast("long").alias("n_words"),
        # one more place, with no gram, carries the document itself
        F.posexplode(
            F.concat(
                F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b")),
                F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit("").alias("b"))),
            )
        ).alias("p", "w"),
    ).where("w.b is not null")
    # hashes of lower-cased words select candidates; the words themselves are compared behind the join
    keyed = grams.select(
        "doc_id", "h", "n_words", "p", F.col("w.a").alias("a"), F.col("w.b").alias("b"),
        F.when(F.col("w.a").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lower("w.a"), F.lower("w.b"))).alias("key"),
    )
    side = known.withColumn("key", F.xxhash64(F.element_at(F.split("t_gram", " "), 1), F.element_at(F.split("t_gram", " "), 2)))
    marker = spark.range(1).select(F.lit("").alias("t_gram"), F.lit(0).alias("q"), F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(0).alias("grams"), F.lit(False).alias("whole"), F.lit(0).cast("long").alias("key"))
    joined = keyed.join(F.broadcast(side.unionByName(marker)), "key")
    same = F.translate(F.concat_ws(" ", "a", "b"), UPPER, LOWER) == F.col("t_gram")
    hits = joined.where((F.col("template") < 0) | same).select("doc_id", "h", "n_words", "p", "q", "template", "label", "grams", "whole")
    doc = ["doc_id", "h"]
    dealt = hits.repartition(*doc)
    # repeated rows of a document count once here, and come back at the end
    once = dealt.groupBy(*doc, "n_words", "template", "label", "grams", "whole", "p", "q").agg(F.count("*").alias("rows"))
    # the next vote of a notice is no farther than the grams it may lack, one shift and one step
    reach = F.floor(F.lit(1 - least_share) * F.col("grams") + F.lit(1e-9)) + gap + 1
    reading = Window.partitionBy(*doc, "template").orderBy("p", "q")
    far = ~F.col("whole") & (F.col("p") - F.lag("p").over(reading) > reach)
    once = once.withColumn("far", F.coalesce(far, F.lit(False)).cast("int"))
    once = once.withColumn("stretch", F.sum("far").over(reading.rowsBetween(Window.unboundedPreceding, 0)))
    diagonals = once.groupBy(*doc, "n_words", "template", "label", "grams", "whole", "stretch", (F.col("p") - F.col("q")).alias("d")).agg(
        F.max("rows").alias("rows"), F.collect_set("q").alias("places"), F.min("p").alias("first"), F.max("p").alias("last")
    )
    # whole phrases must have all votes on one diagonal; notices merge diagonals that lie close
    along = Window.partitionBy(*doc, "template", "stretch").orderBy("d")
    apart = F.col("whole") | (F.col("d") - F.lag("d").over(along) > gap)
    islands = diagonals.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*doc, "n_words", "template", "label", "grams", "whole", "stretch", "island").agg(
        F.max("rows").alias("rows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    share = F.when(F.col("template") >= 0, F.col("votes") / F.col("grams")).otherwise(F.lit(0.0))
    spans = spans.withColumn("share", share)
    base = F.col("whole") & (F.col("share") >= 1)
    compact = F.col("last") - F.col("first") + GRAM <= 2 * (F.col("grams") + GRAM - 1)
    found = base | (~F.col("whole") & (F.col("template") >= 0) & (F.col("share") >= least_share) & compact)

    def labels(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    out = spans.groupBy(*doc, "n_words").agg(
        F.max(F.when(F.col("template") < 0, F.col("rows"))).alias("rows"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found, F.struct("label", "first", (F.col("last") + GRAM - 1).alias("last"), "share")))).alias("spans"),
    )
    return out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("h", "rows", "row")
