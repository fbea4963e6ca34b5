"""Search over a table of entries: words that match, and where none do, the nearest by edit distance.

Tokens meet words by equi-joins over distinct words: on every stretch of a word for
direct matches, and for typing errors on what is left when up to two letters are
deleted from either. Two words within k edits always share such a rest, so only pairs
that share one are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.plans.scratch import settled

EXACT, PREFIX, SUBSTRING = 1.0, 0.7, 0.4
#: How many of the nearest entries a miss names.
NEAREST = 3


def tokens_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def typo_budget(token: Column) -> Column:
    """Edits that a token may be off: two from 7 letters on, one from 4, else none."""
    return F.when(F.length(token) >= 7, 2).when(F.length(token) >= 4, 1).otherwise(0)


def _rests(words: DataFrame, name: str, most: Column) -> DataFrame:
    """(name, rest): each word with up to ``most`` (0 to 2) letters deleted."""
    level = words.select(name, F.col(name).alias("rest"), most.alias("left"))
    out = level
    for _ in range(2):
        level = level.where((F.col("left") > 0) & (F.length("rest") > 1)).select(name, "rest", "left", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("i"))
        cut = F.concat(F.expr("substring(rest, 1, i - 1)"), F.expr("substring(rest, i + 1)"))
        level = level.select(name, cut.alias("rest"), (F.col("left") - 1).alias("left")).distinct()
        out = out.unionAll(level)
    return out.select(name, "rest").distinct()


def typo_pairs(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word) within the token's budget of edits, of distinct ``token`` and ``word`` columns."""
    budget = typo_budget(F.col("token"))
    asked = _rests(tokens.where(budget > 0), "token", budget)
    both = asked.join(_rests(words, "word", F.lit(2)), "rest").select("token", "word").distinct()
    return both.where(F.levenshtein("token", "word") <= budget)


def direct_pairs(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word, strength): the word is the token, begins with it or holds it."""
    longest = tokens.agg(F.max(F.length("token"))).first()[0] or 0
    stretch = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("i") + 1))
    stretch = stretch.where(F.lit(longest > 0)).select("word", "i", F.explode(sizes).alias("n")).select("word", F.expr("substring(word, i, n)").alias("token")).distinct()
    strength = F.when(F.col("token") == F.col("word"), EXACT).when(F.startswith("word", "token"), PREFIX).otherwise(SUBSTRING)
    return stretch.join(tokens, "token").select("token", "word", strength.alias("strength"))


def searched(queries: DataFrame, entries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """(query_id, kind, rank, entry_id, score) of ``queries`` (query_id, text) over ``entries`` (entry_id, text, weight).

    found: every entry in which each token matches a word directly; a token counts its best strength times
    weight. nearest: for a query that finds nothing, the first few entries by the same sum, where a token
    without a direct match counts a word within its edits as a substring. unknown: one row without an entry.
    A query without words is unknown. Ranks go by score, then entry; an entry's texts may be several rows.

    Queries of the same words are ranked once, and entries of the same words and weights are measured once, so that
    only the rows that are returned grow with both tables.
    """
    named = queries.select("query_id", tokens_of(F.col("text")).alias("asked")).distinct()
    asked = named.select("asked").distinct()
    own = entries.select("entry_id", "weight", F.explode(tokens_of(F.col("text"))).alias("word")).groupBy("entry_id", "word").agg(F.max("weight").alias("weight"))
    members = own.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("word", "weight"))).alias("holds"))
    kinds = members.select("holds").distinct()
    own = kinds.select("holds", F.inline("holds"))
    each_token = asked.select("asked", F.posexplode("asked").alias("nth", "token"))
    tokens, words = each_token.select("token").distinct(), own.select("word").distinct()
    typos = typo_pairs(tokens, words).select("token", "word", F.lit(SUBSTRING).alias("strength"), F.lit(True).alias("typo"))
    pairs = direct_pairs(tokens, words).withColumn("typo", F.lit(False)).unionByName(typos)
    hits = each_token.join(pairs, "token").join(own, "word")
    value = F.col("strength") * F.col("weight")
    each = hits.groupBy("asked", "nth", "holds").agg(F.max(F.when(~F.col("typo"), value)).alias("direct"), F.max(F.when(F.col("typo"), value)).alias("typo"))
    total = each.groupBy("asked", "holds").agg(F.count("direct").alias("n"), F.sum(F.coalesce("direct", "typo")).alias("score"))
    total = settled(total.withColumn("whole", F.col("n") == F.size("asked")))
    found = total.where("whole")
    close = total.join(found.select("asked").distinct(), "asked", "left_anti")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc(F.round("score", 9)), "entry_id")).cast("long")
    found = found.join(members, "holds").select("asked", F.lit("found").alias("kind"), rank.alias("rank"), "entry_id", "score")
    # entries of the same words and weights score alike, so only the first few of them can be near
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("holds").orderBy("entry_id"))).where(F.col("place") <= nearest)
    close = close.join(first, "holds").select("asked", F.lit("nearest").alias("kind"), rank.alias("rank"), "entry_id", "score").where(F.col("rank") <= nearest)
    ranked = found.unionByName(close)
    known = total.select("asked").distinct()
    none = named.join(known, "asked", "left_anti").select("query_id", F.lit("unknown").alias("kind"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast(entries.schema["entry_id"].dataType).alias("entry_id"), F.lit(None).cast("double").alias("score"))
    return named.join(ranked, "asked").select("query_id", "kind", "rank", "entry_id", "score").unionByName(none)
