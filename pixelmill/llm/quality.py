"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Fixed rules reject a text that is too short or repeats itself. Further rules
measure something that grows as a text gets worse; where to cut each is learned
from labelled documents, separately in every stratum, so that good documents are
safe.

Labelled texts, each counted once however many rows or documents repeat it, are dealt
by a hash of the text into a tuning part and a holdout, so copies never stand on both
sides and the holdout's draws are distinct. In the tuning part
each rule gets the cutoff that catches the most bad documents while it fails no more
than ``risk`` / rules of the good ones, and rules are ordered by what they catch.
The holdout then tests the first rule, the first two together, and so on: an exact
binomial test must reject, each time, the hypothesis that the rules together fail
more than ``risk`` of the good documents. Neither cutoffs nor order depend on the
holdout.

Multiple testing: within a stratum testing stops at the first failure (fixed
sequence), and ``delta`` is shared out over the strata that have enough good holdout
rows to pass with none lost (Tarone's correction: the others cannot err). So with
probability 1 - ``delta`` the learned rules of every stratum, taken together, fail at
most ``risk`` of its good documents. At the defaults one stratum needs 99 good
holdout rows, four need 144 each; a stratum with fewer certifies nothing, and only
the fixed rules hold there.

Every labelled text takes part; only counts by stratum and rule are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Table

SYMBOLS = "#*$%&|<>"
GRAM = 8
#: name -> measure; each is 0 for an ordinary text and near 1 for a bad one, null for a text without words.
RULES = {
    "symbols": "try_divide(n_symbols, n_words)",
    "bangs": "try_divide(n_bangs, n_words)",
    "capitals": "try_divide(n_capitals, word_chars)",
    "same_lines": "try_divide(n_dup_lines, n_lines)",
    "same_words": "try_divide(n_repeat_words, n_words)",
    "few_kinds": "1 - try_divide(n_distinct, n_words)",
}
#: Cutoffs of every rule, most lenient first.
CUTOFFS = [0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.05]


def measures(docs: DataFrame, *, id_col="doc_id", text_col="text", stratum_col="lang") -> DataFrame:
    """One row of counts for each row of ``docs``; all from its whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    own = own.withColumn("words", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))
    own = own.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    n = F.size("words")
    # the hash of each 8-word window; struct fields in order
    parts = [F.slice("words", k + 1, F.greatest(n - GRAM + 1, F.lit(0))).alias(f"w{k}") for k in range(GRAM)]
    own = own.withColumn("windows", F.when(n >= GRAM, F.transform(F.arrays_zip(*parts), lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    # windows found twice or more; their words, overlaps once
    placed = F.expr("array_sort(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))")
    own = own.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    starts = F.expr(
        """array_sort(transform(filter(transform(placed, (x, k) -> named_struct('i', x.i, 'twice',
             coalesce(get(placed, k - 1).h = x.h, false) or coalesce(get(placed, k + 1).h = x.h, false))), y -> y.twice), y -> y.i))"""
    )
    own = own.withColumn("starts", starts)
    covered = F.expr(f"aggregate(transform(starts, (i, k) -> least({GRAM}, coalesce(get(starts, k + 1), i + {GRAM}) - i)), 0L, (a, x) -> a + x)")
    bare = F.translate("text", SPACES, "")
    return own.select(
        "doc_id",
        "stratum",
        n.cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_bangs"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.xxhash64("text").alias("text_key"),
    )


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_values() -> list:
    return [F.coalesce(F.expr(e), F.lit(0.0)).cast("double").alias(r) for r, e in RULES.items()]


def binomial_tail(n, x, p):
    """P(X <= x) for X ~ Bin(n, p), summed term by term; 1 if x is not below the mean.

    The last term is kept as a logarithm and the sum as a multiple of it, so that
    neither vanishes where n is large.
    """
    zero = F.lit(0).cast("long")
    terms = F.aggregate(
        F.sequence(zero, F.greatest(x, zero)),
        F.struct((n * F.log1p(-p)).alias("log"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct(
            (a["log"] + F.when(j > 0, F.log((n - j + 1) / j * p / (1 - p))).otherwise(0.0)).alias("log"),
            (1 + a["sum"] * F.when(j > 0, j * (1 - p) / ((n - j + 1) * p)).otherwise(0.0)).alias("sum"),
        ),
        lambda a: F.least(F.exp(a["log"] + F.log(a["sum"])), F.lit(1.0)),
    )
    return F.when(x >= n * p, F.lit(1.0)).otherwise(terms)


def is_tuning(key="text_key"):
    """A quarter of the labelled texts tunes, the rest is the holdout."""
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(4)) == 0


def certified_cutoffs(measured: DataFrame, labels: DataFrame, *, risk: float = 0.03, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): the cutoffs that hold; ``labels`` has doc_id and quality (1 good).

    A text of a stratum has one vote, bad if any of its documents is; repeated rows and copies add nothing.
    """
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("good"))
    own = measured.where(~base_failed()).join(known, F.col("doc_id") == F.col("_id"))
    own = own.groupBy("stratum", "text_key").agg(F.min("good").alias("good"), F.max(F.struct(*rule_values())).alias("v"))
    own = own.select("stratum", "good", is_tuning().alias("tuning"), "v")
    chosen = _tuned(own.where("tuning"), risk)

    # a good holdout row is lost from the first rule on that it fails
    safe = own.where("not tuning and good = 1")
    ordered = chosen.groupBy(F.col("stratum").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("place", "rule", "cutoff"))).alias("tried"))
    held_out = safe.join(ordered, F.col("stratum").eqNullSafe(F.col("_s")))
    values = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(f"v.{r}"))])
    fails = held_out.withColumn("values", values)
    lost_at = F.array_min(F.transform(F.filter("tried", lambda t: F.col("values")[t["rule"]] > t["cutoff"]), lambda t: t["place"]))
    each = fails.withColumn("lost_at", lost_at).select("stratum", "lost_at", F.explode("tried").alias("t"))
    counts = each.groupBy("stratum", "t.place", "t.rule", "t.cutoff").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("lost_at") <= F.col("t.place"), 1)).alias("lost")
    )
    enough = safe.groupBy("stratum").agg(F.count("*").alias("n")).where(F.pow(F.lit(1 - risk), F.col("n")) <= delta)
    strata = enough.agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    passes = (binomial_tail(F.col("n"), F.col("lost"), F.lit(risk)) <= delta / F.col("strata")).cast("int")
    order = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    tested = counts.join(F.broadcast(strata), F.lit(True)).withColumn("held", F.min(passes).over(order))
    return tested.where("held = 1").select("stratum", "rule", "cutoff")


def _tuned(own: DataFrame, risk: float) -> DataFrame:
    """(stratum, rule, cutoff, place): the cutoff each rule would have, and its place in the order of testing."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"v.{r}").alias("value")) for r in RULES])
    long = own.select("stratum", "good", F.explode(rules).alias("x"))
    steps = [
        F.struct(
            F.lit(k).alias("step"),
            F.lit(c).alias("cutoff"),
            F.count(F.when((F.col("good") == 1) & (F.col("x.value") > c), 1)).alias("lost"),
            F.count(F.when((F.col("good") == 0) & (F.col("x.value") > c), 1)).alias("caught"),
        )
        for k, c in enumerate(CUTOFFS)
    ]
    counts = long.groupBy("stratum", "x.rule").agg(F.count(F.when(F.col("good") == 1, 1)).alias("n"), F.array(*steps).alias("steps"))
    each = counts.select("stratum", "rule", "n", F.explode("steps").alias("s")).select("stratum", "rule", "n", "s.*")
    useful = each.where((F.col("caught") > 0) & (F.col("lost") <= F.lit(risk / len(RULES)) * F.col("n")))
    best = F.max(F.struct("caught", (-F.col("lost")).alias("kept"), (-F.col("step")).alias("lenient"), "cutoff")).alias("best")
    best = useful.groupBy("stratum", "rule").agg(best)
    order = Window.partitionBy("stratum").orderBy(F.desc("best.caught"), F.desc("best.kept"), "rule")
    return best.select("stratum", "rule", F.col("best.cutoff").alias("cutoff"), F.row_number().over(order).alias("place"))


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", stratum_col="lang", **how) -> DataFrame:
    """The measures of every row of ``docs`` with base_failed, kept and failed_rules.

    Null text has no words, so it fails the fixed rules. Rows with a null stratum
    form one of their own. Labels that contradict each other count as bad; labels of
    unknown documents do nothing. Repeated rows get equal results. Empty input: no rows.
    """
    measured = Table(measures(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col)).df
    cutoffs = certified_cutoffs(measured, labels, **how)
    wide = cutoffs.groupBy(F.col("stratum").alias("_s")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    values = measured.select("*", *[v.alias(f"v_{r}") for r, v in zip(RULES, rule_values(), strict=True)])
    joined = values.join(wide, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(f"v_{r}") > F.col(f"_{r}"), F.lit(r)) for r in RULES]))
    out = joined.withColumn("failed_rules", F.array_join(failed, ",")).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    return out.select(*[c for c in measured.columns if c != "text_key"], "base_failed", "kept", "failed_rules")
