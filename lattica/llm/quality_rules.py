"""Quality rules whose cutoffs carry a guarantee, in DataFrame operations alone.

Each rule rejects a document whose measure is above a cutoff. Which cutoff a stratum of documents gets is a statistical test on
labelled documents: cutoffs are tried from lax to strict, in an order that is fixed beforehand, and one is certified if so few
good documents are rejected that a false rejection rate of `alpha` or more would show as few with a chance below the error level,
by the exact binomial distribution. The first cutoff that fails ends the sequence, so that within one no correction is needed;
between strata and rules the error level is divided (Bonferroni), and the tolerated rate is divided among the rules of a stratum.
All certified cutoffs hold together, so the choice among them is free: the one that tells bad from good documents best.

With probability 1 - `delta`, no stratum loses more than `alpha` of the good documents that pass the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, fresh, table

WHITE, WORD, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", "[#*$%&|<>]"
WINDOW = 5

#: Rules: an integer measure of a document (null: the rule says nothing), and cutoffs from lax to strict; above is rejected.
RULES: dict[str, tuple[str, list[int]]] = {
    "symbols": ("1000 * n_symbols div n_words", [1000, 700, 500, 300, 200, 150, 100, 70, 50, 30, 20, 10, 5]),
    "repeated_lines": ("1000 * n_dup_lines div n_words", [100, 70, 50, 30, 20, 15, 10, 7, 5, 3, 2, 1, 0]),
    "repeated_words": ("1000 * n_repeat_words div n_words", [180, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10, 0]),
    "long_words": ("100 * word_chars div n_words", [3000, 2000, 1500, 1200, 1000, 900, 800, 750, 700, 650, 600]),
    "short_words": ("-(100 * word_chars div n_words)", [-100, -150, -200, -250, -300, -350, -400, -450]),
    "few_words": ("-n_words", [-15, -20, -30, -40, -50, -75, -100]),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _places_twice(words: Column, hashes: Column) -> Column:
    """Places of windows whose words stand in another window too, in order. Hashes bring equal windows together, words decide."""

    def twice(order: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x.h == y.h) & (F.slice(words, x.i + 1, WINDOW) == F.slice(words, y.i + 1, WINDOW)), F.lit(False))

        return F.filter(order, lambda x, k: same(x, F.get(order, k - 1)) | same(x, F.get(order, k + 1)))

    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.sort_array(F.transform(_let(order, twice), lambda x: x.i))


def _covered(places: Column) -> Column:
    """Words that windows at these places cover."""
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda s, i: F.struct(i.alias("last"), (s.n + F.least(F.lit(WINDOW), i - s.last)).alias("n")), lambda s: s.n)


def measured(docs: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """doc_id, stratum (a string, null: empty) and the measures of each row's whole text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line) and
    n_repeat_words (words within five-word windows that the text has twice or more). A null text is empty and has zeros. Repeated
    rows stay, each a row; ids are kept as they are; other columns are left out. Nothing is shuffled: a text's windows meet in
    its own row, so memory follows the longest text.
    """
    own = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    split = texts.select(
        "doc_id",
        "stratum",
        F.array_remove(F.split("text", WHITE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        (F.size(F.split("text", SYMBOL)) - 1).cast("long").alias("n_symbols"),
    )
    windows = F.when(F.size("words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))
    )
    hashed = split.select(
        "doc_id", "stratum", "words", windows.alias("hashes"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")
    )
    repeats = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(_places_twice(F.col("words"), F.col("hashes")))).otherwise(0)
    return hashed.select("doc_id", "stratum", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeats.cast("long").alias("n_repeat_words"))


def log_binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """Natural logarithm of the chance of at most k events among n, each with this rate (between 0 and 1). 0 where k is at least the
    mean, since such a tail is never small. Terms are added up from the last, the largest, in which they are at most 1."""
    odds = math.log(rate) - math.log1p(-rate)
    ln = lambda x: F.ln(x.cast("double"))
    # ln of C(n, k) and of the k-th term, then ratios of the terms before it
    choose = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.lit(0.0), lambda s, j: s + ln(n - k + j) - ln(j))
    last = F.when(k > 0, choose).otherwise(0.0) + k * F.lit(odds) + n * F.lit(math.log1p(-rate))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, j: Column) -> Column:  # j: k, k-1, ... 1; the term of j - 1 events from that of j
        term = s.term * j / (n - j + 1) * F.lit(math.exp(-odds))
        return F.struct(term.alias("term"), (s.sum + term).alias("sum"))

    sums = F.when(k > 0, F.aggregate(F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long")), start, add, lambda s: s.sum)).otherwise(1.0)
    return F.when(k >= n * F.lit(rate), 0.0).otherwise(last + F.ln(sums))


def _rejected(rule: str, cutoff: Column | int) -> Column:
    return F.coalesce(F.expr(RULES_SQL[rule]) > cutoff, F.lit(False))


RULES_SQL = {name: f"CASE WHEN n_words > 0 THEN {measure} END" for name, (measure, _) in RULES.items()}


def tested_cutoffs(passed: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """A row for each stratum with good labelled documents, rule and cutoff: n_good, n_bad (labelled documents), good_rejected,
    bad_rejected, log_p (see log_binomial_tail), certified.

    passed: measured documents that pass the base rules. labels: doc_id and good (boolean); null ids and nulls are no labels, an id
    with several labels is good if all are. Each row of `passed` with a label counts. Labels are pre-aggregated into one row a
    stratum before anything else; without labels there are no rows.
    """
    labels = labels.where("doc_id is not null and good is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("good").alias("good"))
    held = passed.join(labels, "doc_id")
    tests = [(r, step, cut) for r, (_, cuts) in RULES.items() for step, cut in enumerate(cuts)]
    counts = [F.count_if(_rejected(r, cut) & (F.col("good") == good)).alias(f"{r}_{step}_{good}") for r, step, cut in tests for good in (True, False)]
    sums = durable(held.groupBy("stratum").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"), *counts).where("n_good > 0"))
    strata = max(1, sums.count())  # one number
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(step).alias("step"), F.lit(cut).alias("cutoff"), F.col(f"{r}_{step}_True").alias("good_rejected"), F.col(f"{r}_{step}_False").alias("bad_rejected")) for r, step, cut in tests))
    level = math.log(delta / (len(RULES) * strata))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    return (
        sums.select("stratum", "n_good", "n_bad", F.inline(rows))
        .withColumn("log_p", log_binomial_tail(F.col("n_good"), F.col("good_rejected"), alpha / len(RULES)))
        .withColumn("certified", F.min(F.col("log_p") <= level).over(order))
    )


def chosen_cutoffs(tested: DataFrame) -> DataFrame:
    """A row for each stratum: the certified cutoff of each rule (columns named after the rules; null: none) with the greatest share
    of bad documents rejected less that of good ones; of equal ones the laxest, and none where that difference is not above 0."""
    # shares over one denominator, as whole numbers: no rounding decides
    gain = F.col("bad_rejected") * F.col("n_good") - F.col("good_rejected") * F.greatest(F.col("n_bad"), F.lit(1))
    best = tested.where("certified").withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", -F.col("step"))).alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES))


def judged(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row of docs.

    base_failed: under ten words, or more than a fifth of the words repeated. kept: false for these and for documents above a
    certified cutoff of their stratum. A stratum with too few labels to certify anything keeps all that passes the base rules.
    Null texts have no words and fail. No documents: no rows. Measures are written once, as numbers, then joined with the
    labels and the few cutoffs; texts are read once and never shuffled. Columns of docs other than doc_id, text and the stratum
    are left out.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    sizes = durable(measured(docs, stratum).withColumn("base_failed", failed))
    cutoffs = durable(chosen_cutoffs(tested_cutoffs(sizes.where("not base_failed"), labels, alpha, delta))).withColumnRenamed("stratum", "_stratum")
    above = [F.col(r).isNotNull() & _rejected(r, F.col(r)) for r in RULES]
    rejected = above[0]
    for more in above[1:]:
        rejected = rejected | more
    return sizes.join(cutoffs, F.col("stratum") == F.col("_stratum"), "left").select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def keep_passed(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """The rows of docs, all columns, that `judged` keeps. Rows with a null doc_id are judged as others are."""
    (key,) = fresh(docs, "row")
    docs = durable(docs.withColumn(key, F.monotonically_increasing_id()))
    verdicts = judged(docs.select(F.col(key).alias("doc_id"), "text", *([stratum] if stratum else [])), _row_labels(docs, labels, key), stratum, alpha, delta)
    return docs.join(verdicts.where("kept").select(F.col("doc_id").alias(key)), key, "left_semi").drop(key)


def _row_labels(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key)
    return ids.join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "good"), "doc_id").select(F.col(key).alias("doc_id"), "good")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return judged(table(spark, sf_dir, "documents"), labels)
