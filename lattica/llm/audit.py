"""What filters do to each other: every order of a set of filters, in one evaluation.

A document is a mask of the filters that it fails. Documents of one group, mask and label are one cell with a count, and all that
follows works on cells, of which there are at most 2**filters x labels in a group. Cells are unpivoted against the steps of all
orders into long form: one row for a cell, an order and a step. A running bit-or over an order's earlier steps says what would
have removed the cell before; conditional sums over the cells give a step's figures, and a window over a filter's rows adds up its
removals over all orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, fresh, table

METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def seen_before(docs: DataFrame) -> DataFrame:
    """doc_id, part, good, toxic and mask of `docs`, and `again`: whether a row of smaller doc_id has the same `digest`.

    The smallest id of a digest is found by an aggregation that tasks begin before the shuffle, so a text that a third of the rows
    have is one row of each task. Rows then meet these firsts by their own id, not by the digest: no hot key. A null id has no
    order: it is never again, and no other row is because of it. Rows of one id and one text are not again because of each other.
    """
    firsts = docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return docs.join(firsts, ["doc_id", "digest"], "left").withColumn("again", F.col("doc_id").isNotNull() & F.col("first").isNull()).drop("first", "digest")


def masked(docs: DataFrame, failing: dict[str, Column], part: str, repeats: str | None, labels: DataFrame) -> DataFrame:
    """A row for each row of docs: part (string, null: empty), mask (bit k: the k-th filter fails), good, toxic (booleans).

    failing: a condition on each text that fails a filter, over columns of docs; null does not fail. repeats: the name of one more
    filter, of which a text fails that equals one of a smaller doc_id anywhere in docs (null and empty texts are equal). Names are
    sorted to give bits. labels: doc_id, good, toxic; an id with several rows has what any of them says. Unlabelled rows are
    neither. Texts are read once; what is shuffled are masks, ids and digests of 256 bits.
    """
    names = sorted([*failing, *([repeats] if repeats else [])])
    bit = {name: 1 << k for k, name in enumerate(names)}
    mask = sum((F.when(c, bit[n]).otherwise(0) for n, c in failing.items()), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    if repeats:
        rows = seen_before(durable(rows)).withColumn("mask", F.col("mask") + F.when(F.col("again"), bit[repeats]).otherwise(0))
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return rows.join(labels, "doc_id", "left").select("part", "mask", *known)


def cells(rows: DataFrame) -> DataFrame:
    """Rows counted by part, mask, good and toxic."""
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def audited(counts: DataFrame, names: list[str]) -> DataFrame:
    """A row for each part, order of the filters (`filter_order`, names joined) and step (from 1), zeros included.

    kept: left after this step; removed: by this step; redundant: failing its filter, gone before; unique_fails: failing its filter
    and no other; good_lost, toxic_lost: removed here and labelled so; shapley: what its filter removes, over all orders. counts:
    part, mask, good, toxic, n, with the bits of the sorted names. Orders grow as the factorial of the filters: five make 120,
    more than eight are refused. No documents: no rows.
    """
    names = sorted(names)
    if len(names) > 8:
        raise ValueError("at most eight filters")
    orders = F.array(*(F.lit("".join(p) if all(len(n) == 1 for n in names) else ",".join(p)) for p in permutations(names)))
    split = "" if all(len(n) == 1 for n in names) else ","
    bits = F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, 1 << k)))
    long = (
        counts.withColumn("filter_order", F.explode(orders))
        .select("*", F.posexplode(F.split("filter_order", split)).alias("at", "filter"))
        .where("filter != ''")
        .withColumn("step", (F.col("at") + 1).cast("int"))
        .withColumn("bit", bits[F.col("filter")])
        .withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    )
    earlier = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("gone", F.coalesce(F.bit_or("fails").over(earlier), F.lit(0)) != 0)
    fails = F.col("fails") != 0
    removed = fails & ~F.col("gone")
    add = lambda which, name: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).alias(name)
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        add(~fails & ~F.col("gone"), "kept"),
        add(removed, "removed"),
        add(fails & F.col("gone"), "redundant"),
        add(F.col("mask") == F.col("bit"), "unique_fails"),
        add(removed & F.col("good"), "good_lost"),
        add(removed & F.col("toxic"), "toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).select("part", "filter_order", "step", *METRICS)


def interactions(docs: DataFrame, failing: dict[str, Column], labels: DataFrame, part: str = "lang", repeats: str | None = None) -> DataFrame:
    """`audited` over the filters of `masked`."""
    return audited(cells(masked(docs, failing, part, repeats, labels)), [*failing, *([repeats] if repeats else [])])


def text_measures(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """docs with a column of words, and conditions on its texts: A under 200 words, B fewer than half of the words distinct, C more
    than 3 % capitals, D one of the signs #$%&*|. Null texts are empty; empty ones fail A alone."""
    (words,) = fresh(docs, "words")
    text = F.coalesce("text", F.lit(""))
    n = F.size(words)
    return docs.withColumn(words, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * (F.size(F.split(text, "[A-Z]")) - 1) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    docs, failing = text_measures(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return interactions(docs, failing, labels, "lang", "E")
