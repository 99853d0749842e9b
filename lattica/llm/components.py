"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import passed_on
from .common import dropped, durable


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (a, b: long); smallest nodes themselves are left out.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour, until only stars remain:
    a logarithmic number of rounds or so, each written to the shared folder. A node with very many neighbours is pre-aggregated
    and its edges are split by the joins. Nulls and loops are left out; repeated edges count once.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    current = durable(edges.where("a is not null and b is not null and a <> b").select(high, low).distinct())
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = durable(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        more = large.join(lower.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, current = current, durable(lower.select("u", F.col("m").alias("v")).unionByName(more).distinct())
        dropped(before, least, large, lower)
        stars = current.groupBy("u").count().where("count > 1").isEmpty() and current.join(current.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()
        if stars:
            return passed_on(current.select(F.col("u").alias("node"), F.col("v").alias("component")), current)
