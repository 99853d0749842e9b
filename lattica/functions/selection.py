"""Exact order statistics without a sort.

A place in the order of a group's values is found by narrowing. Each round cuts the interval that holds the place into ranges,
counts the values in each, before anything is shuffled, and keeps the range that the place lies in, with its own least and greatest
value. A range of one value is an answer, also where very many rows have that value. Rounds cut evenly by value and evenly by
magnitude in turn, so that neither far outliers nor dense spots need many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import INF, real
from .storage import counted, erased, written

RANGES = 4096
FEW = 1000  # groups whose state the driver hands on


def by_value(v: Column, low: Column, high: Column) -> Column:
    """A range's number, which never falls as v rises. Halves, so that no difference overflows."""
    part = (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.lit(RANGES - 1), F.floor(part * RANGES)).cast("long")


def by_magnitude(v: Column, low: Column, high: Column) -> Column:
    """The same, even in the logarithm: between the ends where both have one sign, else over all doubles, each sign apart."""
    ln = lambda x: F.ln(F.greatest(F.abs(x), F.lit(5e-324)))
    width = F.abs(ln(high) - ln(low))
    part = F.when(width > 0, F.abs(ln(v) - ln(low)) / width).otherwise(0.0)
    one = F.least(F.lit(RANGES - 1), F.floor(part * RANGES)).cast("long")
    far = F.floor((ln(v) + 746) * (RANGES / 1460)).cast("long") + 1
    both = F.when(v == 0, F.lit(0).cast("long")).when(v > 0, far).otherwise(-far)
    return F.when((low > 0) | (high < 0), one).otherwise(both)


def selected(df: DataFrame, group: str, value: str, places: dict[str, Column], keep_nan: bool = False) -> DataFrame:
    """For each group its size n and the values at the given places (from 0, in terms of n) in value order. Nulls and null groups
    are left out; NaN is left out, or comes last with `keep_nan`. What a round leaves is a row for each group and place at most;
    rows are read again in each of the few rounds, and never shuffled but as counts."""
    rows = df.select(F.col(group).alias("_g"), real(F.col(value)).alias("_v")).where("_v is not null and _g is not null")
    if not keep_nan:
        rows = rows.where(~F.isnan("_v"))
    v = F.col("_v")
    finite = F.abs(v) < INF  # also false for NaN, which is greater
    ends = [f(F.when(finite, v)).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n"), F.count_if(finite).alias("_finite"), F.count_if(v == -INF).alias("_least"), F.count_if(v == INF).alias("_most"), *ends)
    first = sizes.limit(FEW + 1).toArrow()
    few = first.num_rows <= FEW
    sizes = df.sparkSession.createDataFrame(first, sizes.schema) if few else written(sizes)
    rows = rows.where(finite)
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), (at.cast("long") - F.col("_least")).alias("at")) for name, at in places.items()))
    state = sizes.where("_finite > 0").select("_g", F.lit(0).cast("long").alias("below"), "low", "high", F.filter(wanted, lambda p: (p.at >= 0) & (p.at < F.col("_finite"))).alias("places"))
    steps: list[DataFrame] = []
    order = Window.partitionBy("_g", "low").orderBy("_range")
    while True:
        state, left = kept(state.where(F.size("places") > 0), few)
        steps.append(state)
        if not left:
            break
        cut = by_value if len(steps) % 2 else by_magnitude
        open_ = state.where("low < high")
        counts = rows.join(F.broadcast(open_) if few else open_, "_g").where(v.between(F.col("low"), F.col("high"))).groupBy("_g", "low", "below", cut(v, F.col("low"), F.col("high")).alias("_range"))
        counts = counts.agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("places").alias("places"))
        upto = F.col("below") + F.sum("_n").over(order)
        counts = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
        inside = F.filter("places", lambda p: (p.at >= F.col("_before")) & (p.at < F.col("_upto")))
        state = counts.select("_g", F.col("_before").alias("below"), F.col("_a").alias("low"), F.col("_b").alias("high"), inside.alias("places"))
    found = steps[0].where("low = high")
    for step in steps[1:]:
        found = found.unionByName(step.where("low = high"))
    found = found.select("_g", F.col("low").alias("_v"), F.explode("places").alias("p")).groupBy("_g").agg(*(F.max(F.when(F.col("p.name") == name, F.col("_v"))).alias(name) for name in places))
    out = sizes.join(found, "_g", "left")

    def answer(name: str, at: Column) -> Column:
        from_most = F.col("_least") + F.col("_finite")
        return F.when(at < F.col("_least"), -INF).when(at < from_most, F.col(name)).when(at < from_most + F.col("_most"), INF).when(at < F.col("n"), float("nan"))

    out, _ = kept(out.select(F.col("_g").alias(group), "n", *(answer(name, at).alias(name) for name, at in places.items()), F.lit(0.0).alias("low"), F.lit(0.0).alias("high")), few)
    erased(sizes, *steps)
    return out.drop("low", "high")


def kept(state: DataFrame, few: bool) -> tuple[DataFrame, int]:
    """A round's state, and how many rows are still open: of few groups a local table, else written to the shared folder."""
    if not few:
        out, seen = counted(state, left=F.count_if(F.col("low") < F.col("high")))
        return out, seen["left"]
    rows = state.toArrow()
    left = sum(a < b for a, b in zip(rows.column("low").to_pylist(), rows.column("high").to_pylist()))
    return state.sparkSession.createDataFrame(rows, state.schema), left
