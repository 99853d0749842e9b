"""Summaries and histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INF, real
from ..functions.ranking import with_scalars
from ..functions.selection import selected
from ..table import ROW, Table, TableError
from .charts import midpoint_places

STATS = ("mean", "std", "min", "max", "median")


def _four(c: Column, name: str) -> list[Column]:
    """Mean, population deviation and bounds without NaN; zeros for no rows."""
    sound = F.when(~F.isnan(c), c)
    return [F.coalesce(e, F.lit(0.0)).alias(f"{name}__{s}") for s, e in zip(STATS, (F.avg(c), F.stddev_pop(c), F.min(sound), F.max(sound)))]


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of exact medians (NaN last; 0 for no values), each the mean of the two values around the middle."""
    melted = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("_column"), real(F.col(c)).alias("_value")) for k, c in enumerate(columns)))).alias("c")).select("c.*")
    found = selected(melted, "_column", "_value", midpoint_places({"m": 0.5}), keep_nan=True)
    middle = (F.col("m_lo") + F.col("m_hi")) / 2
    return found.agg(*(F.coalesce(F.max(F.when(F.col("_column") == k, middle)), F.lit(0.0)).alias(f"{c}__median") for k, c in enumerate(columns)))


def summarize(df: DataFrame, columns: list[str]) -> DataFrame:
    """stat and a column for each input column; five rows."""
    one = df.agg(*(x for c in columns for x in _four(real(F.col(c)), c))).crossJoin(F.broadcast(medians(df, columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias(ROW), F.lit(s).alias("stat"), *(F.col(f"{c}__{s}").alias(c) for c in columns)) for k, s in enumerate(STATS))))
    return one.select(rows.alias("r")).select("r.*")


def summary(t: Table, column: str | None = None) -> Table:
    columns = [t.need(column, numeric=True)] if column else t.numeric()
    if not columns:
        raise TableError("no numeric columns")
    return Table(summarize(t.df, columns), t.name, (), f"summary:{','.join(columns)}")


def clamp_bins(bins: float, most: int = 10_000) -> int:
    return 10 if bins != bins or abs(bins) == INF else min(most, max(1, math.floor(bins)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, center, count (double) for every bin from the least to the greatest value. NaN is not counted; with infinite values,
    or none, all centers and counts are 0; equal values lie in the first of bins of width 1 / bins."""
    if bins < 1:
        raise TableError("at least one bin")
    v = real(F.col(column))
    sound = F.when(~F.isnan(v), v)
    rows = with_scalars(df.select(v.alias("_v")), F.min(F.when(~F.isnan("_v"), F.col("_v"))).alias("_low"), F.max(F.when(~F.isnan("_v"), F.col("_v"))).alias("_high"))
    span = F.when(F.col("_high") == F.col("_low"), F.lit(1.0)).otherwise(F.col("_high") - F.col("_low"))
    step = span / bins
    finite = (F.abs(F.col("_low")) < INF) & (F.abs(F.col("_high")) < INF)
    counted = rows.where(finite & ~F.isnan("_v")).groupBy(F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_low")) / step)).alias("bin")).agg(F.count("*").cast("double").alias("count"))
    limits = df.agg(F.min(sound).alias("_low"), F.max(sound).alias("_high"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(limits))
    center = F.when(finite, F.col("_low") + step * (F.col("bin") + 0.5)).otherwise(F.lit(0.0))
    return every.select("bin", center.alias("center")).join(F.broadcast(counted), "bin", "left").select("bin", "center", F.coalesce("count", F.lit(0.0)).alias("count"))


def histogram_table(t: Table, column: str, bins: float, clamped: bool = True) -> Table:
    n = clamp_bins(bins) if clamped else int(bins)
    rows = histogram(t.df, t.need(column, numeric=True), n)
    return Table(rows.select(F.col("bin").alias(ROW), "center", "count"), t.name, (), f"histogram:{column}:{n}")


def histogram_chart(df: DataFrame, column: str, bins: float = 30) -> DataFrame:
    """The chart's binning: the place in the span times the number of bins, at least 2, rounded. bin, count, and log_height, the
    count on a log2 scale up to 1."""
    n = max(2, math.floor(bins + 0.5))
    rows = with_scalars(df.select(real(F.col(column)).alias("_v")).where(~F.isnan("_v")), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    span = F.when(F.col("_high") == F.col("_low"), F.lit(1.0)).otherwise(F.col("_high") - F.col("_low"))
    at = F.least(F.lit(n - 1), F.floor((F.col("_v") - F.col("_low")) / span * n))
    counted = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(n).withColumnRenamed("id", "bin").join(F.broadcast(counted), "bin", "left").fillna(0, ["count"])
    return with_scalars(every, F.max("count").alias("_top")).select("bin", "count", F.when(F.col("_top") == 0, F.lit(0.0)).otherwise(F.log2(F.col("count") + 1.0) / F.log2(F.col("_top") + 1.0)).alias("log_height"))


def histogram_between(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """bin and count over [low, high]; what lies outside, and NaN, is dropped; no width: all in the first bin."""
    v = real(F.col(column))
    at = F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins)) if high > low else F.lit(0).cast("long")
    counted = df.where((v >= low) & (v <= high) & ~F.isnan(v)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counted), "bin", "left").fillna(0, ["count"])


def extents(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of least and greatest values, NaN left out."""
    return df.agg(*(f(F.when(~F.isnan(real(F.col(c))), real(F.col(c)))).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def series_stats(df: DataFrame, series: str, value: str) -> DataFrame:
    """count, min, max and mean of each series."""
    v = real(F.col(value))
    return df.groupBy(series).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))


def series_scaled(df: DataFrame, series: str, value: str, out: str = "scaled", radius: bool = False) -> DataFrame:
    """Each value within its series: from 0 to 1 by the series' bounds (a span of 0 counts as 1), or as a radius over the
    greatest absolute value, at least 1. Bounds come from a pre-aggregated group-by, so a large series stays spread out."""
    v = real(F.col(value))
    if radius:
        bounds = df.groupBy(series).agg(F.greatest(F.lit(1.0), F.max(F.abs(v))).alias("_r"))
        return df.join(bounds, series).withColumn(out, v / F.col("_r")).drop("_r")
    bounds = df.groupBy(series).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    span = F.when(F.col("_b") == F.col("_a"), F.lit(1.0)).otherwise(F.col("_b") - F.col("_a"))
    return df.join(bounds, series).withColumn(out, (v - F.col("_a")) / span).drop("_a", "_b")
