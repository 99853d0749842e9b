"""Generated tables; rows carry their place, and any place can be computed on its own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import INF, lcg
from ..table import ROW, Table

MOST_ROWS, MOST_SIDE = 10_000_000, 1_000  # of the blocks; callers may set another bound
PART_ROWS = 10_000_000  # rows that a task makes
TALL, WIDE = 4096, 128  # values of x and of y in a tile of a grid


def clamp_count(value: float, fallback: int, most: int) -> int:
    """floor(value) between 1 and most; the fallback for NaN and infinities."""
    v = float(value)
    return fallback if v != v or abs(v) == INF else min(most, max(1, math.floor(v)))


def clamp_counts(value: Column, fallback: int, most: int) -> Column:
    """The same of a column."""
    v = value.cast("double")
    whole = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most))))))
    return F.when(F.isnan(v) | (F.abs(v) == INF), F.lit(fallback)).otherwise(whole).cast("long")


def places(spark: SparkSession, n: int) -> DataFrame:
    """id from 0 to n - 1, in as many parts as they need."""
    return spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, math.ceil(n / PART_ROWS)))


def example_data(spark: SparkSession, count: float = 100, seed: int = 1, most: int = MOST_ROWS) -> Table:
    """t around the circle once, and x = sin t with noise of +-0.1."""
    n = clamp_count(count, 100, most)
    t = F.col("id") / n * (2 * math.pi)
    rows = places(spark, n).select(F.col("id").alias(ROW), t.alias("t"), (F.sin(t) + (lcg(F.col("id"), seed) - 0.5) * 0.2).alias("x"))
    return Table(rows, "example", (), f"example:{n}")


def random_data(spark: SparkSession, count: float = 100, seed: int = 0, most: int = MOST_ROWS) -> Table:
    n = clamp_count(count, 100, most)
    return Table(places(spark, n).select(F.col("id").alias(ROW), lcg(F.col("id"), seed).alias("x")), "random", (), f"random:{n}")


def grid_data(spark: SparkSession, size: float = 10, most: int = MOST_SIDE) -> Table:
    """size^2 rows: x slow, y fast. They are made tile by tile (TALL values of x, WIDE ones of y), so that columns that follow from x
    and y have few values within many rows, in patterns of which files hold one."""
    n = clamp_count(size, 10, most)

    def parted(c: Column, by: int | Column) -> tuple[Column, Column]:
        by = F.lit(by).cast("long") if isinstance(by, int) else by
        return F.call_function("div", c, by), c % by

    block, i = parted(F.col("id"), n * TALL)
    x0 = block * TALL
    strip, i = parted(i, F.least(F.lit(TALL), n - x0) * WIDE)
    y0 = strip * WIDE
    x, y = parted(i, F.least(F.lit(WIDE), n - y0))
    x, y = x0 + x, y0 + y
    rows = places(spark, n * n).select((x * n + y).alias(ROW), x.cast("double").alias("x"), y.cast("double").alias("y"))
    return Table(rows, "grid", (), f"grid:{n}")


def range_data(spark: SparkSession, start: float, stop: float, step: float = 1) -> Table:
    """start, start + step, ... before stop, as column value; a step of 0 counts as 1. Values are start + i * step."""
    step = step or 1
    n = max(0, math.ceil((stop - start) / step))
    return Table(places(spark, n).select(F.col("id").alias(ROW), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("value")), "range", (), f"range:{start}:{stop}:{step}")
