"""Columns: choose, rename, add, normalise, write out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INF, divide, number_text, real
from ..functions.ranking import with_scalars
from ..table import ROW, Table, TableError, unique_name


def select_columns(t: Table, names: list[str]) -> Table:
    if not names:
        raise TableError("no columns chosen")
    keep = [t.need(n) for n in names]
    return t.then(t.df.select(*keep, *([ROW] if ROW in t.df.columns else [])), f"select:{','.join(names)}")


def rename_column(t: Table, old: str, new: str) -> Table:
    t.need(old)
    if not new.strip():
        raise TableError("the new name is blank")
    if new != old and new in t.columns:
        raise TableError(f"column {new!r} exists")
    return t.then(t.df.withColumnRenamed(old, new), f"rename:{old}->{new}")


def add_constant(t: Table, name: str, value: float) -> Table:
    if not math.isfinite(value):
        raise TableError("a constant is finite")
    return t.then(t.df.withColumn(unique_name(t.columns, name), F.lit(float(value))), f"constant:{name}")


def add_values(t: Table, name: str, values: list[float]) -> Table:
    """Values beside the rows, by place. The values are a driver's list, so this is for tables of its size."""
    if name in t.columns:
        raise TableError(f"column {name!r} exists")
    spark = t.df.sparkSession
    if t.df.count() != len(values):
        raise TableError(f"{len(values)} values for a table of another length")
    from ..functions.ranking import ranked

    rows = ranked(t.ordered(), ROW, rank="_place")
    own = spark.createDataFrame(list(enumerate(map(float, values), 1)), f"_place long, `{name}` double")
    return t.then(rows.join(own, "_place").drop("_place"), f"add:{name}")


def bounds(column: str, name: str) -> list[Column]:
    """Least and greatest of a column, NaN left out, as name_min and name_max."""
    c = real(F.col(column))
    sound = F.when(~F.isnan(c), c)
    return [F.min(sound).alias(f"{name}_min"), F.max(sound).alias(f"{name}_max")]


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """(v - min) / (max - min), NaN rows as they are; 0 everywhere if a bound is infinite, missing or equal to the other."""
    rows = with_scalars(df, *bounds(column, "_v"))
    low, high = F.col("_v_min"), F.col("_v_max")
    flat = low.isNull() | (low == -INF) | (high == INF) | (low == high)
    return rows.withColumn(out, F.when(flat, F.lit(0.0)).otherwise(F.try_divide(real(F.col(column)) - low, high - low))).drop("_v_min", "_v_max")


def zscore(df: DataFrame, column: str, out: str) -> DataFrame:
    """(v - mean) / population deviation; 0 everywhere if the mean is not finite or the deviation is 0."""
    c = real(F.col(column))
    rows = with_scalars(df, F.avg(c).alias("_mean"), F.stddev_pop(c).alias("_std"))
    mean, std = F.col("_mean"), F.col("_std")
    flat = mean.isNull() | F.isnan(mean) | (F.abs(mean) == INF) | F.isnan(std) | (std == 0)
    return rows.withColumn(out, F.when(flat, F.lit(0.0)).otherwise(F.try_divide(c - mean, std))).drop("_mean", "_std")


def normalize(t: Table, column: str, mode: str = "minmax", unique: bool = True) -> Table:
    kinds = {"minmax": minmax, "zscore": zscore}
    if mode not in kinds:
        raise TableError(f"no such mode {mode!r}")
    t.need(column, numeric=True)
    name = f"{column}_{mode}"
    if unique:
        name = unique_name(t.columns, name)
    elif name in t.columns:
        raise TableError(f"column {name!r} exists")
    return t.then(kinds[mode](t.df, column, name), f"normalize:{column}:{mode}")


def scale_columns(df: DataFrame, columns: list[str], deviations: bool = False) -> DataFrame:
    """Each column scaled in place: to [0, 1] by its bounds (a span of 0 counts as 1), or by mean and population deviation (a
    deviation of 0 counts as 1)."""
    if deviations:
        rows = with_scalars(df, *(f(real(F.col(c))).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.avg), ("b", F.stddev_pop))))
        scaled = {c: (real(F.col(c)) - F.col(f"_a_{c}")) / F.when(F.col(f"_b_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_b_{c}")) for c in columns}
    else:
        rows = with_scalars(df, *(f(real(F.col(c))).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))))
        span = {c: F.col(f"_b_{c}") - F.col(f"_a_{c}") for c in columns}
        scaled = {c: (real(F.col(c)) - F.col(f"_a_{c}")) / F.when(span[c] == 0, F.lit(1.0)).otherwise(span[c]) for c in columns}
    return rows.withColumns(scaled).drop(*(f"_{n}_{c}" for c in columns for n in "ab"))


def delimited(t: Table, names: list[str], separator: str = " ") -> str:
    """Numeric columns as text, a line a row, in the table's order; for sinks of bounded size. Larger tables: delimited_rows."""
    lines = delimited_rows(t, names, separator).orderBy(ROW).select("line").collect()
    return "\n".join(r.line for r in lines)


def delimited_rows(t: Table, names: list[str], separator: str = " ") -> DataFrame:
    parts = [number_text(real(F.col(t.need(n, numeric=True)))) for n in names]
    return t.ordered().select(ROW, F.concat_ws(separator, *parts).alias("line"))


BINARY = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divide}
UNARY = {"sqrt": F.sqrt, "abs": F.abs}


def binary(t: Table, op: str, column: str, other: str | float) -> Table:
    """column op (another column or a number), as column_op."""
    a = real(F.col(t.need(column, numeric=True)))
    b = real(F.col(t.need(other, numeric=True))) if isinstance(other, str) else F.lit(float(other))
    return t.then(t.df.withColumn(unique_name(t.columns, f"{column}_{op}"), BINARY[op](a, b)), f"{op}:{column}")


def unary(t: Table, op: str, column: str) -> Table:
    a = real(F.col(t.need(column, numeric=True)))
    return t.then(t.df.withColumn(unique_name(t.columns, f"{column}_{op}"), UNARY[op](a)), f"{op}:{column}")
