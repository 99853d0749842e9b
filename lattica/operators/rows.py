"""Rows: filter, sort, take, thin out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import compare
from ..functions.ranking import in_file_order, ranked
from ..table import ROW, Table, TableError


def filter_range(t: Table, column: str, low: float, high: float) -> Table:
    """low <= v <= high; NaN rows go. Both bounds reach a columnar scan."""
    if not (math.isfinite(low) and math.isfinite(high)):
        raise TableError("bounds are finite")
    c = F.col(t.need(column, numeric=True))
    return t.then(t.df.where(c.between(low, high)), f"range:{column}")


def filter_value(t: Table, column: str, value: float) -> Table:
    return t.then(t.df.where(compare("==", F.col(t.need(column, numeric=True)), value)), f"value:{column}")


def filter_where(t: Table, column: str, op: str, value: float) -> Table:
    return t.then(t.df.where(compare(op, F.col(t.need(column, numeric=True)), value)), f"filter:{column}{op}{value}")


def sort_rows(t: Table, column: str, descending: bool = False) -> Table:
    """Stable in both directions; NaN last ascending. The new places follow the new order."""
    c = t.need(column, numeric=True)
    rows = ranked(t.ordered(), c, [F.col(ROW)], rank="_new", descending=descending)
    return t.then(rows.drop(ROW).withColumnRenamed("_new", ROW), f"sort:{column}:{'desc' if descending else 'asc'}")


def top_k(t: Table, column: str, k: float, largest: bool = True) -> Table:
    """The first floor(k) rows of the sorted table; none for k below 1 or no number."""
    n = 0 if k != k else max(0, math.floor(min(k, 2**31 - 1)))
    c = F.col(t.need(column, numeric=True))
    return t.then(t.ordered().orderBy(c.desc() if largest else c.asc(), F.col(ROW)).limit(n), f"top:{column}:{n}")


def first_rows(t: Table, n: int) -> Table:
    return t.then(t.ordered().orderBy(ROW).limit(n), f"first:{n}")


def numbered(df: DataFrame, order: str | None, ties: list | None = None) -> DataFrame:
    """Rows with their _place, from 1, in the order of a column, or, without one, of the files they are scanned from."""
    return ranked(df, order, ties, rank="_place") if order else in_file_order(df, "_place")


def every_nth(df: DataFrame, order: str | None, step: int, ties: list | None = None) -> DataFrame:
    """Rows 0, step, 2 step, ... in the order of a column, or of files (see `numbered`)."""
    return numbered(df, order, ties).where((F.col("_place") - 1) % max(1, step) == 0).drop("_place")


def thinned(df: DataFrame, order: str | None, most: int) -> DataFrame:
    """Every max(1, floor(n / most))-th row."""
    return every_nth(df, order, max(1, df.count() // most))


def resampled(df: DataFrame, order: str | None, k: int) -> DataFrame:
    """k rows, the ones at floor(i n / k) for i below k, numbered `sample`; a row comes several times if k exceeds n."""
    placed = numbered(df, order)
    total = df.count()
    wanted = df.sparkSession.range(k if total else 0).select(F.col("id").alias("sample"), (F.floor(F.col("id") * total / k) + 1).alias("_place"))
    return wanted.join(placed, "_place").drop("_place")


def induced(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target", node: str = "id") -> DataFrame:
    """Edges whose ends are both among nodes."""
    for end in (source, target):
        edges = edges.join(nodes.select(F.col(node).alias(end)).distinct(), end, "left_semi")
    return edges


def inside(df: DataFrame, x: str, y: str, x_low: float, x_high: float, y_low: float, y_high: float) -> DataFrame:
    """Points inside a view box."""
    return df.where(F.col(x).between(x_low, x_high) & F.col(y).between(y_low, y_high))


def one_series(df: DataFrame, series: str, wanted: str = "all") -> DataFrame:
    return df if wanted == "all" else df.where(F.col(series) == wanted)
