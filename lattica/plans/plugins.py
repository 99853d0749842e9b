"""Plugins: table in, result out, as functions that SQL can call on any table.

A plugin says which parameters it has, what columns its result has for a table's columns and its parameters, and by which of the
table's columns rows must come together. Then it takes the rows of one such group, one by one, and gives the result. Registered, it
is a table function: `SELECT * FROM name(TABLE(t), param => value)`; Spark asks the plugin for schema and partitioning when it
analyses the query, deals the rows out accordingly, and runs one instance for each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, NumericType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..table import Table, TableError, View


class Plugin:
    """What a plugin defines. An instance sees the rows of one group and keeps what `compute` needs: it should hold sums, not rows."""

    name: str = ""
    params: dict[str, object] = {}

    @classmethod
    def schema(cls, columns: StructType, params: dict) -> StructType:
        """The result's columns. A TableError ends the query's analysis."""
        raise NotImplementedError

    @classmethod
    def groups(cls, params: dict) -> list[str]:
        """Columns by whose values rows come together; none: all rows in one group."""
        return []

    @classmethod
    def order(cls, params: dict) -> list[str]:
        """Columns in whose order a group's rows come."""
        return []

    def __init__(self, params: dict):
        self.update_params(params)

    def update_params(self, params: dict) -> None:
        self.own = params

    def load_data(self, row: Row) -> None:
        raise NotImplementedError

    def compute(self) -> Iterable[tuple]:
        raise NotImplementedError

    @classmethod
    def render(cls, result: Table) -> View:
        """The chart of a result: its numeric columns."""
        return View(cls.name, result, tuple(result.numeric()))


def table_function(plugin: type[Plugin]):
    """The plugin as a table function's class."""
    names = list(plugin.params)

    def chosen(arguments: dict) -> dict:
        return {n: arguments[n] if arguments.get(n) is not None else plugin.params[n] for n in names}

    class Function:
        @staticmethod
        def analyze(rows: AnalyzeArgument, **arguments: AnalyzeArgument) -> AnalyzeResult:
            strange = sorted(set(arguments) - set(names))
            if strange or not rows.isTable:
                raise TableError(f"{plugin.name} takes a table and {', '.join(names)}" + (f", not {', '.join(strange)}" if strange else ""))
            params = chosen({n: a.value for n, a in arguments.items()})
            by = plugin.groups(params)
            return AnalyzeResult(plugin.schema(rows.dataType, params), withSinglePartition=not by, partitionBy=[PartitioningColumn(c) for c in by], orderBy=[OrderingColumn(c) for c in plugin.order(params)])

        def __init__(self) -> None:
            self.own = None

        def eval(self, rows: Row, **arguments) -> None:
            if self.own is None:
                self.own = plugin(chosen(arguments))
            self.own.load_data(rows)

        def terminate(self) -> Iterator[tuple]:
            if self.own is not None:
                yield from self.own.compute()

    return F.udtf(Function)


def register(spark: SparkSession, plugin: type[Plugin]) -> None:
    """The plugin under its name, in this session's SQL."""
    spark.udtf.register(plugin.name, table_function(plugin))


def applied(df: DataFrame, plugin: type[Plugin], **params) -> DataFrame:
    """The plugin's result for a DataFrame."""
    given: dict[str, Column] = {n: F.lit(v) for n, v in params.items()}
    return table_function(plugin)(df.asTable(), **given)


def _number(columns: StructType, name: str) -> str:
    kinds = {f.name: f.dataType for f in columns}
    if not isinstance(kinds.get(name), NumericType):
        raise TableError(f"no numeric column {name!r}; there are {', '.join(kinds)}")
    return name


class Moments(Plugin):
    """moments: n, mean, deviation (of the population), skewness of a numeric column, for each value of another. One pass, in which
    each row moves the sums of powers about the present mean."""

    name = "moments"
    params = {"column": "", "by": ""}

    @classmethod
    def schema(cls, columns: StructType, params: dict) -> StructType:
        _number(columns, params["column"])
        by = [f for f in columns if f.name == params["by"]]
        if not by:
            raise TableError(f"no column {params['by']!r}")
        return StructType([*by, StructField("n", LongType()), *(StructField(c, DoubleType()) for c in ("mean", "deviation", "skewness"))])

    @classmethod
    def groups(cls, params: dict) -> list[str]:
        return [params["by"]]

    def update_params(self, params: dict) -> None:
        super().update_params(params)
        self.key, self.n, self.mean, self.second, self.third = None, 0, 0.0, 0.0, 0.0

    def load_data(self, row: Row) -> None:
        self.key, x = row[self.own["by"]], row[self.own["column"]]
        if x is None:
            return
        before, self.n = self.n, self.n + 1
        step = float(x) - self.mean
        part = step / self.n
        more = step * part * before
        self.mean += part
        self.third += more * part * (self.n - 2) - 3 * part * self.second
        self.second += more

    def compute(self) -> Iterable[tuple]:
        if self.n:
            deviation = math.sqrt(self.second / self.n)
            yield self.key, self.n, self.mean, deviation, self.third / self.n / deviation**3 if deviation else 0.0


class Crossings(Plugin):
    """crossings: how often a numeric column goes through a level, in the order of another column, for each value of a third."""

    name = "crossings"
    params = {"column": "", "by": "", "along": "", "level": 0.0}

    @classmethod
    def schema(cls, columns: StructType, params: dict) -> StructType:
        _number(columns, params["column"])
        by = [f for f in columns if f.name == params["by"]]
        if not by or params["along"] not in columns.names:
            raise TableError("crossings needs columns to group by and to go along")
        return StructType([*by, StructField("rises", LongType()), StructField("falls", LongType())])

    @classmethod
    def groups(cls, params: dict) -> list[str]:
        return [params["by"]]

    @classmethod
    def order(cls, params: dict) -> list[str]:
        return [params["along"]]

    def update_params(self, params: dict) -> None:
        super().update_params(params)
        self.key, self.above, self.rises, self.falls = None, None, 0, 0

    def load_data(self, row: Row) -> None:
        self.key, x = row[self.own["by"]], row[self.own["column"]]
        if x is None:
            return
        above = float(x) > float(self.own["level"])
        if self.above is not None and above != self.above:
            self.rises += above
            self.falls += not above
        self.above = above

    def compute(self) -> Iterable[tuple]:
        yield self.key, self.rises, self.falls


BUILTIN = [Moments, Crossings]
