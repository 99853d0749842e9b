"""A table as a value: a DataFrame, where its rows stand, and where it came from."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__row"  # the place of a row, where rows have one
NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)


class TableError(ValueError):
    """A table or column that an operator can't work on."""


@dataclass(frozen=True)
class Table:
    """df with a hidden column ROW; all operators keep ROW's order as the table's order."""

    df: DataFrame
    name: str = ""
    tags: tuple[str, ...] = ()
    provenance: str = ""

    def __post_init__(self) -> None:
        names = self.columns
        if not names:
            raise TableError("a table has at least one column")
        if len({n.lower() for n in names}) < len(names):
            raise TableError(f"column names repeat: {names}")

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    def numeric(self) -> list[str]:
        return [f.name for f in self.df.schema if f.name != ROW and isinstance(f.dataType, NUMERIC)]

    def need(self, name: str, numeric: bool = False) -> str:
        if name not in self.columns:
            raise TableError(f"no column {name!r}; there are {', '.join(self.columns)}")
        if numeric and name not in self.numeric():
            raise TableError(f"column {name!r} is not numeric")
        return name

    def then(self, df: DataFrame, step: str) -> Table:
        return replace(self, df=df, provenance=f"{self.provenance} > {step}" if self.provenance else step)

    def ordered(self) -> DataFrame:
        """With ROW: rows that have no place yet get one from their file position."""
        return self.df if ROW in self.df.columns else self.df.withColumn(ROW, F.monotonically_increasing_id())

    def to_df(self) -> DataFrame:
        return self.df.drop(ROW)

    def previewed(self, rows: int = 20) -> DataFrame:
        """The same as a table of text, without the driver."""
        from .functions.numeric import shown_text

        top = self.ordered().orderBy(ROW).limit(rows)
        return top.select(ROW, *(shown_text(F.col(f.name), f.dataType).alias(f.name) for f in top.schema if f.name != ROW))

    def preview(self, rows: int = 20) -> list[dict]:
        """The first rows, for display: numbers to four decimals, infinities and NaN as signs."""
        top = self.ordered().orderBy(ROW).limit(rows).drop(ROW).collect()
        return [{k: shown(v) for k, v in r.asDict().items()} for r in top]


def shown(value) -> str:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "∞" if value > 0 else "-∞"
    return str(value) if isinstance(value, int) else f"{value:.4f}".rstrip("0").rstrip(".")


@dataclass(frozen=True)
class View:
    """What a chart needs: its type, columns in drawing order and options. Text is made only when asked for."""

    kind: str
    table: Table
    columns: tuple[str, ...]
    options: dict = field(default_factory=dict)
    separator: str = " "

    def lines(self) -> DataFrame:
        """ROW and line: the same text as rows, for views of any size; `sinks.write_view` writes it in its order."""
        from .operators.project import delimited_rows

        return delimited_rows(self.table, list(self.columns), self.separator)

    def text(self) -> str:
        from .operators.project import delimited

        return delimited(self.table, list(self.columns), self.separator)


def unique_name(existing: list[str], wanted: str) -> str:
    """wanted, or wanted_2, wanted_3, ... if taken."""
    name, k = wanted, 1
    while name in existing:
        k += 1
        name = f"{wanted}_{k}"
    return name
