"""The programming interface: load, generate, transform, summarise, plot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from .operators import project, rows, stats
from .plans.blocks import view
from .sources import files, generate
from .table import Table, TableError, View

PLOTS = {"scatter": (2, " "), "line": (2, ","), "histogram": (1, "\n"), "pointcloud": (2, " ")}


class Studio:
    """Operators by name over one Spark session. Nothing runs until rows or text are asked for, but for checks that need a few
    numbers (a file's header, a list's length)."""

    def __init__(self, spark: SparkSession, paths: dict[str, str] | None = None, notify: Callable[[str], None] = print):
        self.spark, self.paths, self.notify, self.params = spark, dict(paths or {}), notify, {}

    def load(self, path: str) -> Table:
        return files.load_file(self.spark, self.paths.get(path, path))

    def load_csv(self, text: str) -> Table:
        return files.delimited_table(files.lines_in(self.spark, text), "text")

    def load_xyz(self, text: str) -> Table:
        return files.delimited_table(files.lines_in(self.spark, text), "text", files.XYZ_NAMES)

    def load_json(self, text: str) -> Table:
        return files.json_table(self.spark, self.spark.createDataFrame([(text,)], "value string"), "text")

    def random(self, count: float, seed: int = 1) -> Table:
        return generate.random_data(self.spark, count, seed)

    def range(self, start: float, stop: float, step: float = 1) -> Table:
        return generate.range_data(self.spark, start, stop, step)

    def grid(self, size: float = 10) -> Table:
        return generate.grid_data(self.spark, size)

    def normalize(self, t: Table, column: str, mode: str = "minmax") -> Table:
        return project.normalize(t, column, mode, unique=False)

    def sort(self, t: Table, column: str, order: str = "asc") -> Table:
        return rows.sort_rows(t, column, order == "desc")

    def select(self, t: Table, columns: list[str]) -> Table:
        return project.select_columns(t, columns)

    def rename(self, t: Table, old: str, new: str) -> Table:
        return project.rename_column(t, old, new)

    def add_column(self, t: Table, name: str, values: list[float]) -> Table:
        return project.add_values(t, name, values)

    def filter(self, t: Table, column: str, op: str, value: float) -> Table:
        return rows.filter_where(t, column, op, value)

    def top_k(self, t: Table, column: str, k: float, mode: str = "largest") -> Table:
        return rows.top_k(t, column, k, mode != "smallest")

    def math(self, t: Table, op: str, column: str, other: str | float | None = None) -> Table:
        return project.unary(t, op, column) if other is None else project.binary(t, op, column, other)

    def summary(self, t: Table, column: str) -> Table:
        return stats.summary(t, column)

    def histogram(self, t: Table, column: str, bins: int = 10) -> Table:
        return stats.histogram_table(t, column, bins, clamped=False)

    def plot(self, kind: str, t: Table, **columns: str) -> View:
        if kind not in PLOTS:
            raise TableError(f"no such plot {kind!r}")
        n, separator = PLOTS[kind]
        chosen = [columns[k] for k in ("column", "x", "y") if columns.get(k)] or t.numeric()[:n]
        extra = {"scatter": "color", "pointcloud": "z"}.get(kind)
        if extra and columns.get(extra):
            chosen.append(columns[extra])
        return view(kind, t, chosen, separator)

    def get_param(self, name: str, default=None):
        return self.params.get(name, default)

    def set_param(self, name: str, value) -> None:
        self.params[name] = value


#: Methods that programs may call by name.
CALLS = frozenset(m for m in vars(Studio) if not m.startswith("_"))
