"""The standard blocks."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import project, rows, stats
from ..sources import generate
from ..table import Table, TableError, View
from .graph import Block, Registry

T = {"table": "DataTable"}


def view(kind: str, t: Table, columns: list[str], separator: str, **options) -> View:
    return View(kind, t, tuple(t.need(c, numeric=True) for c in columns), options, separator)


def standard(spark: SparkSession, files: dict[str, str] | None = None) -> Registry:
    """Sources, transforms, filters, arithmetic, statistics and views. files: what source.file finds, name to path."""

    def table_block(name: str, params: dict, f) -> Block:
        return Block(name, T, T, params, lambda i, p: {"table": f(i["table"], p)})

    def source(name: str, params: dict, f) -> Block:
        return Block(name, {}, T, params, lambda i, p: {"table": f(p)})

    def load(p: dict) -> Table:
        from ..sources.files import load_file

        name = str(p["fileName"]).strip()
        if not name:
            raise TableError("no file chosen")
        if name not in (files or {}):
            raise TableError(f"no file {name!r}")
        return load_file(spark, files[name])

    def other(i: dict, p: dict) -> str | float:
        return p["other"] if p.get("other") else float(p["value"])

    def view_block(name: str, kind: str, params: dict, separator: str) -> Block:
        def f(i: dict, p: dict) -> dict:
            columns = [p[c] for c in params if p[c]]
            return {"view": view(kind, i["table"], columns, separator)}

        return Block(name, T, {"view": "RenderedView"}, params, f)

    blocks = [
        source("source.example_data", {"count": 100, "seed": 1}, lambda p: generate.example_data(spark, p["count"], p["seed"])),
        source("source.generate_random", {"count": 100, "seed": 0}, lambda p: generate.random_data(spark, p["count"], p["seed"])),
        source("source.generate_grid", {"size": 10}, lambda p: generate.grid_data(spark, p["size"])),
        source("source.file", {"fileName": ""}, load),
        table_block("transform.select_columns", {"columns": ""}, lambda t, p: project.select_columns(t, p["columns"] if isinstance(p["columns"], list) else [c.strip() for c in p["columns"].split(",") if c.strip()])),
        table_block("transform.rename_column", {"from": "", "to": ""}, lambda t, p: project.rename_column(t, p["from"], p["to"])),
        table_block("transform.add_column", {"name": "column", "value": 0}, lambda t, p: project.add_constant(t, p["name"], p["value"])),
        table_block("transform.normalize", {"column": "", "mode": "minmax"}, lambda t, p: project.normalize(t, p["column"], p["mode"])),
        table_block("transform.sort", {"column": "", "order": "asc"}, lambda t, p: rows.sort_rows(t, p["column"], p["order"] == "desc")),
        table_block("filter.range", {"column": "", "min": 0, "max": 1}, lambda t, p: rows.filter_range(t, p["column"], p["min"], p["max"])),
        table_block("filter.value", {"column": "", "value": 0}, lambda t, p: rows.filter_value(t, p["column"], p["value"])),
        table_block("filter.top_k", {"column": "", "k": 10, "mode": "largest"}, lambda t, p: rows.top_k(t, p["column"], p["k"], p["mode"] != "smallest")),
        *(table_block(f"math.{name}", {"column": "", "other": "", "value": 0}, lambda t, p, op=op: project.binary(t, op, p["column"], other({}, p))) for name, op in (("add", "add"), ("subtract", "sub"), ("multiply", "mul"), ("divide", "div"))),
        *(table_block(f"math.{op}", {"column": ""}, lambda t, p, op=op: project.unary(t, op, p["column"])) for op in ("sqrt", "abs")),
        table_block("stats.summary", {}, lambda t, p: stats.summary(t)),
        table_block("stats.histogram", {"column": "", "bins": 10}, lambda t, p: stats.histogram_table(t, p["column"], p["bins"])),
        view_block("viz.scatter", "scatter", {"x": "", "y": "", "color": ""}, " "),
        view_block("viz.line", "line", {"x": "", "y": ""}, ","),
        view_block("viz.histogram", "histogram", {"column": ""}, "\n"),
        view_block("viz.point_cloud_2d", "pointcloud", {"x": "", "y": ""}, " "),
    ]
    return Registry(blocks)
