"""Columns, rows, numbers and files: literal cases."""

import math
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import numeric
from lattica.functions.ranking import ranked
from lattica.operators import project, rows, stats
from lattica.sources import files, generate
from lattica.studio import Studio
from lattica.table import ROW, Table, TableError, shown, unique_name

NAN, INF = math.nan, math.inf


def table(spark, **columns):
    data = [(i, *r) for i, r in enumerate(zip(*columns.values()))]
    kinds = {k: "string" if isinstance(v[0], str) else "double" for k, v in columns.items()}
    data = [tuple(float(x) if isinstance(x, int) and j else x for j, x in enumerate(r)) for r in data]
    return Table(spark.createDataFrame(data, ", ".join([f"{ROW} long", *(f"{k} {t}" for k, t in kinds.items())])))


def values(t, column):
    return [r[0] for r in t.ordered().orderBy(ROW).select(column).collect()]


def same(got, wanted):
    return len(got) == len(wanted) and all((a != a and b != b) or math.isclose(a, b, abs_tol=1e-4) for a, b in zip(got, wanted))


def test_table_checks(spark):
    with pytest.raises(TableError):
        Table(spark.range(1).drop("id"))
    t = table(spark, x=[1, 2])
    with pytest.raises(TableError):
        t.need("y")
    with pytest.raises(TableError):
        table(spark, s=["a"]).need("s", numeric=True)
    assert unique_name(["x", "x_2"], "x") == "x_3" and unique_name([], "x") == "x"
    assert [shown(v) for v in (1.5, NAN, INF, -INF, 2.0, "a")] == ["1.5", "NaN", "∞", "-∞", "2", "a"]


def test_divide_and_remainder(spark):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (1.0, NAN), (6.0, 4.0), (-7.0, 3.0), (5.0, 0.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = df.select(numeric.divide(F.col("a"), F.col("b")), numeric.remainder(F.col("a"), F.col("b"))).collect()
    assert same([r[0] for r in got], [INF, -INF, -INF, NAN, NAN, 1.5, -7 / 3, INF])
    assert same([r[1] for r in got], [NAN, NAN, NAN, NAN, NAN, 2.0, -1.0, NAN])


@pytest.mark.parametrize("op,wanted", [("==", [1.0]), ("!=", [0.0, 2.0, NAN]), ("<", [0.0]), ("<=", [0.0, 1.0]), (">", [2.0]), (">=", [1.0, 2.0])])
def test_comparisons_with_nan(spark, op, wanted):
    assert same(values(rows.filter_where(table(spark, x=[0, 1, 2, NAN]), "x", op, 1.0), "x"), wanted)


def test_number_lexers(spark):
    words = ["", "1d", "0x10", "12abc", "NaN", "Infinity", " 3 ", "-1.5e2", ".5", "5."]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select(numeric.whole_number(F.col("w")), numeric.prefix_number(F.col("w"))).collect()
    assert [r[0] for r in got] == [None, None, None, None, None, None, 3.0, -150.0, 0.5, 5.0]
    assert [r[1] for r in got] == [None, 1.0, 0.0, 12.0, None, None, 3.0, -150.0, 0.5, 5.0]


def test_streams(spark):
    state, wanted = 7, []
    for _ in range(200):
        state = (state * 1664525 + 1013904223) % 2**32
        wanted.append(state / 4294967295.0)
    assert values(generate.random_data(spark, 200, 7), "x") == wanted

    def mulberry(seed):
        a = seed
        while True:
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = (a ^ a >> 15) * (a | 1) & 0xFFFFFFFF
            t ^= t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF
            yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296.0

    m = mulberry(5)
    assert [r[0] for r in spark.range(50, numPartitions=1).select(numeric.mulberry32(F.col("id"), 5)).collect()] == [next(m) for _ in range(50)]


def test_probit(spark):
    p = [0.5, 0.841344746, 0.158655254, 0.977249868, 1e-6, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(numeric.probit(F.col("p"))).collect()]
    assert same(got[:4], [0, 1, -1, 2]) and abs(got[4] + 4.7534) < 1e-3 and abs(got[5] - 4.7534) < 1e-3


def test_normalize(spark):
    assert same(values(project.normalize(table(spark, x=[1, 2, 3]), "x", "minmax"), "x_minmax"), [0, 0.5, 1])
    assert same(values(project.normalize(table(spark, x=[1, 2, 3]), "x", "zscore"), "x_zscore"), [-1.2247, 0, 1.2247])
    assert values(project.normalize(table(spark, x=[5, 5, 5]), "x", "zscore"), "x_zscore") == [0, 0, 0]
    for mode in ("minmax", "zscore"):
        assert values(project.normalize(table(spark, x=[NAN] * 3), "x", mode), f"x_{mode}") == [0, 0, 0]
    assert same(values(project.normalize(table(spark, x=[0, NAN, 4]), "x"), "x_minmax"), [0, NAN, 1])
    assert values(project.normalize(table(spark, x=[0, INF]), "x"), "x_minmax") == [0, 0]


def test_columns(spark):
    t = table(spark, x=[1, 2], y=[3, 4])
    assert project.select_columns(t, ["y"]).columns == ["y"]
    assert project.rename_column(t, "x", "z").columns == ["z", "y"]
    for bad in (("q", "z"), ("x", "y"), ("x", " ")):
        with pytest.raises(TableError):
            project.rename_column(t, *bad)
    assert values(project.add_values(t, "z", [9, 10]), "z") == [9, 10]
    with pytest.raises(TableError):
        project.add_values(t, "z", [1])
    assert project.add_constant(t, "x", 1).columns == ["x", "y", "x_2"]
    assert values(project.binary(t, "div", "x", 0), "x_div") == [INF, INF]
    assert same(values(project.unary(table(spark, x=[-1, 4]), "sqrt", "x"), "x_sqrt"), [NAN, 2])
    assert project.delimited(t, ["x", "y"]) == "1 3\n2 4"
    assert project.delimited(table(spark, x=[1.5, 1e21, NAN]), ["x"], ",").split("\n")[0] == "1.5"


def test_sort_is_stable_and_top_k(spark):
    t = table(spark, x=[3, 1, 2, 3, 1], k=[0, 1, 2, 3, 4])
    assert values(rows.sort_rows(t, "x"), "k") == [1, 4, 2, 0, 3]
    assert values(rows.sort_rows(t, "x", True), "k") == [0, 3, 2, 1, 4]
    top = rows.top_k(t, "x", 2.9).df.select("k").collect()
    assert [r.k for r in top] == [0, 3]
    assert rows.top_k(t, "x", NAN).df.count() == 0 and rows.top_k(t, "x", -1).df.count() == 0


def test_thinning(spark):
    df = spark.range(10)
    assert sorted(r.id for r in rows.every_nth(df, "id", 3).collect()) == [0, 3, 6, 9]
    assert sorted((r.sample, r.id) for r in rows.resampled(df, "id", 4).collect()) == [(0, 0), (1, 2), (2, 5), (3, 7)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=40))
def test_histogram_counts_everything_once(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = stats.histogram(df, "x", 7).collect()
    assert len(got) == 7 and sum(r["count"] for r in got) == len(xs)


def test_histogram_cases(spark):
    counts = lambda xs, bins: [r["count"] for r in stats.histogram(spark.createDataFrame([(float(x),) for x in xs], "x double"), "x", bins).orderBy("bin").collect()]
    assert counts(range(10), 5) == [2, 2, 2, 2, 2]
    assert counts([NAN, NAN], 4) == [0, 0, 0, 0]
    assert counts([1, 1, INF], 2) == [0, 0]
    assert counts([5, 5, 5], 3) == [3, 0, 0]
    between = lambda xs, bins, a, b: [r["count"] for r in stats.histogram_between(spark.createDataFrame([(x,) for x in xs], "x double"), "x", bins, a, b).orderBy("bin").collect()]
    assert between([0.0, 0.25, 0.75, 0.99], 4, 0, 1) == [1, 1, 0, 2]
    assert between([-5.0, 0.5, 1.5, NAN], 2, 0, 1) == [0, 1]
    assert between([1.0, 1.0, 1.0], 4, 1, 1) == [3, 0, 0, 0]
    assert stats.clamp_bins(NAN) == 10 and stats.clamp_bins(0) == 1 and stats.clamp_bins(1e9) == 10_000


def test_summary(spark):
    got = stats.summary(table(spark, x=[1, 2, 3]), "x")
    assert values(got, "stat") == ["mean", "std", "min", "max", "median"]
    assert same(values(got, "x"), [2, 0.8165, 1, 3, 2])


def test_ranked_spreads_and_counts(spark):
    xs = np.random.default_rng(0).normal(size=500).round(1).tolist()
    df = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(xs)], "id long, x double, g long")
    got = {r.id: r.rn for r in ranked(df, "x", ["id"], within=["g"]).collect()}
    for g in range(3):
        order = sorted((x, i) for i, x in enumerate(xs) if i % 3 == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def test_delimited_files(spark):
    s = Studio(spark)
    t = s.load_csv("time,temp\n0,19.34\n5,20.19\n10,20.80")
    assert t.columns == ["time", "temp"] and values(t, "temp") == [19.34, 20.19, 20.8]
    assert s.load_csv("1,2\n3,4").columns == ["x", "y"] and s.load_csv("1 2 3 4\n5 6 7 8").columns == ["x", "y", "z", "w"]
    assert values(s.load_xyz("0 0 0\n1 2 3"), "z") == [0, 3]
    ragged = s.load_csv("1 2\nfoo bar\n3 4 5\n6 7")
    assert values(ragged, "x") == [1, 6]
    for text in ("hello world", ""):
        with pytest.raises(TableError, match="no numeric data"):
            s.load_csv(text)
    assert s.load_csv("﻿a b\n1 2").columns == ["a", "b"]


def test_json_files(spark):
    s = Studio(spark)
    assert values(s.load_json('[{"x":1,"y":2},{"x":3,"y":4}]'), "x") == [1, 3]
    assert s.load_json('{"columns":[{"name":"a","data":[1,2,3]},{"name":"b","data":[4,5,6]}]}').columns == ["a", "b"]
    mixed = s.load_json('[{"name":"alpha","v":1},{"v":2}]')
    assert values(mixed, "name") == ["alpha", ""] and mixed.numeric() == ["v"]
    for bad in ("[]", "{}", "3"):
        with pytest.raises(TableError):
            s.load_json(bad)


def test_readers(spark):
    lines = lambda text: files.lines_in(spark, text)
    assert [tuple(r)[1:] for r in files.point_rows(lines("1 2 0.5\n3,4\nx y\n-1.5e2 2.5e-1 1"), ["x", "y", "c"], 2).orderBy(ROW).collect()] == [(1, 2, 0.5), (3, 4, None), (-150, 0.25, 1)]
    band = files.band_rows(lines("3,1,0.2\n5,10,8,12\n1,2,0.3\nx")).collect()
    assert [(r.x, round(r.lo, 3), round(r.hi, 3)) for r in band] == [(1, 1.7, 2.3), (3, 0.8, 1.2), (5, 8, 12)]
    assert [r.value for r in files.number_rows(lines("1 2\n3,4")).orderBy(ROW, "at").collect()] == [1, 2, 3, 4]
    assert [(r.label, r.value) for r in files.labelled_rows(lines("north east,3\n5")).orderBy(ROW).collect()] == [("north east", 3), ("#2", 5)]
    assert sorted((r.group, r.value) for r in files.grouped_rows(lines("a,1,2\nb,3")).collect()) == [("a", 1), ("a", 2), ("b", 3)]
    assert [(r.source, r.weight) for r in files.edge_rows(lines("# h, i, j\na,b\nb,c,2")).orderBy(ROW).collect()] == [("a", 1), ("b", 2)]
    assert files.formats_of("a.csv", b"PK\x03\x04") == ["zip", "csv"] and files.formats_of("a.png", b"\x89PNG") == ["png"]


def test_generators_and_studio(spark):
    s = Studio(spark)
    assert values(s.range(0, 10, 2), "value") == [0, 2, 4, 6, 8] and s.range(0, -1).df.count() == 0
    assert values(project.binary(s.grid(3), "add", "x", "y"), "x_add") == [0, 1, 2, 1, 2, 3, 2, 3, 4]
    assert generate.clamp_count(NAN, 100, 10) == 100 and generate.clamp_count(0, 100, 10) == 1 and generate.clamp_count(99, 1, 10) == 10
    assert s.plot("scatter", table(spark, x=[1, 2], y=[4, 5])).text() == "1 4\n2 5"
    assert s.plot("histogram", table(spark, x=[1, 2, 3])).text() == "1\n2\n3"
    assert s.plot("line", s.grid(4)).text().split("\n")[0] == "0,0"
    with pytest.raises(TableError):
        s.normalize(s.normalize(table(spark, x=[1, 2]), "x"), "x")


def test_written_tables_own_their_files(spark, tmp_path):
    """Only the written table's own folder goes, also where the shared folder has blanks or the same ending in its name."""
    from lattica.functions import storage

    shared = tmp_path / "a b.parquet" / "c d"
    shared.mkdir(parents=True)
    (tmp_path / "a b.parquet" / "other").write_text("stays")
    known, storage.shared_folder = storage.shared_folder, lambda _: f"file://{shared}"
    try:
        table = storage.written(spark.range(5).selectExpr("id", "id % 2 AS k"), by="k", compression="zstd")
    finally:
        storage.shared_folder = known
    assert table.count() == 5
    storage.erased(table.where("id > 1"))
    storage.erased(table, part="k=0")
    assert sorted(p.name for p in shared.glob("*/k=*")) == ["k=1"]
    view = storage.passed_on(table.select("id"), table)
    storage.erased(table)
    assert list(shared.iterdir())
    storage.erased(view)
    storage.erased(view)
    assert not list(shared.iterdir()) and (tmp_path / "a b.parquet" / "other").read_text() == "stays"


def test_shared_folder_where_none_is_set(tmp_path):
    """In a session without the setting a local master has one folder of its own."""
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
from lattica.functions.storage import shared_folder, written
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(s) == shared_folder(s) and shared_folder(s).startswith("file:///")
assert written(s.range(3)).count() == 3
print("fine")
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parent.parent, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)})
    assert got.stdout.strip().endswith("fine"), got.stderr[-2000:]
