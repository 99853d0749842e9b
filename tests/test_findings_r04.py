"""Faults that a reviewer found in round 4."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.functions import numeric
from lattica.queries import QUERIES, SQL
from lattica.sources import generate
from lattica.table import ROW


def by_sql(name, folder, *tables):
    with duckdb.connect() as c:
        for t in tables:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        return c.execute(SQL[name]).fetchall()


def texts(rows):
    """As texts, which tell zeros by their signs."""
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("op", ["add", "sub", "mul", "div"])
def test_zeros_have_the_signs_that_sql_gives_them(spark, tmp_path, op):
    prices = [-0.0, 0.0, -0.00001, 0.00001, -1.00005, 7.5, float("inf"), float("-inf"), float("nan"), None]
    orders = [(7 * k + d, p) for k, p in enumerate(prices) for d in range(-7, 7)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = texts(map(tuple, QUERIES[f"math_{op}_column"](spark, str(tmp_path)).collect()))
    assert got == texts(by_sql(f"math_{op}_column", tmp_path, "orders")) and any("-0.0" in r for r in got)


def test_what_is_unknown_stays_so_when_divided_by_nothing(spark):
    values = [None, 0.0, -0.0, 2.0, -2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    got = df.select("a", "b", numeric.divide(F.col("a"), F.col("b")).alias("q"), numeric.remainder(F.col("a"), F.col("b")).alias("r")).collect()
    assert len(got) == 49 and all((x.q is None) == (x.r is None) == (x.a is None or x.b is None) for x in got)


def test_grids_take_little_room_in_files(spark, tmp_path):
    n = 1_500
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    QUERIES["source_grid"](spark, str(tmp_path)).coalesce(1).write.parquet(f"{tmp_path}/out")
    assert sum(map(os.path.getsize, glob.glob(f"{tmp_path}/out/*.parquet"))) < n * n


@pytest.mark.parametrize("n,tall", [(1, 4096), (127, 4096), (128, 50), (129, 128), (300, 7)])
def test_rows_of_grids_have_their_places(spark, monkeypatch, n, tall):
    monkeypatch.setattr(generate, "TALL", tall)
    got = sorted(map(tuple, generate.grid_data(spark, n).df.select(ROW, "x", "y").collect()))
    assert got == [(k, float(k // n), float(k % n)) for k in range(n * n)]
