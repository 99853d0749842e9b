"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lattica.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = db.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: "nan" if v != v else str(v)
    wanted = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == wanted


def test_range_filter_reaches_the_scan(spark, capsys):
    QUERIES["filter_range"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "LessThanOrEqual(l_quantity,30.0)" in plan
    assert "l_shipdate" not in plan


def test_top_k_is_no_full_sort(spark, capsys):
    QUERIES["top_k_largest"](spark, SF).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
