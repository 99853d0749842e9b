"""Faults that a reviewer found in round 3: rows that only larger or odd tables have."""

import math
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from lattica import queries_large
from lattica.functions import numeric, storage
from lattica.operators import motion, trees
from lattica.queries import QUERIES, SQL
from lattica.sources import files
from lattica.table import ROW


def by_sql(name, folder, *tables):
    with duckdb.connect() as c:
        for t in tables:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        return sorted(c.execute(SQL[name]).fetchall())


def by_spark(spark, name, folder):
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()))


def test_quotients_on_halves_are_rounded_as_sql_does(spark, tmp_path):
    orders = [(-115_050, 326438.97), (-115_015, 148146.61), (-114_994, 342447.41), (7, 1001.5), (3, 5.25)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert by_spark(spark, "math_div_column", tmp_path) == by_sql("math_div_column", tmp_path, "orders")


def test_half_away(spark):
    values = [0.0, 0.5, -0.5, 2.5, 1.005, -40804.87125, 1e300, float("inf"), None, 4503599627370497.5]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double")
    for digits in (0, 2, 4):
        got = [r[0] for r in df.select(numeric.half_away(F.col("v"), digits)).collect()]
        with duckdb.connect() as c:
            wanted = [c.execute(f"SELECT round(?::DOUBLE, {digits})", [v]).fetchall()[0][0] for v in values]
        assert got[:-1] == wanted and got[-1] != got[-1]


@pytest.mark.parametrize("n", [0, 3, 1_005])
def test_grid_of_any_number_of_suppliers(spark, tmp_path, n):
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["source_grid"](spark, str(tmp_path))
    assert tuple(got.agg(F.count("*"), F.sum("x"), F.max("y"), F.count_distinct("x_add")).first()) == (n * n, n * n * (n - 1) / 2 if n else None, n - 1 if n else None, max(0, 2 * n - 1))


def bodies_by_hand(rows, physical, g=0.05, soft=0.03, dt=0.001):
    out = []
    for i, *p, vx, vy, vz, m in rows:
        f = [0.0] * 3
        twins = [r for r in rows if i is not None and r[0] == i and None not in r[1:4] and (physical or r[7] is not None)]
        for t in twins:
            for r in rows:
                if r[0] is None or r[0] == i or None in (*r[1:4], r[7]):
                    continue
                d = [b - a for a, b in zip(t[1:4], r[1:4])]
                r2 = sum(x * x for x in d) + soft * soft
                f = [s + g * (r[7] if physical else t[7] * r[7]) / r2**1.5 * x for s, x in zip(f, d)]
        v = [s + x * dt for s, x in zip((vx, vy, vz), f)]
        out.append((i, *(None if a is None else a + x * dt for a, x in zip(p, v)), *v, m))
    return out


@pytest.mark.parametrize("physical", [False, True])
@pytest.mark.parametrize("block", [4, 4096])
def test_bodies_meet_in_blocks(spark, physical, block):
    rows = [(k, math.sin(k), math.cos(k), math.sin(2.0 * k), 0.1 * k, 0.0, 0.1, 1.0 + k % 5) for k in range(23)]
    rows += [(3, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 2.0), (None, 0.1, 0.2, 0.3, 0.0, 0.0, 0.0, 1.0), (30, None, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (31, 0.0, 0.1, 0.0, 0.0, 0.0, 0.0, None)]
    b = spark.createDataFrame(rows, "id long, x double, y double, z double, vx double, vy double, vz double, m double")
    key = lambda r: [(v is not None, v or 0.0) for v in r]
    got = sorted((tuple(r) for r in motion.bodies_step(b, physical=physical, block=block).collect()), key=key)
    for g, w in zip(got, sorted(bodies_by_hand(rows, physical), key=key), strict=True):
        assert [v is None for v in g] == [v is None for v in w]
        assert [v or 0.0 for v in g] == pytest.approx([v or 0.0 for v in w], rel=1e-9, abs=1e-12)
    sound = [r for r in rows if None not in r]
    wanted = -sum(0.05 * p[7] * q[7] / math.sqrt(sum((a - c) ** 2 for a, c in zip(p[1:4], q[1:4])) + 0.0009) for p in sound for q in sound if p[0] < q[0])
    assert motion.total_energy(b, block=block).first().potential == pytest.approx(wanted)
    assert motion.total_energy(b.limit(0)).first().potential == 0


def test_a_pair_of_blocks_is_a_task_of_its_own(spark):
    b = spark.range(64).select("id", *(F.sin(F.col("id") * k).alias(c) for k, c in enumerate("xyz", 1)), *(F.lit(0.0).alias(f"v{c}") for c in "xyz"), F.lit(1.0).alias("m"))
    bodies = motion.blocks_of(b, 8, *(F.col(c) for c in (*"xyz", "m")))
    rows = lambda p, q, same: pa.RecordBatch.from_arrays([pa.array([len(p)], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int64())], ["n", "part"])
    got = motion.met(bodies, bodies, 8, False, rows, "n long, part long").collect()
    assert len(got) == 64 and max(r.n for r in got) < 32 and len({r.part for r in got}) > 20


def test_numeric_lines(spark):
    ok = ["1 2", " 3,,4 ", "5 6 ,", "1e2 3", "+.5 -1.", "1\t2", " ".join(["1.5"] * 20_000), "9" * 300 + " 1"]
    bad = ["a b", "1e999 2", "x 1", "1d 2", "NaN 1", "", "  ", ", ,", "9 1e", "0x1 2", "9" * 400 + " 1", "1 2\n3 x", " ".join(["1.5"] * 20_000) + "x"]
    df = spark.createDataFrame([(line,) for line in ok + bad], "line string")
    assert sorted(r.line for r in df.where(files.numeric_line()).collect()) == sorted(ok)
    assert sorted(r.line for r in df.where(files.numeric_line(2)).collect()) == sorted([*ok[:6], ok[7]])
    lines = spark.createDataFrame(list(enumerate(["p q", "u 1e999", *ok[:3], "1 2 3", "x 1"])), f"{ROW} long, line string")
    t = files.delimited_table(lines).df.drop(ROW)
    assert t.columns == ["p", "q"] and sorted(map(tuple, t.collect())) == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]


def test_documents_grow_in_number(spark):
    df = spark.range(1_000).select("id", F.repeat(F.lit("x"), 1_000).alias("text"))
    assert queries_large.documents_for(df, size=100_000) in range(10, 13)
    assert queries_large.documents_for(df) == queries_large.documents_for(df.limit(0)) == 3


def test_chains_of_orders_write_each_row_a_few_times(spark, tmp_path, monkeypatch):
    orders = [(k * 7919 % 4001, k % 40 if k % 11 else None, 100.0 + k * 37 % 501) for k in range(4000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    rows, written = [], storage.written

    def watched(df, *a, **o):
        out = written(df, *a, **o)
        rows.append(out.count())
        return out

    monkeypatch.setattr(storage, "written", watched)
    monkeypatch.setattr(trees, "written", watched)
    got = by_spark(spark, "chains_of_orders", tmp_path)
    assert got == by_sql("chains_of_orders", tmp_path, "orders") and sum(rows) <= 4 * len(orders)


def walked(nodes):
    """depth, total and number of nodes below for each label that reaches a root."""
    paths = {}
    for label in nodes:
        path, at = [], label
        while at in nodes and len(path) <= len(nodes):
            path.append(at)
            at = nodes[at][0]
        if len(path) <= len(nodes):
            paths[label] = path
    below, inner = dict.fromkeys(paths, 0), dict.fromkeys(paths, 0.0)
    totals = {}
    for label in sorted(paths, key=lambda x: -len(paths[x])):
        totals[label] = max(nodes[label][1], inner[label])
        for a in paths[label]:
            below[a] += 1
        if len(paths[label]) > 1:
            inner[paths[label][1]] += totals[label]
    return sorted((x, len(p), totals[x], float(below[x])) for x, p in paths.items())


@pytest.mark.parametrize("chunk,parts,few,dealt", [(1, 3, 0, True), (16, 2, 1 << 16, True), (16, 1, 0, False), (50, 2, 1 << 16, False), (1 << 18, 1, 0, False)])
def test_trees_however_rows_lie_in_chunks(spark, monkeypatch, chunk, parts, few, dealt):
    r = random.Random(chunk)
    parents = {k: (k - 1 if k % 30 else None) for k in range(150)} | {k: r.choice([150, k - 1, k - 2, k // 2, 5000 + k]) for k in range(152, 300)} | {150: None, 151: 9999}
    parents |= {400: 402, 401: 400, 402: 401, 403: 402, 404: 403, 500: 500}
    nodes = {k: (p, float(r.choice([0, 1, 5, 60]))) for k, p in parents.items()}
    monkeypatch.setattr(trees, "CHUNK", chunk)
    monkeypatch.setattr(trees, "FEW", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(k, p, s, f"n{k}") for k, (p, s) in nodes.items()], "label long, parent long, size double, name string")
        placed = trees.depths(df.repartition(parts, "name") if dealt else df.coalesce(parts))
        assert all(x.name == f"n{x.label}" and x.parent == nodes[x.label][0] for x in placed.collect())
        found = trees.folded(placed, {"total": (F.col("size"), F.lit(0.0)), "below": (None, F.lit(1))})
        assert sorted(map(tuple, placed.join(found, "label").select("label", "depth", "total", "below").collect())) == walked(nodes)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_measures_without_values_in_trees(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1, None), (3, 2, 4.0), (4, 2, math.nan)], "label long, parent long, size double")
    placed = trees.depths(df)
    got = trees.folded(placed, {"floor": (F.col("size"), F.lit(0.0)), "own": (F.lit(1.0), F.when(F.col("label") != 3, F.lit(0.5)))})
    assert {x.label: (str(x.floor), x.own) for x in got.collect()} == {1: ("nan", 3.0), 2: ("nan", 2.5), 3: ("4.0", 1.0), 4: ("nan", 1.0)}
    assert trees.folded(placed.limit(0), {"n": (None, F.lit(1))}).collect() == trees.depths(df.limit(0)).collect() == []
