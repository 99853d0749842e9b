"""Graphs, trees, grids, motion and learning: small literal cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import ranking
from lattica.functions.ranking import ranked
from lattica.functions.storage import written
from lattica.operators import charts, graphs, grid, learn, motion, trees
from lattica.sources import files
from lattica.streaming.live import windowed_histogram


def test_box_quantiles(spark):
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 4), ("d", 5)) for v in range(1, n + 1)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q1, r.median, r.q3) for r in charts.box_stats(df, "g", "v").collect()}
    assert got == {"a": (1, 1, 1), "b": (1.5, 1.5, 1.5), "c": (1.5, 2.5, 3.5), "d": (2, 3, 4)}
    low = {r.g: (r.q1, r.median, r.q3) for r in charts.violin_box(df, "g", "v").collect()}
    assert low == {"a": (1, 1, 1), "b": (1, 2, 2), "c": (2, 3, 4), "d": (2, 3, 4)}


def test_density_of_one_and_of_equal_values(spark):
    df = spark.createDataFrame([("one", 3.0), ("same", 1.0), ("same", 1.0)], "g string, v double")
    for r in charts.kernel_density(df, "g", "v").collect():
        n, at = (1, 3.0) if r.g == "one" else (2, 1.0)
        h = 1.06 * n**-0.2
        assert math.isclose(r.density, math.exp(-0.5 * ((r.x - at) / h) ** 2) / h)


def test_components_levels_and_degree(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("A", "D")], "source string, target string")
    nodes = graphs.nodes_of(edges)
    assert nodes.count() == 4
    summary = graphs.component_summary(graphs.connected(nodes, edges)).first()
    assert (summary.components, summary.largest) == (1, 4)
    assert {r.id: r.level for r in graphs.flow_levels(edges).collect()} == {"A": 0, "B": 1, "C": 2, "D": 1}
    assert {r.id: r.degree for r in graphs.degree(edges).collect()} == {"A": 2, "B": 2, "C": 2, "D": 2}
    loop = spark.createDataFrame([("X", "Y"), ("Y", "X")], "source string, target string")
    assert {r.id: r.level for r in graphs.flow_levels(loop).collect()} == {"X": 0, "Y": 1}
    numbered = graphs.indexed(spark.createDataFrame([("B", 2), ("A", 1)], "id string, first long"), "first")
    kept = graphs.by_index(spark.createDataFrame([("A", "B"), ("A", "A"), ("A", "Q")], "source string, target string"), numbered).collect()
    assert [(r.source_index, r.target_index) for r in kept] == [(0, 1)]


def test_spring_forces(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 1.0)], "source long, target long, weight double")
    got = {r.id: r.fx for r in graphs.spring_forces(nodes, edges).collect()}
    assert math.isclose(got[1], -0.25 + 0.1) and math.isclose(got[2], 0.25 - 0.1 - 0.02)


def test_tree(spark):
    lines = files.lines_in(spark, "label,parent,size\nsrc,,\ncore,src,120\nplugins,src,180\na,core,10\na,core,5")
    placed = trees.depths(trees.tree_nodes(files.tree_rows(lines)))
    totals = {r.label: (r.depth, r.total) for r in trees.rolled_up(placed).collect()}
    assert totals == {"src": (1, 300), "core": (2, 120), "plugins": (2, 180), "a": (3, 15)}
    assert {r["label"]: r["index"] for r in trees.preorder(placed).collect()} == {"src": 0, "core": 1, "a": 2, "plugins": 3}
    boxes = {r.label: (r.x, r.y, r.w, r.h) for r in trees.slices(trees.rolled_up(placed)).collect()}
    assert boxes["src"] == (0, 0, 1, 1) and boxes["plugins"] == (0, 0, 0.6, 1) and np.allclose(boxes["core"], (0.6, 0, 0.4, 1))


def test_grids(spark):
    strict = lambda m: sorted(tuple(r) for r in grid.to_grid(spark.createDataFrame([(m,)], "m array<array<double>>"), "m").collect())
    assert strict([[1.5, 2.5]]) == [(0, 0, 1.5), (0, 1, 2.5)] and strict([[1.0, 2.0], [3.0]]) == []
    padded = grid.to_grid(spark.createDataFrame([([[1.0, 2.0], [3.0], [4.0, 5.0, 6.0]],)], "m array<array<double>>"), "m", padded=True)
    assert padded.count() == 9 and padded.where(F.isnan("value")).count() == 3
    cells = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0)], "row int, col int, value double")
    colors = {r.col: (r.red, r.blue) for r in grid.heat_colors(cells).collect()}
    assert colors == {0: (0.13, 0.74), 1: (0.93, 0.13)}
    p = grid.project(spark.createDataFrame([(1.0, 1.0), (90.0, 0.0)], "x double, y double"), "x", "y", 100, 100, F.lit(10.0), F.lit(50.0), F.lit(50.0)).collect()
    assert (p[0].sx, p[0].sy, p[0].vis) == (60, 40, 1) and p[1].vis == 0


def test_contour_saddle_and_corner(spark):
    square = lambda tl, tr, bl, br: grid.contour_segments(spark.createDataFrame([(0, 0, tl), (0, 1, tr), (1, 0, bl), (1, 1, br)], "row int, col int, value double"), 1).collect()
    corner = square(0.0, 1.0, 1.0, 1.0)
    assert len(corner) == 1 and sorted([(corner[0].x1, corner[0].y1), (corner[0].x2, corner[0].y2)]) == [(0.0, 0.5), (0.5, 0.0)]
    assert len(square(0.0, 1.0, 1.0, 0.0)) == 2 and square(1.0, 1.0, 1.0, 1.0) == []


def test_life(spark):
    blinker = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "x int, y int")
    assert sorted(tuple(r) for r in grid.life_step(blinker, 5, 5).collect()) == [(0, 1), (1, 1), (2, 1)]


def test_particles_and_bodies(spark):
    step = lambda x, y, vx, vy: tuple(motion.particles(spark.createDataFrame([(x, y, vx, vy)], "x double, y double, vx double, vy double"), steps=1, dt=0.1).first())
    assert np.allclose(step(0.0, 0.0, 1.0, 2.0), (0.1, 0.2, 1, 2)) and np.allclose(step(0.95, -0.98, 1.0, -1.0), (1, -1, -1, 1))
    b = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 100.0), (1, 1.0, 0.0, 0.0, 0.0, 0.5, 0.0, 1.0), (2, -1.0, 0.0, 0.0, 0.0, -0.5, 0.0, 1.0)], "id long, x double, y double, z double, vx double, vy double, vz double, m double")
    moved = motion.bodies_step(b).collect()
    assert math.isclose(sum(r.m * r.vx for r in moved), 0, abs_tol=1e-9)
    assert motion.total_energy(b).first().kinetic == 0.25


def test_deep_trees_keep_all_nodes(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, 1.0) for i in range(102)] + [("x", "y", 1.0), ("y", "x", 1.0)]
    placed = trees.depths(spark.createDataFrame(rows, "label string, parent string, size double"))
    assert sorted((r.label, r.depth) for r in placed.select("label", "depth").collect()) == sorted((f"n{i}", i + 1) for i in range(102))


def test_energy_by_blocks(spark, capsys):
    r = np.random.default_rng(5).uniform(-1, 1, (40, 7))
    rows = [(i, *map(float, x[:6]), float(abs(x[6]))) for i, x in enumerate(r)]
    b = spark.createDataFrame(rows, "id long, x double, y double, z double, vx double, vy double, vz double, m double")
    potential = -sum(0.05 * p[7] * q[7] / math.sqrt(math.dist(p[1:4], q[1:4]) ** 2 + 0.03**2) for p in rows for q in rows if p[0] < q[0])
    kinetic = sum(0.5 * p[7] * sum(v * v for v in p[4:7]) for p in rows)
    energy = motion.total_energy(b)
    got = energy.first()
    assert math.isclose(got.potential, potential) and math.isclose(got.kinetic, kinetic) and math.isclose(got.energy, kinetic + potential)
    energy.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" in plan and not any("<" in line for line in plan.splitlines() if "NestedLoop" in line or "Cartesian" in line)  # only one-row sums meet so


def test_curves(spark):
    assert motion.koch(spark, 2).count() == 48
    assert motion.lissajous(spark).count() == 2001 and motion.truchet(spark, 4, 3).where("tile between 0 and 3").count() == 12
    assert motion.fern(spark, 50).where("y between -0.1 and 10.1").count() == 50
    assert motion.spirograph(spark, points=100).count() == 100 and motion.harmonograph(spark, points=10).count() == 10
    assert motion.escape_counts(spark, 4, 4, 20).agg(F.max("n")).first()[0] == 20


def test_learning(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1, float(x > 10)) for x in range(20)], "x double, y double, c double")
    fit = learn.line_fit(df, "x", "y").first()
    assert math.isclose(fit.slope, 2) and math.isclose(fit.intercept, 1) and math.isclose(fit.r2, 1)
    model = learn.linear_fit(df, ["x"], "y")
    assert math.isclose(model.coefficients[0], 2, rel_tol=1e-6)
    line = learn.partial_dependence(df, model, ["x"], "x", 5).orderBy("id").collect()
    assert [round(r.prediction, 6) for r in line] == [1, 10.5, 20, 29.5, 39]
    assert learn.logistic_fit(df, ["x"], "c", 20).coefficients[0] > 0
    a, b = learn.split(df, "x", 0.3)
    assert a.count() + b.count() == 20
    labels = learn.encode_labels(spark.createDataFrame([("b",), ("a",), ("b",)], "k string"), "k")
    assert sorted(tuple(r) for r in labels.collect()) == [("a", 0.0), ("b", 1.0), ("b", 1.0)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:05:00", 1.0), ("2024-01-01 00:10:00", 9.0), ("2024-01-01 03:00:00", 9.0)], "ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_histogram(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "v", 2, 0, 10)
    q = stream.writeStream.format("memory").queryName("live").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted((r.bin, r["count"]) for r in spark.table("live").collect()) == [(0, 1), (1, 1), (1, 1)]
    finally:
        q.stop()


def test_regressing_network(spark, tmp_path):
    rows = [(i, float(i % 17), float(i % 5), 2.0 * (i % 17) - 3 * (i % 5) + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    model = learn.perceptron_regression(df, ["a", "b"], "y", "k", hidden=(16, 8), epochs=25, rate=0.1, stop=lambda r: r["epoch"] == 20)
    losses = [r["loss"] for r in model.history]
    assert len(losses) == 20 and losses[-1] < 0.2 * losses[0] and all(r["validation_loss"] is not None for r in model.history)
    again = learn.Perceptron.from_json(model.to_json())
    got = {r.k: r.prediction for r in again.transform(df, ["a", "b"]).collect()}
    assert np.allclose([got[i] for i in range(400)], model.predicted(np.array([[a, b] for _, a, b, _ in rows])))
    # the gradient, by differences: one step of a fit from a known start moves against it
    short = learn.perceptron_regression(df, ["a", "b"], "y", "k", hidden=(4,), epochs=2, rate=1e-3)
    assert short.history[1]["loss"] < short.history[0]["loss"]


def test_ranks_of_few_values_are_spread(spark, monkeypatch):
    """A value that all rows have is dealt by its ties."""
    df = spark.range(4000).select(F.lit(1.0).alias("x"), F.col("id"))
    out = ranked(df.repartition(5), "x", ["id"])
    assert {r.id: r.rn for r in out.collect()} == {i: i + 1 for i in range(4000)}
    held = []
    monkeypatch.setattr(ranking, "written", lambda rows: held.append(written(rows)) or held[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    ranked(df.repartition(5), "x", ["id"])
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = held[0].groupBy("__part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2000


def test_hash_of_a_graph_is_that_of_its_content():
    from lattica.plans.graph import Edge, Graph, Node

    a = Graph([Node("a", "x", {"p": 1, "q": 2})], [Edge("a", "t", "b", "t")])
    b = Graph([Node("a", "x", {"q": 2, "p": 1})], [Edge("a", "t", "b", "t")])
    assert a.content_hash() == b.content_hash() != Graph(a.nodes, []).content_hash() and len(a.content_hash()) == 8
