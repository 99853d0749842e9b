"""Block graphs and programs."""

import pytest

from lattica.plans import blocks, graph
from lattica.plans.program import Program, ProgramError
from lattica.studio import Studio
from lattica.table import ROW, TableError


def chain(*steps):
    nodes = [graph.Node(str(k), b, p) for k, (b, p) in enumerate(steps)]
    return graph.Graph(nodes, [graph.Edge(str(k), "table", str(k + 1), "table") for k in range(len(steps) - 1)])


def test_pipeline_and_json(spark):
    g = chain(("source.example_data", {"count": 50, "seed": 1}), ("transform.normalize", {"column": "x"}), ("stats.histogram", {"column": "x_minmax", "bins": 5}))
    out = graph.run(graph.Graph.from_json(g.to_json()), blocks.standard(spark))
    rows = out["2"]["table"].df.collect()
    assert len(rows) == 5 and sum(r["count"] for r in rows) == 50


def test_all_standard_blocks_are_there(spark):
    assert len(blocks.standard(spark).blocks) == 24


@pytest.mark.parametrize(
    "edges,code",
    [
        ([("a", "table", "b", "table"), ("c", "table", "b", "table")], "duplicate_input"),
        ([("a", "table", "b", "nope")], "unknown_target_port"),
        ([("a", "nope", "b", "table")], "unknown_source_port"),
        ([("q", "table", "b", "table")], "unknown_source_node"),
        ([("a", "table", "q", "table")], "unknown_target_node"),
        ([], "missing_required_input"),
        ([("v", "view", "b", "table"), ("a", "table", "v", "table")], "type_mismatch"),
    ],
)
def test_diagnostics(spark, edges, code):
    nodes = [graph.Node("a", "source.generate_grid"), graph.Node("b", "stats.summary"), graph.Node("c", "source.generate_random"), graph.Node("v", "viz.histogram", {"column": "x"})]
    with pytest.raises(graph.GraphError) as e:
        graph.compiled(graph.Graph(nodes, [graph.Edge(*x) for x in edges]), blocks.standard(spark))
    assert code in e.value.codes


def test_cycles_unknown_and_twice(spark):
    own = blocks.standard(spark)
    loop = graph.Graph([graph.Node("a", "stats.summary"), graph.Node("b", "stats.summary")], [graph.Edge("a", "table", "b", "table"), graph.Edge("b", "table", "a", "table")])
    with pytest.raises(graph.GraphError) as e:
        graph.compiled(loop, own)
    assert e.value.codes == ["cycle_detected"]
    with pytest.raises(graph.GraphError) as e:
        graph.compiled(graph.Graph([graph.Node("a", "no.such"), graph.Node("b", "source.generate_grid"), graph.Node("b", "source.generate_grid")], []), own)
    assert sorted(e.value.codes) == ["duplicate_node", "unknown_block"]
    assert own.register(graph.Block("stats.summary", {}, {}, {})) is False


def test_session_composes_changed_nodes_only(spark):
    calls = []
    own = graph.Registry([graph.Block("one", {}, {"x": "Scalar"}, {"v": 1}, lambda i, p: calls.append("one") or {"x": p["v"]}), graph.Block("two", {"x": "Scalar"}, {"x": "Scalar"}, {"fail": False}, lambda i, p: calls.append("two") or {"x": i["x"] / (0 if p["fail"] else 1)})])
    make = lambda v, fail=False: graph.Graph([graph.Node("a", "one", {"v": v}), graph.Node("b", "two", {"fail": fail})], [graph.Edge("a", "x", "b", "x")])
    s = graph.Session(own)
    s.run(make(1))
    s.run(make(1))
    assert calls == ["one", "two"]
    assert s.run(make(2))["b"]["x"] == 2 and calls == ["one", "two"] * 2
    with pytest.raises(ZeroDivisionError):
        s.run(make(2, True))
    with pytest.raises(ZeroDivisionError):
        s.run(make(2, True))
    assert calls[-2:] == ["two", "two"]


def test_program(spark):
    s = Studio(spark)
    out = Program(
        [
            {"do": "let", "name": "df", "value": {"call": "load_csv", "args": ["x,y\n1,4\n2,5\n3,6"]}},
            {"do": "let", "name": "n", "value": {"call": "normalize", "args": [{"var": "df"}, "x"], "kwargs": {"mode": "minmax"}}},
            {"do": "let", "name": "f", "value": {"call": "filter", "args": [{"var": "df"}, "x", ">", 1]}},
            {"do": "let", "name": "p", "value": {"call": "plot", "args": ["scatter", {"var": "n"}]}},
        ],
        s,
    ).run()
    assert out["n"].columns == ["x", "y", "x_minmax"] and out["f"].df.count() == 2 and out["p"].kind == "scatter"


def test_program_control(spark):
    s = Studio(spark)
    op = lambda o, *a: {"op": o, "args": list(a)}
    p = Program(
        [
            {"do": "let", "name": "a", "value": op("+", 1, 2)},
            {"do": "repeat", "times": 3, "body": [{"do": "print", "value": "hi"}]},
            {"do": "let", "name": "i", "value": 0},
            {"do": "while", "test": op("<", {"var": "i"}, 10), "body": [{"do": "let", "name": "i", "value": op("+", {"var": "i"}, 1)}, {"do": "if", "cases": [{"test": op("==", {"var": "i"}, 4), "body": [{"do": "break"}]}]}]},
            {"do": "def", "name": "twice", "params": ["v"], "body": [{"do": "return", "value": op("*", {"var": "v"}, 2)}]},
            {"do": "let", "name": "t", "value": {"call": "twice", "args": [21]}},
            {"do": "let", "name": "s", "value": {"slice": [{"list": list(range(10))}, 7, 2, -2]}},
            {"do": "each", "name": "c", "over": {"call": "grid", "args": [2]}, "body": [{"do": "print", "value": {"var": "c"}}]},
        ],
        s,
    )
    out = p.run()
    assert (out["a"], out["i"], out["t"], out["s"]) == (3, 4, 42, [7, 5, 3]) and p.printed == ["hi"] * 3 + ["x", "y"]
    assert p.operator("/", [1, 0]) == float("inf") and p.operator("+", ["a", 1]) == "a1" and p.operator("%", [-7, 3]) == -1
    with pytest.raises(ProgramError, match="nope"):
        Program([{"do": "print", "value": {"var": "nope"}}], s).run()
    with pytest.raises(ProgramError):
        Program([{"do": "run", "value": {"call": "__init__", "args": []}}], s).run()
    with pytest.raises(ProgramError):
        Program([{"do": "let", "name": "x"}], s).run()


def test_file_block(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    own = blocks.standard(spark, {"a.csv": str(tmp_path / "a.csv")})
    out = graph.run(chain(("source.file", {"fileName": "a.csv"}), ("filter.top_k", {"column": "y", "k": 1})), own)
    assert [r.x for r in out["1"]["table"].df.drop(ROW).collect()] == [3]
    with pytest.raises(TableError):
        graph.run(chain(("source.file", {"fileName": "b.csv"})), own)


def test_plugins_as_table_functions(spark):
    import numpy as np

    from lattica.plans import plugins
    from lattica.table import Table

    rows = [("a", 1, 2.0), ("a", 2, None), ("a", 3, 5.0), ("a", 4, -1.0), (None, 1, 7.0), (None, 2, 7.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    got = {r.g: tuple(r)[1:] for r in plugins.applied(df, plugins.Moments, column="v", by="g").collect()}
    x = np.array([2.0, 5.0, -1.0])
    assert got.keys() == {"a", None} and got[None] == (2, 7.0, 0.0, 0.0)
    assert np.allclose(got["a"], (3, x.mean(), x.std(), ((x - x.mean()) ** 3).mean() / x.std() ** 3))
    plugins.register(spark, plugins.Crossings)
    df.createOrReplaceTempView("plugin_rows")
    call = "SELECT * FROM crossings(TABLE(plugin_rows), column => '{}', by => 'g', along => 't', level => 3.0)"
    assert {r.g: (r.rises, r.falls) for r in spark.sql(call.format("v")).collect()} == {"a": (1, 1), None: (0, 0), "c": (0, 0)}
    for wrong in (call.format("nope"), call.format("g"), "SELECT * FROM crossings(TABLE(plugin_rows), strange => 1)"):
        with pytest.raises(Exception, match="column|takes a table"):
            spark.sql(wrong)
    spark.catalog.dropTempView("plugin_rows")
    assert plugins.applied(df.limit(0), plugins.Moments, column="v", by="g").count() == 0
    assert plugins.Moments.render(Table(spark.createDataFrame([("a", 1.0)], "g string, mean double"))).columns == ("mean",)
