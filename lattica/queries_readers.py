"""Queries over text made of the driver's tables: each reader gets lines, each sink gives some, and SQL says what must come out."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric
from .functions.ranking import ranked
from .functions.storage import shared_folder
from .operators import charts, graphs, grid, learn, project, rows, stats, trees
from .plans import blocks, graph
from .queries import _CELLS, _COUNT, _LCG, _TREE, _cells, _flows, _tree, query, read, rounded
from .sources import files, json_documents
from .sources.generate import clamp_counts
from .studio import Studio
from .table import ROW, Table


def lines(df: DataFrame, place: Column | str, line: Column) -> DataFrame:
    return df.select((F.col(place) if isinstance(place, str) else place).cast("long").alias(ROW), line.alias("line"))


def one_line(spark: SparkSession, place: int, line: str) -> DataFrame:
    return spark.createDataFrame([(place, line)], f"{ROW} long, line string")


def without_place(t: Table | DataFrame) -> DataFrame:
    return (t.df if isinstance(t, Table) else t).drop(ROW)


# delimited text


@query("SELECT l_quantity::DOUBLE AS quantity, l_extendedprice AS price, l_discount AS z, l_tax AS w, l_orderkey::DOUBLE AS c4 FROM lineitem WHERE l_linenumber <> 2")
def read_delimited(spark, sf_dir):
    item = read(spark, sf_dir, "lineitem")
    place = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    line = F.when(F.col("l_linenumber") == 2, "not a row").otherwise(F.concat_ws(", ", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"))
    return without_place(files.delimited_table(lines(item, place, line).unionByName(one_line(spark, -1, "quantity price"))))


@query("SELECT s_suppkey::DOUBLE AS x, s_nationkey::DOUBLE AS y, s_acctbal AS z FROM supplier")
def read_xyz_file(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.xyz"
    read(spark, sf_dir, "supplier").select(F.concat_ws(" ", "s_suppkey", "s_nationkey", "s_acctbal")).write.text(path)
    return without_place(Studio(spark, {"stars": path}).load("stars"))


@query("SELECT p_partkey::DOUBLE AS x, p_size::DOUBLE AS y, p_retailprice AS z FROM part")
def read_csv_file(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.csv"
    read(spark, sf_dir, "part").select(F.concat_ws(",", "p_partkey", "p_size", "p_retailprice")).write.text(path)
    return without_place(files.load_file(spark, path))


@query("SELECT s_suppkey::DOUBLE AS supplier, s_nationkey::DOUBLE AS nation FROM supplier UNION ALL SELECT s_suppkey + 0.5, s_acctbal FROM supplier")
def read_csv_text(spark, sf_dir):
    """Texts of two rows each in a column; the first has a header."""
    s = read(spark, sf_dir, "supplier")
    text = F.concat_ws("\r\n", F.when(F.col("s_suppkey") == 0, F.lit("supplier nation")), F.concat_ws(",", "s_suppkey", "s_nationkey"), F.concat_ws("\t", F.col("s_suppkey") + F.lit(0.5), "s_acctbal"))
    return without_place(files.delimited_table(files.lines_of_texts(s.select("s_suppkey", text.alias("text")), "text", "s_suppkey")))


@query("SELECT s_suppkey::DOUBLE AS x, s_nationkey::DOUBLE AS y, 1.5::DOUBLE AS z FROM supplier")
def read_xyz_text(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", "s_suppkey", "s_nationkey", F.lit(1.5)).alias("text"))
    return without_place(files.delimited_table(files.lines_of_texts(s, "text", "s_suppkey"), names=files.XYZ_NAMES))


@query("SELECT c_custkey::DOUBLE AS key, c_name AS name FROM customer")
def read_json_records(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.json"
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    json_documents.write_documents(c, path)
    return without_place(Studio(spark, {"customers": path}).load("customers"))


@query(_LCG.format(seed=1, n=_COUNT.format("part")) + " SELECT i AS id, v / 4294967295.0::DOUBLE AS x FROM s WHERE i >= 0")
def studio_random(spark, sf_dir):
    return Studio(spark).random(read(spark, sf_dir, "part").count()).df.withColumnRenamed(ROW, "id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 100 ELSE greatest(1, least(5000, floor(c_acctbal)))::BIGINT END AS rows FROM customer")
def count_clamped(spark, sf_dir):
    """Counts from a column; what is no number has the fallback."""
    c = read(spark, sf_dir, "customer")
    value = F.when(F.col("c_custkey") % 14 == 0, float("nan")).when(F.col("c_custkey") % 7 == 0, float("-inf")).otherwise(F.col("c_acctbal"))
    return c.select("c_custkey", clamp_counts(value, 100, 5000).alias("rows"))


# readers of points, bars, groups, bands, edges, trees, series


@query("SELECT c_custkey::DOUBLE AS x, c_acctbal AS y, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::DOUBLE END AS color FROM customer WHERE c_mktsegment <> 'BUILDING'")
def read_scatter(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    line = F.when(F.col("c_mktsegment") == "BUILDING", F.concat_ws(" ", "c_mktsegment", "c_acctbal")).otherwise(F.concat_ws(", ", "c_custkey", F.concat("c_acctbal", F.lit("USD")), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey"))))
    return without_place(files.point_rows(lines(c, "c_custkey", line), ["x", "y", "color"], 2))


@query("SELECT p_partkey::DOUBLE AS x, p_size::DOUBLE AS y, greatest(0.0, 25.0::DOUBLE - p_size) AS size, p_retailprice AS color FROM part")
def read_bubbles(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return without_place(files.bubble_rows(lines(p, "p_partkey", F.concat_ws(" ", "p_partkey", "p_size", 25.0 - F.col("p_size"), "p_retailprice"))))


@query("WITH a AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation WHERE n_regionkey <> 4) SELECT CASE WHEN n_regionkey = 1 THEN '#' || k ELSE n_name END AS label, n_nationkey::DOUBLE AS value FROM a")
def read_bars(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    line = F.when(F.col("n_regionkey") == 4, F.concat("n_name", F.lit(" none"))).when(F.col("n_regionkey") == 1, F.col("n_nationkey").cast("string")).otherwise(F.concat_ws(" ", "n_name", "n_nationkey"))
    return without_place(files.labelled_rows(lines(n, F.col("n_nationkey").cast("long") * 1_000_000_007, line)))


@query("SELECT s_name AS series, axis, name, value::DOUBLE AS value FROM (SELECT s_suppkey, s_name, unnest([0, 1, 2])::INT AS axis, unnest(['nation', 'balance', 'tenth']) AS name, unnest([s_nationkey::DOUBLE, s_acctbal, s_suppkey / 10.0::DOUBLE]) AS value FROM supplier)")
def read_radar(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    rows_ = lines(s, "s_suppkey", F.concat_ws(",", "s_name", "s_nationkey", "s_acctbal", F.col("s_suppkey") / 10))
    return without_place(files.radar_rows(rows_.unionByName(one_line(spark, -1, "name, nation, balance, tenth"))))


@query("SELECT c_mktsegment AS \"group\", v AS value FROM (SELECT c_mktsegment, unnest([c_acctbal, c_nationkey::DOUBLE]) AS v FROM customer) UNION ALL SELECT 'Group ' || i, (n_nationkey * i)::DOUBLE FROM nation, range(1, 3) r(i)")
def read_groups(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    named = lines(c, "c_custkey", F.concat_ws(", ", "c_mktsegment", "c_acctbal", F.lit("?"), "c_nationkey"))
    return without_place(files.grouped_rows(named.unionByName(lines(n, "n_nationkey", F.concat_ws(",", "n_nationkey", F.col("n_nationkey") * 2)))))


@query("SELECT o_orderkey::DOUBLE AS x, o_totalprice AS y, CASE WHEN o_custkey % 2 = 0 THEN -5.5 ELSE round(o_totalprice - 2.5, 6) END AS lo, CASE WHEN o_custkey % 2 = 0 THEN 7.25 ELSE round(o_totalprice + 2.5, 6) END AS hi FROM orders")
def read_error_band(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    line = F.when(F.col("o_custkey") % 2 == 0, F.concat_ws(" ", "o_orderkey", "o_totalprice", F.lit("-5.5"), F.lit("7.25"))).otherwise(F.concat_ws(" ", "o_orderkey", "o_totalprice", F.lit("-2.5")))
    return rounded(without_place(files.band_rows(lines(o, "o_orderkey", line))))


@query("SELECT n_name AS label, r_name AS parent, n_nationkey::DOUBLE AS size FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, '', r_regionkey::DOUBLE FROM region")
def read_tree(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    leaves = lines(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), "n_nationkey", F.concat_ws(" , ", "n_name", "r_name", "n_nationkey"))
    return without_place(files.tree_rows(leaves.unionByName(lines(r, F.col("r_regionkey") + 100, F.concat_ws(",", "r_name", "r_regionkey"))).unionByName(one_line(spark, -1, "label,parent,size"))))


@query('''SELECT s_suppkey AS line, "at", value FROM (SELECT s_suppkey, unnest([0, 2, 3])::INT AS "at", unnest([s_suppkey::DOUBLE, s_acctbal, 12.0]) AS value FROM supplier)''')
def read_numbers(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return files.number_rows(lines(s, "s_suppkey", F.concat_ws(" ", "s_suppkey", F.lit("12px"), "s_acctbal", F.lit("1.2e1")))).withColumnRenamed(ROW, "line")


@query('''SELECT c_custkey AS line, 0 AS "at", c_acctbal AS value FROM customer UNION ALL SELECT -s_suppkey, "at", value FROM (SELECT s_suppkey, unnest([0, 1])::INT AS "at", unnest([s_suppkey::DOUBLE, s_acctbal]) AS value FROM supplier)''')
def read_histogram_values(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    first = files.histogram_rows(lines(c, "c_custkey", F.concat_ws(", ", "c_mktsegment", "c_acctbal", "c_custkey")))
    every = files.histogram_rows(lines(s, -F.col("s_suppkey"), F.concat(F.lit('[{"key": '), "s_suppkey", F.lit(', "at": '), "s_acctbal", F.lit("}]"))))
    return first.unionByName(every).withColumnRenamed(ROW, "line")


@query("SELECT o_orderkey AS line, s AS series, v AS value FROM (SELECT o_orderkey, unnest([0, 2])::INT AS s, unnest([o_totalprice, o_custkey::DOUBLE]) AS v FROM orders)")
def read_series(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return files.series_rows(lines(o, "o_orderkey", F.concat_ws(",", "o_totalprice", F.lit("gap"), F.concat("o_custkey", F.lit("x"))))).withColumnRenamed(ROW, "line")


@query("SELECT c_custkey::DOUBLE AS key, c_acctbal AS balance, c_mktsegment AS category FROM customer")
def read_parallel(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    rows_ = lines(c, "c_custkey", F.concat_ws(" , ", "c_custkey", "c_mktsegment", "c_acctbal")).unionByName(one_line(spark, -1, "key, segment, balance")).unionByName(one_line(spark, 10**12, "x, y, z"))
    return without_place(files.parallel_rows(rows_)[0])


_EDGES = "SELECT 'S' || s_suppkey AS source, 'N' || s_nationkey AS target, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE s_acctbal END AS weight FROM supplier"


def _edge_lines(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    line = F.concat_ws(" ", F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "s_nationkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")))
    return lines(s, "s_suppkey", line).unionByName(one_line(spark, -1, "# source target"))


@query(_EDGES)
def read_edges(spark, sf_dir):
    return without_place(files.edge_rows(_edge_lines(spark, sf_dir)))


@query(f"WITH e AS ({_EDGES}) SELECT id, min(first)::BIGINT AS first FROM (SELECT source AS id, substr(source, 2)::BIGINT * 2 AS first FROM e UNION ALL SELECT target, substr(source, 2)::BIGINT * 2 + 1 FROM e) GROUP BY 1")
def read_graph_nodes(spark, sf_dir):
    return files.graph_of(_edge_lines(spark, sf_dir))[0]


@query(f"WITH e AS ({_EDGES}) SELECT source, target, abs(weight) AS value FROM e")
def read_flows(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    line = F.concat_ws(",", F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit(" N"), "s_nationkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")))
    return without_place(files.flow_rows(lines(s, "s_suppkey", line)))


def _json_graph(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    links = F.collect_list(F.struct(F.concat(F.lit("S"), "s_suppkey").alias("from"), F.concat(F.lit("N"), "s_nationkey").alias("target"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("value")))
    documents = s.groupBy(F.floor(F.col("s_suppkey") / 10))  # a graph of ten suppliers each
    return documents.agg(F.to_json(F.struct(F.array(F.struct(F.lit("alone").alias("name"))).alias("vertices"), links.alias("edges"))).alias("value")).select("value")


@query(_EDGES)
def read_json_graph_edges(spark, sf_dir):
    return files.json_graph(_json_graph(spark, sf_dir))[1]


@query(f"WITH e AS ({_EDGES}) SELECT id, sum(k)::BIGINT AS degree FROM (SELECT source AS id, 1 AS k FROM e UNION ALL SELECT target, 1 FROM e UNION ALL SELECT 'alone', 0) GROUP BY 1")
def read_json_graph_nodes(spark, sf_dir):
    return files.json_graph(_json_graph(spark, sf_dir))[0]


@query(_CELLS + " SELECT (row_number() OVER (PARTITION BY row // 4 ORDER BY row) - 1)::INT AS row, 0 AS col, sum(value) AS value FROM g GROUP BY g.row UNION ALL SELECT (row_number() OVER (PARTITION BY row // 4 ORDER BY row) - 1)::INT, 1, max(value) FROM g GROUP BY g.row")
def read_json_grid(spark, sf_dir):
    by_row = _cells(spark, sf_dir).groupBy("row").agg(F.sum("value").alias("a"), F.max("value").alias("b"))
    matrix = by_row.groupBy(F.floor(F.col("row") / 4)).agg(F.sort_array(F.collect_list(F.struct("row", "a", "b"))).alias("m")).select(F.to_json(F.struct(F.transform("m", lambda r: F.array(r["a"], r["b"])).alias("grid"))).alias("value"))
    return grid.to_grid(files.json_grid(matrix), "matrix")


@query("SELECT (row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) - 1)::INT AS place, s_suppkey::DOUBLE AS x, s_acctbal AS y, s_nationkey::DOUBLE AS z, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vz, 1.0::DOUBLE AS m FROM supplier")
def read_json_bodies(spark, sf_dir):
    """Documents of ten bodies each."""
    bodies = read(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 10)).agg(F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").cast("double").alias("a"), F.col("s_acctbal").alias("b"), F.col("s_nationkey").cast("double").alias("c")))).alias("m"))
    return files.json_bodies(bodies.select(F.to_json(F.struct(F.transform("m", lambda r: F.array(r["a"], r["b"], r["c"])).alias("bodies"))).alias("value")))


@query("SELECT s_suppkey::DOUBLE AS x, s_acctbal AS y, s_nationkey::DOUBLE AS z, 1.5::DOUBLE AS vx, 2.5::DOUBLE AS vy, -1.0::DOUBLE AS vz, CASE WHEN s_suppkey % 2 = 0 THEN 4.0::DOUBLE END AS m FROM supplier")
def read_bodies(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    line = F.concat_ws(" ", "s_suppkey", "s_acctbal", "s_nationkey", F.lit("1.5 2.5 -1"), F.when(F.col("s_suppkey") % 2 == 0, "4"))
    return without_place(files.point_rows(lines(s, "s_suppkey", line), ["x", "y", "z", "vx", "vy", "vz", "m"], 6))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'dat' ELSE '' END AS formats FROM pages")
def formats_by_name(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    name = F.concat("page_id", F.element_at(F.array(*map(F.lit, (".CSV", ".json", ".dat", ".pdf"))), (F.col("page_id") % 4 + 1).cast("int")))
    return p.select("page_id", F.array_join(files.format_names(name, F.lit(b"")), ",").alias("formats"))


@query("SELECT upper(n_name) || '|' AS text, NULL::DOUBLE AS whole, NULL::DOUBLE AS prefix FROM nation UNION ALL SELECT c_acctbal || 'kg', NULL, c_acctbal FROM customer UNION ALL SELECT ' ' || c_custkey || '.5 ', c_custkey + 0.5::DOUBLE, c_custkey + 0.5::DOUBLE FROM customer")
def number_lexers(spark, sf_dir):
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    texts = n.select(F.concat(F.upper("n_name"), F.lit("|")).alias("text")).union(c.select(F.concat("c_acctbal", F.lit("kg")))).union(c.select(F.concat(F.lit(" "), "c_custkey", F.lit(".5 "))))
    return texts.select("text", numeric.whole_number(F.col("text")).alias("whole"), numeric.prefix_number(F.col("text")).alias("prefix"))


# sinks and views


@query("SELECT n_nationkey || ' ' || n_regionkey || ' 0.25' AS line FROM nation")
def write_delimited(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("a"), F.col("n_regionkey").alias("b"), F.lit(0.25).alias("c"), F.col("n_nationkey").cast("long").alias(ROW))
    return project.delimited_rows(Table(n), ["a", "b", "c"]).select("line")


_VIEW = "SELECT 'scatter' AS kind, s_suppkey AS place, s_suppkey || ' ' || s_nationkey AS line FROM supplier UNION ALL SELECT 'line', s_suppkey, s_suppkey || ',' || s_nationkey FROM supplier UNION ALL SELECT 'histogram', s_suppkey, s_nationkey::VARCHAR FROM supplier UNION ALL SELECT 'pointcloud', s_suppkey, s_suppkey || ' ' || s_nationkey FROM supplier"


def _supplier_table(spark, sf_dir) -> Table:
    return Table(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("double").alias("k"), F.col("s_nationkey").cast("double").alias("r"), F.col("s_suppkey").cast("long").alias(ROW)))


def _lines_of_views(views: list) -> DataFrame:
    out = [v.lines().select(F.lit(kind).alias("kind"), F.col(ROW).alias("place"), "line") for kind, v in views]
    return functools.reduce(DataFrame.unionByName, out)


@query(_VIEW)
def views_of_blocks(spark, sf_dir):
    """The lines that each view block hands to its chart, with their places."""
    known, t = blocks.standard(spark), _supplier_table(spark, sf_dir)
    chosen = (("scatter", "scatter", {"x": "k", "y": "r", "color": ""}), ("line", "line", {"x": "k", "y": "r"}), ("histogram", "histogram", {"column": "r"}), ("point_cloud_2d", "pointcloud", {"x": "k", "y": "r"}))
    return _lines_of_views([(kind, known.blocks[f"viz.{name}"].apply({"table": t}, params)["view"]) for name, kind, params in chosen])


@query(_VIEW)
def views_of_plot(spark, sf_dir):
    s, t = Studio(spark), _supplier_table(spark, sf_dir)
    made = [("scatter", {"x": "k", "y": "r"}), ("line", {"x": "k", "y": "r"}), ("histogram", {"column": "r"}), ("pointcloud", {})]
    return _lines_of_views([(kind, s.plot(kind, t, **chosen)) for kind, chosen in made])


@query("SELECT s_suppkey::VARCHAR AS k, s_nationkey::VARCHAR AS r FROM supplier WHERE s_suppkey < 7")
def preview_rows(spark, sf_dir):
    return without_place(_supplier_table(spark, sf_dir).previewed(7))


@query(_LCG.format(seed=9, n=_COUNT.format("customer")) + " SELECT i AS id, v / 4294967295.0::DOUBLE AS x FROM s WHERE i >= 0 AND v / 4294967295.0::DOUBLE BETWEEN 0.25 AND 0.75")
def saved_graph(spark, sf_dir):
    """A graph of blocks, saved as JSON, read back and run."""
    nodes = [graph.Node("a", "source.generate_random", {"count": read(spark, sf_dir, "customer").count(), "seed": 9}), graph.Node("b", "filter.range", {"column": "x", "min": 0.25, "max": 0.75})]
    g = graph.Graph(nodes, [graph.Edge("a", "table", "b", "table")])
    again = graph.Graph.from_json(g.to_json())
    return graph.run(again, blocks.standard(spark))["b"]["table"].df.withColumnRenamed(ROW, "id")


# columns


@query("SELECT n_nationkey, 1.0::DOUBLE AS a, 2.0::DOUBLE AS a_2, 3.0::DOUBLE AS a_3 FROM nation")
def unique_names(spark, sf_dir):
    t = Table(read(spark, sf_dir, "nation").select("n_nationkey"))
    for value in (1.0, 2.0, 3.0):
        t = project.add_constant(t, "a", value)
    return t.df


@query("SELECT c_custkey, c_mktsegment, c_acctbal, round(c_acctbal / greatest(1.0, max(abs(c_acctbal)) OVER (PARTITION BY c_mktsegment)), 6) + 0.0 AS scaled FROM customer")
def series_radius(spark, sf_dir):
    return rounded(stats.series_scaled(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal", radius=True))


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) + 0.0 AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) + 0.0 AS p_retailprice FROM part")
def matrix_zscore(spark, sf_dir):
    return rounded(project.scale_columns(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], deviations=True))


@query("SELECT o_orderkey, o_totalprice, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS t FROM orders")
def ramp_places(spark, sf_dir):
    return rounded(charts.ramp_place(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"))


@query("""WITH v AS (SELECT o_orderkey AS id, floor(o_totalprice / 100) * 100 + 20 AS v FROM orders UNION ALL SELECT s_suppkey, 1.0::DOUBLE / (s_suppkey + 2) FROM supplier WHERE s_suppkey % 8 <> 6 UNION ALL SELECT p_partkey, (p_size * 10 + 2) * 1e5 FROM part)
SELECT id, CASE WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fk', v / 1e3) WHEN v >= 10 THEN printf('%.0f', v) WHEN v >= 1 THEN printf('%.1f', v) ELSE printf('%.2f', v) END AS label FROM v""")
def short_labels(spark, sf_dir):
    o, s, p = read(spark, sf_dir, "orders"), read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")
    values = o.select(F.col("o_orderkey").alias("id"), (F.floor(F.col("o_totalprice") / 100) * 100 + 20).cast("double").alias("v"))
    values = values.union(s.where("s_suppkey % 8 <> 6").select("s_suppkey", 1.0 / (F.col("s_suppkey") + 2))).union(p.select("p_partkey", (F.col("p_size") * 10 + 2) * 1e5))
    return values.select("id", numeric.short_label(F.col("v")).alias("label"))


@query("WITH s AS (SELECT c_custkey AS i, (1234 + 1831565813 * (c_custkey + 1)) % 4294967296 AS t FROM customer), a AS (SELECT i, t, ((xor(t, t >> 15)::HUGEINT * (t | 1)) % 4294967296)::BIGINT AS u FROM s), b AS (SELECT i, xor(u, ((u + (xor(u, u >> 7)::HUGEINT * (u | 61)) % 4294967296) % 4294967296)::BIGINT) AS v FROM a) SELECT i, xor(v, v >> 14) / 4294967296.0::DOUBLE AS x FROM b")
def mulberry_stream(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), numeric.mulberry32(F.col("c_custkey"), 1234).alias("x"))


@query("SELECT n_name, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(regexp_extract_all(n_name, '.'), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c)::HUGEINT * 16777619 % 4294967296)::BIGINT)) AS hash FROM nation")
def name_hashes(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_name", numeric.fnv1a(F.col("n_name")).alias("hash"))


# rows


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def first_rows(spark, sf_dir):
    t = Table(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias(ROW)))
    return without_place(rows.first_rows(t, 25))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey BETWEEN 3 AND 9 AND c_acctbal BETWEEN -100 AND 5000")
def viewport_clip(spark, sf_dir):
    return rows.inside(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal", 3, 9, -100, 5000)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT -c_custkey, c_mktsegment FROM customer")
def series_selected(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return rows.one_series(c, "c_mktsegment", "MACHINERY").union(rows.one_series(c, "c_mktsegment").select(-F.col("c_custkey"), "c_mktsegment"))


@query("SELECT s_suppkey AS source, s_nationkey::BIGINT AS target FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND s_acctbal > 0")
def induced_edges(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    nodes = s.where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.concat(F.lit("n"), "n_nationkey")))
    edges = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    return rows.induced(edges, nodes).select(F.substring("source", 2, 20).cast("long").alias("source"), F.substring("target", 2, 20).cast("long").alias("target"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) - 1 AS index FROM lineitem")
def ranked_index(spark, sf_dir):
    """Ranks by a column of fifty values: ties are told apart by the key."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ranked(item, "l_quantity", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", (F.col("rn") - 1).alias("index"))


# statistics


@query("SELECT min(c_acctbal) AS c_acctbal_min, max(c_acctbal) AS c_acctbal_max, min(c_nationkey)::DOUBLE AS c_nationkey_min, max(c_nationkey)::DOUBLE AS c_nationkey_max FROM customer")
def extents(spark, sf_dir):
    return stats.extents(read(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


@query("SELECT c_mktsegment, count(*) AS count, min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1")
def histogram_metrics(spark, sf_dir):
    return rounded(stats.series_stats(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal"))


@query(_CELLS + " SELECT max(row) + 1 AS rows, max(col) + 1 AS cols, min(value) AS min, max(value) AS max FROM g")
def grid_metrics(spark, sf_dir):
    return grid.grid_stats(_cells(spark, sf_dir)).select(F.col("rows").cast("long").alias("rows"), F.col("cols").cast("long").alias("cols"), "min", "max")


@query("SELECT s_suppkey AS id FROM supplier UNION SELECT 100000 + s_nationkey FROM supplier")
def distinct_nodes(spark, sf_dir):
    return graphs.nodes_of(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.lit(100000) + F.col("s_nationkey")).cast("long").alias("target")))


@query("SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS label_index FROM customer")
def label_indexes(spark, sf_dir):
    return learn.encode_labels(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("SELECT round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 6) AS p_retailprice FROM part")
def means_of_columns(spark, sf_dir):
    return rounded(learn.column_means(read(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


@query("SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (), 6) + 0.0 AS centred FROM part")
def centred_column(spark, sf_dir):
    return rounded(learn.centred(read(spark, sf_dir, "part"), "p_retailprice", "centred").select("p_partkey", "centred"))


@query("WITH n AS (SELECT s_nationkey, count(DISTINCT s_suppkey) + 1 AS k FROM supplier GROUP BY 1) SELECT count(*) AS components, max(k) AS largest FROM n")
def components_summary(spark, sf_dir):
    edges = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.lit(100000) + F.col("s_nationkey")).cast("long").alias("target"))
    return graphs.component_summary(graphs.connected(graphs.nodes_of(edges), edges))


# graphs, trees, charts


@query("WITH n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT s_suppkey AS id FROM supplier UNION SELECT 100000 + s_nationkey FROM supplier)) SELECT s_suppkey AS source, 100000 + s_nationkey AS target, a.k AS source_index, b.k AS target_index FROM supplier JOIN n a ON a.id = s_suppkey JOIN n b ON b.id = 100000 + s_nationkey")
def edges_by_index(spark, sf_dir):
    edges = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.lit(100000) + F.col("s_nationkey")).cast("long").alias("target"))
    nodes = graphs.nodes_of(edges).withColumn("order", F.col("id"))
    return graphs.by_index(edges, graphs.indexed(nodes, "order")).select("source", "target", "source_index", "target_index")


_SUMS = "WITH c AS (SELECT r_name, n_name, c_mktsegment, sum(abs(c_acctbal)) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"


@query(_SUMS + ", t AS (SELECT n_name AS id, 1 AS level, sum(v) AS total FROM c GROUP BY 1 UNION ALL SELECT r_name, 0, sum(v) FROM c GROUP BY 1) SELECT id, level, round(total, 4) AS total, round(coalesce(sum(total + 10.0) OVER (PARTITION BY level ORDER BY total DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS y FROM t")
def stacked_nodes(spark, sf_dir):
    f = _flows(spark, sf_dir)
    totals = graphs.flow_totals(f, "value").join(graphs.flow_levels(f), "id").where("level < 2")
    nodes = totals.select("id", "level", F.greatest("inflow", "outflow").alias("total"))
    return rounded(graphs.stacked(nodes, "level", "total", "id", 10.0), 4)


@query(_TREE + """, r AS (SELECT r_name AS label, coalesce(sum(size), 0.0) AS total FROM region LEFT JOIN c USING (r_name) GROUP BY 1),
 a AS (SELECT label, total, coalesce(sum(total) OVER (ORDER BY total DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / sum(total) OVER () AS x, total / sum(total) OVER () AS w FROM r)
SELECT label, round(x, 6) + 0.0 AS x, round(w, 6) AS w, 0.0::DOUBLE AS y, 1.0::DOUBLE AS h FROM a""")
def treemap_top(spark, sf_dir):
    boxes = trees.slices(trees.rolled_up(trees.depths(_tree(spark, sf_dir))))
    return rounded(boxes.where("depth = 1").select("label", "x", "w", "y", "h"))


@query(_TREE + """ SELECT round(sum(size) / sum(sum(size)) OVER (), 6) AS area, c.label FROM c GROUP BY c.label""")
def treemap_areas(spark, sf_dir):
    """Every leaf's area is its share of the whole."""
    boxes = trees.slices(trees.rolled_up(trees.depths(_tree(spark, sf_dir))))
    return rounded(boxes.where("depth = 3").select((F.col("w") * F.col("h")).alias("area"), "label"))


@query("WITH l AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part) SELECT i AS tick, round(a - (b - a) * 0.08 + (b - a) * 1.16 * i / 4, 6) AS \"at\" FROM l, range(5) r(i)")
def ticks_of_axis(spark, sf_dir):
    return rounded(charts.axis_ticks(read(spark, sf_dir, "part"), "p_retailprice"))


@query("SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS place, count(*) AS n, round(sum(c_acctbal), 4) AS total, arg_min(c_acctbal, c_custkey) AS first FROM customer GROUP BY 1")
def listed_groups(spark, sf_dir):
    lists = charts.value_lists(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "c_custkey")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rounded(lists.select("c_mktsegment", "place", F.size("values").cast("long").alias("n"), total.alias("total"), F.col("values")[0].alias("first")), 4)


@query("SELECT s_suppkey AS line, s_nationkey::BIGINT AS label, 784::BIGINT AS n, (s_suppkey * 783)::DOUBLE AS total FROM supplier")
def read_digits(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    image = F.concat_ws(",", "s_nationkey", F.lit("0"), F.array_join(F.array_repeat(F.col("s_suppkey").cast("string"), 783), ","))
    rows_ = files.digit_rows(lines(s, "s_suppkey", image).unionByName(one_line(spark, -1, "label,pixels")))
    return rows_.select(F.col(ROW).alias("line"), "label", F.size("pixels").cast("long").alias("n"), F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("SELECT (row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) - 1)::INT AS place, s_nationkey::BIGINT AS label, (s_suppkey * 3 + 1)::DOUBLE AS total FROM supplier")
def read_json_digits(spark, sf_dir):
    """Documents of ten images each."""
    s = read(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 10)).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_nationkey"))).alias("r"))
    k = lambda r: r["s_suppkey"].cast("double")
    whole = s.select(F.to_json(F.struct(F.transform("r", lambda r: F.array(F.array(k(r), k(r)), F.array(k(r), F.lit(1.0)))).alias("images"), F.transform("r", lambda r: r["s_nationkey"]).alias("labels"))).alias("value"))
    return files.json_digits(whole).select("place", "label", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'mnist' WHEN 1 THEN 'nonlinear-nn' WHEN 2 THEN 'linear' END AS kind FROM supplier")
def kinds_of_models(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("mnist_", "NonLinear", "a_linear", "four"))), (F.col("s_suppkey") % 4 + 1).cast("int")), "s_suppkey", F.lit(".csv"))
    return s.select("s_suppkey", files.model_kinds(name, F.concat_ws(" ", "s_suppkey", F.lit("b c d"))).alias("kind"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'bars,lines' WHEN 1 THEN 'graph' WHEN 2 THEN 'viewer' ELSE '' END AS consumers FROM pages")
def routed_files(spark, sf_dir):
    """By ending, or, for a name that says nothing, by first bytes."""
    consumers = {"bars": [".csv"], "lines": [".txt", ".CSV"], "graph": [".json"], "viewer": [".png"]}
    p = read(spark, sf_dir, "pages")
    name = F.concat("page_id", F.element_at(F.array(*map(F.lit, (".csv", ".JSON", ".bin", ".zip"))), (F.col("page_id") % 4 + 1).cast("int")))
    head = F.when(F.col("page_id") % 4 == 2, F.unhex(F.lit(b"\x89PNG".hex()))).otherwise(F.encode(F.substring("html", 1, 8), "utf-8"))
    return p.select("page_id", F.array_join(files.consumers_of(name, head, consumers), ",").alias("consumers"))


# learning


@query("""WITH b AS (SELECT min(p_size) AS a, max(p_size) AS b, avg(p_size) AS m, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)
SELECT round(a + (b - a) * i / 9, 6) AS p_size, round(c + (d - c) * j / 9, 6) AS p_retailprice, (a + (b - a) * i / 9 > 25)::INT AS above FROM b, range(10) r(i), range(10) s(j) WHERE abs(a + (b - a) * i / 9 - 25) > 3""")
def decided_surface(spark, sf_dir):
    """A line that separates sizes at 25; a band around it, where the fit is free, is left out."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_size") > 25).cast("double").alias("label"))
    model = learn.logistic_fit(parts, ["p_size", "p_retailprice"], "label")
    surface = learn.decision_surface(parts, model, ["p_size", "p_retailprice"], 10)
    return rounded(surface.where("abs(p_size - 25) > 3").select("p_size", "p_retailprice", F.col("prediction").cast("int").alias("above")))


@query("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS c, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) SELECT i AS id, round(a + (b - a) * i / 59, 4) AS l_quantity, round(c + s * (a + (b - a) * i / 59), 3) AS prediction FROM f, range(60) r(i)")
def dependence_line(spark, sf_dir):
    item = read(spark, sf_dir, "lineitem").select("l_extendedprice", F.col("l_quantity").cast("double").alias("l_quantity"))
    model = learn.linear_fit(item, ["l_quantity"], "l_extendedprice")
    out = learn.partial_dependence(item, model, ["l_quantity"], "l_quantity")
    return out.select("id", numeric.half_away(F.col("l_quantity"), 4).alias("l_quantity"), numeric.half_away(F.col("prediction"), 3).alias("prediction"))


@query("SELECT p_partkey, (p_retailprice > (SELECT avg(p_retailprice) FROM part))::INT AS above FROM part")
def logistic_classes(spark, sf_dir):
    """A separable task: after the fit every part is on its side of the mean."""
    parts = learn.centred(read(spark, sf_dir, "part"), "p_retailprice", "side").select("p_partkey", (F.col("side") * 1.0).alias("price"), (F.col("side") > 0).cast("double").alias("label"))
    model = learn.logistic_fit(parts, ["price"], "label")
    return model.transform(learn.assembled(parts, ["price"])).select("p_partkey", F.col("prediction").cast("int").alias("above"))


@query("SELECT count(*) AS rows FROM part")
def split_rows(spark, sf_dir):
    """Both parts of a split together are all rows, and no row is in both."""
    train, check = learn.split(read(spark, sf_dir, "part"), "p_partkey")
    return train.unionByName(check).select("p_partkey").distinct().agg(F.count("*").alias("rows"))


@query("SELECT p_partkey FROM part")
def regressed_parts(spark, sf_dir):
    """Parts with a prediction within a tenth of the prices' span, by a network that learnt them from size and key."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") * 3.0 + 7).alias("y"))
    model = learn.perceptron_regression(parts, ["p_size"], "y", "p_partkey", hidden=(16,), epochs=80, rate=0.5)
    return model.transform(parts, ["p_size"]).where("abs(prediction - y) < 15").select("p_partkey")
