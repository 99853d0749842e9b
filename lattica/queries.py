"""Queries over the driver's tables, one or more for each operator, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import half_away
from .operators import charts, graphs, grid, motion, project, rows, stats, trees
from .operators.learn import line_fit
from .sources import generate
from .table import ROW, Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as SQL does, zeros without a sign: sums come in another order in SQL."""
    return df.select(*((half_away(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


def by_key(df: DataFrame, key: str) -> Table:
    """A table in the order of a unique key, which stays a column."""
    return Table(df.withColumn(ROW, F.col(key)))


@query("""
WITH f AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_quantity BETWEEN 10 AND 30),
 b AS (SELECT min(v) AS lo, max(v) AS hi FROM f), n AS (SELECT (v - lo) / (hi - lo) AS x FROM f, b),
 c AS (SELECT min(x) AS lo, max(x) AS hi FROM n),
 h AS (SELECT least(9, floor((x - lo) / ((hi - lo) / 10)))::BIGINT AS bin, count(*)::DOUBLE AS count FROM n, c GROUP BY 1)
SELECT r.bin, round(lo + (hi - lo) / 10 * (r.bin + 0.5), 6) AS center, coalesce(h.count, 0.0) AS count
FROM (SELECT range AS bin FROM range(10)) r CROSS JOIN c LEFT JOIN h ON h.bin = r.bin""")
def flow_graph_pipeline(spark, sf_dir):
    """Range filter, min-max normalisation and histogram of lineitem prices, as a graph of blocks."""
    from .plans import blocks, graph

    g = graph.Graph(
        [graph.Node("a", "test.input"), graph.Node("b", "filter.range", {"column": "l_quantity", "min": 10, "max": 30}), graph.Node("c", "transform.normalize", {"column": "l_extendedprice", "mode": "minmax"}), graph.Node("d", "stats.histogram", {"column": "l_extendedprice_minmax", "bins": 10})],
        [graph.Edge("a", "table", "b", "table"), graph.Edge("b", "table", "c", "table"), graph.Edge("c", "table", "d", "table")],
    )
    own = blocks.standard(spark)
    source = Table(read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"))
    own.register(blocks.Block("test.input", {}, {"table": "DataTable"}, {}, lambda inputs, params: {"table": source}))
    out = graph.run(g, own)["d"]["table"].df
    return rounded(out.select(F.col(ROW).alias("bin"), "center", "count"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_graph_pipeline(spark, sf_dir)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def select_columns(spark, sf_dir):
    return project.select_columns(Table(read(spark, sf_dir, "orders")), ["o_orderkey", "o_totalprice"]).df


@query("SELECT o_orderkey AS key, o_totalprice FROM orders")
def rename_column(spark, sf_dir):
    t = project.select_columns(Table(read(spark, sf_dir, "orders")), ["o_orderkey", "o_totalprice"])
    return project.rename_column(t, "o_orderkey", "key").df


@query("SELECT o_orderkey, 1.0::DOUBLE AS rank FROM orders")
def add_constant_column(spark, sf_dir):
    return project.add_constant(Table(read(spark, sf_dir, "orders").select("o_orderkey")), "rank", 1).df


@query("SELECT r_regionkey::BIGINT AS r_regionkey, (r_regionkey * 10 + 1)::DOUBLE AS extra FROM region")
def add_value_column(spark, sf_dir):
    t = by_key(read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long")), "r_regionkey")
    return project.add_values(t, "extra", [1, 11, 21, 31, 41]).to_df()


@query("SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS o_totalprice_minmax FROM orders")
def normalize_minmax(spark, sf_dir):
    t = project.normalize(Table(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")), "o_totalprice", "minmax")
    return rounded(t.df.drop("o_totalprice"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) + 0.0 AS o_totalprice_zscore FROM orders")
def normalize_zscore(spark, sf_dir):
    t = project.normalize(Table(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")), "o_totalprice", "zscore")
    return rounded(t.df.drop("o_totalprice"))


@query("SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events")
def sort_desc(spark, sf_dir):
    t = rows.sort_rows(by_key(read(spark, sf_dir, "events").select("event_id", "value"), "event_id"), "value", descending=True)
    return t.df.withColumnRenamed(ROW, "place")


@query("SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS place FROM events")
def sort_asc(spark, sf_dir):
    t = rows.sort_rows(by_key(read(spark, sf_dir, "events").select("event_id", "value"), "event_id"), "value")
    return t.df.withColumnRenamed(ROW, "place")


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 30")
def filter_range(spark, sf_dir):
    return rows.filter_range(Table(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")), "l_quantity", 10, 30).df


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity = 17")
def filter_value(spark, sf_dir):
    return rows.filter_value(Table(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")), "l_quantity", 17).df


def _where(op: str):
    def f(spark, sf_dir):
        return rows.filter_where(Table(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")), "l_quantity", op, 25).df

    return f


for _name, _op in (("eq", "=="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    QUERIES[f"filter_where_{_name}"] = _where(_op)
    SQL[f"filter_where_{_name}"] = f"SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity {'=' if _op == '==' else _op} 25"


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def top_k_largest(spark, sf_dir):
    return rows.top_k(by_key(read(spark, sf_dir, "events").select("event_id", "value"), "event_id"), "value", 20).to_df()


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 20")
def top_k_smallest(spark, sf_dir):
    return rows.top_k(by_key(read(spark, sf_dir, "events").select("event_id", "value"), "event_id"), "value", 20.7, largest=False).to_df()


def _math(op: str, other):
    def f(spark, sf_dir):
        t = Table(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").withColumn("rest", F.col("o_orderkey") % 7 - 3.0))
        df = project.binary(t, op, "o_totalprice", other).df
        # of these two doubles SQL takes the sign off a zero of the second alone
        return df.select("o_orderkey", half_away(F.col("o_totalprice"), 4).alias("o_totalprice"), (half_away(F.col(f"o_totalprice_{op}"), 4) + F.lit(0.0)).alias(f"o_totalprice_{op}"))

    return f


for _op, _sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    for _kind, _other, _sql in (("column", "rest", "(o_orderkey % 7 - 3)::DOUBLE"), ("number", 2.5, "2.5::DOUBLE")):
        QUERIES[f"math_{_op}_{_kind}"] = _math(_op, _other)
        SQL[f"math_{_op}_{_kind}"] = f"SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, round(o_totalprice {_sign} {_sql}, 4) + 0.0 AS o_totalprice_{_op} FROM orders"


@query("SELECT c_custkey, c_acctbal, round(CASE WHEN c_acctbal < 0 THEN 'nan'::DOUBLE ELSE sqrt(abs(c_acctbal)) END, 6) AS c_acctbal_sqrt FROM customer")
def math_sqrt(spark, sf_dir):
    return rounded(project.unary(Table(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")), "sqrt", "c_acctbal").df)


@query("SELECT c_custkey, c_acctbal, abs(c_acctbal) AS c_acctbal_abs FROM customer")
def math_abs(spark, sf_dir):
    return project.unary(Table(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")), "abs", "c_acctbal").df


_FIVE = "SELECT '{s}' AS stat, round({q}, 6) AS o_totalprice, round({k}, 6) AS o_custkey FROM orders"


@query(" UNION ALL ".join(_FIVE.format(s=s, q=f.format("o_totalprice"), k=f.format("o_custkey::DOUBLE")) for s, f in (("mean", "avg({})"), ("std", "stddev_pop({})"), ("min", "min({})"), ("max", "max({})"), ("median", "median({})"))))
def summary_all(spark, sf_dir):
    return rounded(stats.summary(Table(read(spark, sf_dir, "orders").select("o_totalprice", "o_custkey", "o_orderstatus"))).to_df())


@query(" UNION ALL ".join(f"SELECT '{s}' AS stat, round({f}, 6) AS value FROM events" for s, f in (("mean", "avg(value)"), ("std", "stddev_pop(value)"), ("min", "min(value)"), ("max", "max(value)"), ("median", "median(value)"))))
def summary_one(spark, sf_dir):
    return rounded(stats.summary(Table(read(spark, sf_dir, "events")), "value").to_df())


_HIST = """WITH b AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
 h AS (SELECT {at} AS bin, count(*) AS n FROM {t}, b GROUP BY 1)
SELECT r.bin, {out} FROM (SELECT range AS bin FROM range({n})) r CROSS JOIN b LEFT JOIN h ON h.bin = r.bin"""


@query(_HIST.format(c="o_totalprice", t="orders", n=25, at="least(24, floor((o_totalprice - lo) / ((hi - lo) / 25)))::BIGINT", out="round(lo + (hi - lo) / 25 * (r.bin + 0.5), 6) AS center, coalesce(n, 0)::DOUBLE AS count"))
def histogram(spark, sf_dir):
    return rounded(stats.histogram(read(spark, sf_dir, "orders"), "o_totalprice", 25))


@query("SELECT bin, count, round(log2(count + 1.0) / log2(max(count) OVER () + 1.0), 6) AS log_height FROM (" + _HIST.format(c="o_totalprice", t="orders", n=30, at="least(29, floor((o_totalprice - lo) / (hi - lo) * 30))::BIGINT", out="coalesce(n, 0) AS count") + ") AS q(bin, count)")
def histogram_chart(spark, sf_dir):
    return rounded(stats.histogram_chart(read(spark, sf_dir, "orders"), "o_totalprice"))


@query("WITH h AS (SELECT least(19, floor((value - 50.0) / 350.0 * 20))::BIGINT AS bin, count(*) AS n FROM events WHERE value BETWEEN 50 AND 400 GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS count FROM (SELECT range AS bin FROM range(20)) r LEFT JOIN h ON h.bin = r.bin")
def histogram_fixed_range(spark, sf_dir):
    return stats.histogram_between(read(spark, sf_dir, "events"), "value", 20, 50.0, 400.0)


_LCG = "WITH RECURSIVE s(i, v) AS (SELECT -1::BIGINT, {seed}::BIGINT UNION ALL SELECT i + 1, (v * 1664525 + 1013904223) % 4294967296 FROM s WHERE i < {n} - 1)"


_COUNT = "(SELECT count(*) FROM {})"


def _rows(spark, sf_dir, name: str) -> int:
    """A count for generators: one number."""
    return read(spark, sf_dir, name).count()


@query(_LCG.format(seed=42, n=_COUNT.format("customer")) + " SELECT i AS id, v / 4294967295.0::DOUBLE AS x FROM s WHERE i >= 0")
def source_random(spark, sf_dir):
    """As many numbers as there are customers."""
    n = _rows(spark, sf_dir, "customer")
    return generate.random_data(spark, n, 42, most=n).df.withColumnRenamed(ROW, "id")


@query(_LCG.format(seed=1, n=_COUNT.format("supplier")) + ", c AS (SELECT count(*)::DOUBLE AS n FROM supplier) SELECT i AS id, round(i / n * 2 * pi(), 9) AS t, round(sin(i / n * 2 * pi()) + (v / 4294967295.0::DOUBLE - 0.5) * 0.2, 9) + 0.0 AS x FROM s, c WHERE i >= 0")
def source_example(spark, sf_dir):
    n = _rows(spark, sf_dir, "supplier")
    return rounded(generate.example_data(spark, n, 1, most=n).df.withColumnRenamed(ROW, "id"), 9)


@query("WITH n AS (SELECT unnest(range(count(*))) AS i FROM supplier) SELECT a.i::DOUBLE AS x, b.i::DOUBLE AS y, (a.i + b.i)::DOUBLE AS x_add FROM n a, n b")
def source_grid(spark, sf_dir):
    """A grid with as many rows and columns as there are suppliers."""
    n = _rows(spark, sf_dir, "supplier")
    return project.binary(generate.grid_data(spark, n, most=n), "add", "x", "y").to_df()


@query("SELECT (5 - i * 0.5)::DOUBLE AS value FROM (SELECT unnest(range(2 * count(*))) AS i FROM customer)")
def range_table(spark, sf_dir):
    return generate.range_data(spark, 5, 5 - _rows(spark, sf_dir, "customer"), -0.5).to_df()


def _mid(p: float) -> str:
    return f"(s[floor((n - 1) * {p})::BIGINT + 1] + s[ceil((n - 1) * {p})::BIGINT + 1]) / 2"


_BOXES = f"WITH l AS (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n FROM events GROUP BY 1), q AS (SELECT event_type, n, {_mid(0.25)} AS q1, {_mid(0.5)} AS median, {_mid(0.75)} AS q3 FROM l)"


@query(_BOXES + """ SELECT event_type, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
 min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
 count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q USING (event_type) GROUP BY 1""")
def box_stats(spark, sf_dir):
    return rounded(charts.box_stats(read(spark, sf_dir, "events"), "event_type", "value"))


@query(_BOXES + " SELECT event_type, event_id, value FROM events JOIN q USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def box_outliers(spark, sf_dir):
    return charts.box_outliers(read(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "value")


@query("WITH l AS (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, s[floor(n * 0.25)::BIGINT + 1] AS q1, s[floor(n * 0.5)::BIGINT + 1] AS median, s[floor(n * 0.75)::BIGINT + 1] AS q3 FROM l")
def violin_box(spark, sf_dir):
    return charts.violin_box(read(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), g AS (SELECT event_type, count(*) AS n, stddev_pop(value) * 1.06 * pow(count(*), -0.2) AS h FROM events GROUP BY 1),
 p AS (SELECT range AS point, lo - (hi - lo) * 0.05 + (hi - lo) * 1.1 * range / 64 AS x FROM range(65), b)
SELECT event_type, point, round(x, 4) AS x, round(sum(exp(-0.5 * pow((x - value) / h, 2))) / (any_value(n) * any_value(h)), 9) AS density FROM events JOIN g USING (event_type) CROSS JOIN p GROUP BY event_type, point, p.x""")
def violin_density(spark, sf_dir):
    return charts.kernel_density(read(spark, sf_dir, "events"), "event_type", "value").select("event_type", "point", F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


def _probit_sql(p: str) -> str:
    from .functions.numeric import PROBIT_A, PROBIT_B, PROBIT_C, PROBIT_D, PROBIT_LOW

    def poly(terms, x):
        out = f"({terms[0]!r})"
        for t in terms[1:]:
            out = f"({out} * {x} + ({t!r}))"
        return out

    q, r = f"({p} - 0.5::DOUBLE)", f"pow({p} - 0.5::DOUBLE, 2)"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    side = lambda x: f"{poly(PROBIT_C, x)} / {poly(PROBIT_D, x)}"
    return f"CASE WHEN {p} < {PROBIT_LOW} THEN {side(low)} WHEN {p} > 1 - {PROBIT_LOW} THEN -({side(high)}) ELSE {q} * {poly(PROBIT_A, r)} / {poly(PROBIT_B, r)} END"


@query(f"WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n, avg(o_totalprice) OVER () AS m, stddev_samp(o_totalprice) OVER () AS s FROM orders), p AS (SELECT *, (rn - 0.5::DOUBLE) / n AS p FROM r) SELECT rn, round({_probit_sql('p')}, 6) + 0.0 AS theoretical, round((v - m) / s, 6) + 0.0 AS sample FROM p")
def qq_points(spark, sf_dir):
    return rounded(charts.qq_points(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"]))


@query("SELECT event_type, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def series_stats(spark, sf_dir):
    return rounded(stats.series_stats(read(spark, sf_dir, "events"), "event_type", "value"))


@query("SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def series_normalized(spark, sf_dir):
    return rounded(stats.series_scaled(read(spark, sf_dir, "events"), "event_type", "value").select("event_id", "scaled"))


@query("WITH t AS (SELECT c_mktsegment, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT c_mktsegment, round(total, 2) AS total, row_number() OVER (ORDER BY total DESC, c_mktsegment) - 1 AS slot, round(least(0.0, min(total) OVER ()), 2) AS axis_min, round(greatest(0.0, max(total) OVER ()), 2) AS axis_max FROM t")
def bar_totals(spark, sf_dir):
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(charts.bar_totals(joined, "c_mktsegment", "o_totalprice"), 2)


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS p_size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def parallel_scaled(spark, sf_dir):
    return rounded(project.scale_columns(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


_RADAR = ["customers", "balance", "least", "most"]


@query("WITH m AS (SELECT c_nationkey, count(*)::DOUBLE AS customers, avg(c_acctbal) AS balance, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1), r AS (SELECT c_nationkey, k AS axis, [customers, balance, least, most][k + 1] / greatest(1.0, abs(customers), abs(balance), abs(least), abs(most)) AS radius, 2 * pi() * k / 4 - pi() / 2 AS angle FROM m, (SELECT range::INT AS k FROM range(4))) SELECT c_nationkey, axis, round(radius, 6) AS radius, round(angle, 6) + 0.0 AS angle, round(radius * cos(angle), 6) + 0.0 AS x, round(radius * sin(angle), 6) + 0.0 AS y FROM r")
def radar_vertices(spark, sf_dir):
    m = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("customers"), F.avg("c_acctbal").alias("balance"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"))
    return rounded(charts.radar_vertices(m, "c_nationkey", _RADAR))


@query("WITH d AS (SELECT date_part('day', ts)::BIGINT AS day, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1) SELECT day, round(mean, 6) AS mean, round(mean - abs(std), 6) + 0.0 AS lo, round(mean + abs(std), 6) AS hi FROM d")
def error_band(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").cast("long").alias("day")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return rounded(charts.error_band(days, "day", "mean", "std"))


@query("SELECT p_partkey, round(3 + (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE * 21, 6) AS radius, round(greatest(0.0, least(1.0, (p_retailprice - min(p_retailprice) OVER ()) / greatest(max(p_retailprice) OVER () - min(p_retailprice) OVER (), 1e-9))), 6) AS t FROM part")
def bubble_marks(spark, sf_dir):
    return rounded(charts.ramp_place(charts.bubble_radius(read(spark, sf_dir, "part"), "p_size"), "p_retailprice").select("p_partkey", "radius", "t"))


_EDGES = "(SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"


@query(f"SELECT id, count(*) AS degree FROM (SELECT source AS id FROM {_EDGES} UNION ALL SELECT target FROM {_EDGES}) GROUP BY 1")
def network_degree(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    return graphs.degree(edges)


def _flows(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    value = F.sum(F.abs("c_acctbal")).alias("value")
    a = c.groupBy(F.col("r_name").alias("source"), F.col("n_name").alias("target")).agg(value)
    return a.unionByName(c.groupBy(F.col("n_name").alias("source"), F.col("c_mktsegment").alias("target")).agg(value))


_FLOWS = "WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), e AS (SELECT r_name AS source, n_name AS target, sum(abs(c_acctbal)) AS value FROM c GROUP BY 1, 2 UNION ALL SELECT n_name, c_mktsegment, sum(abs(c_acctbal)) FROM c GROUP BY 1, 2)"


@query(_FLOWS + " SELECT id, round(sum(i), 4) + 0.0 AS inflow, round(sum(o), 4) + 0.0 AS outflow FROM (SELECT target AS id, value AS i, 0.0::DOUBLE AS o FROM e UNION ALL SELECT source, 0.0::DOUBLE, value FROM e) GROUP BY 1")
def flow_inout(spark, sf_dir):
    return rounded(graphs.flow_totals(_flows(spark, sf_dir), "value"), 4)


@query(_FLOWS.replace("WITH c", "WITH RECURSIVE c") + ", b(id, level) AS (SELECT DISTINCT source, 0 FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT e.target, b.level + 1 FROM b JOIN e ON e.source = b.id WHERE b.level < 10) SELECT id, min(level) AS level FROM b GROUP BY 1")
def flow_levels(spark, sf_dir):
    return graphs.flow_levels(_flows(spark, sf_dir))


@query(_FLOWS + " SELECT source, target, round(coalesce(sum(value) OVER (PARTITION BY source ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS \"offset\" FROM e")
def running_offset(spark, sf_dir):
    return rounded(graphs.ribbon_offsets(_flows(spark, sf_dir), "source", "value", "target").drop("value"), 4)


@query("WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, 100000 + s_nationkey AS b FROM supplier), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(id, reach) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reach) SELECT id, min(reach) AS component FROM r GROUP BY 1")
def components(spark, sf_dir):
    edges = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.lit(100000) + F.col("s_nationkey")).cast("long").alias("target"))
    return graphs.connected(edges.select(F.explode(F.array("source", "target")).alias("id")), edges)


def _tree(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "n_name", "c_mktsegment").alias("label"), F.col("n_name").alias("parent"), F.abs("c_acctbal").alias("size"))
    up = n.select(F.col("n_name").alias("label"), F.col("r_name").alias("parent"), F.lit(0.0).alias("size")).unionByName(read(spark, sf_dir, "region").select(F.col("r_name").alias("label"), F.lit("").alias("parent"), F.lit(0.0).alias("size")))
    return trees.tree_nodes(leaves.unionByName(up))


_TREE = "WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT n_name || '/' || c_mktsegment AS label, n_name, r_name, sum(abs(c_acctbal)) AS size FROM customer JOIN n ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"


@query(_TREE + " SELECT label, 3 AS depth, round(size, 4) AS total FROM c UNION ALL SELECT n.n_name, 2, round(coalesce(sum(size), 0.0), 4) FROM n LEFT JOIN c ON c.n_name = n.n_name GROUP BY 1 UNION ALL SELECT region.r_name, 1, round(coalesce(sum(size), 0.0), 4) FROM region LEFT JOIN c ON c.r_name = region.r_name GROUP BY 1")
def tree_rollup(spark, sf_dir):
    return rounded(trees.rolled_up(trees.depths(_tree(spark, sf_dir))).select("label", "depth", "total"), 4)


@query(_TREE + " SELECT label, 1::BIGINT AS leaves FROM c UNION ALL SELECT n.n_name, greatest(1, count(label)) FROM n LEFT JOIN c ON c.n_name = n.n_name GROUP BY 1 UNION ALL SELECT r_name, sum(k)::BIGINT FROM (SELECT n.r_name, n.n_name, greatest(1, count(label)) AS k FROM n LEFT JOIN c ON c.n_name = n.n_name GROUP BY 1, 2) GROUP BY 1")
def tree_leaves(spark, sf_dir):
    return trees.leaf_counts(trees.depths(_tree(spark, sf_dir)))


@query(_TREE + " SELECT label, row_number() OVER (ORDER BY p) - 1 AS index FROM (SELECT label, r_name || chr(1) || n_name || chr(1) || label AS p FROM c UNION ALL SELECT n_name, r_name || chr(1) || n_name FROM n UNION ALL SELECT r_name, r_name FROM region)")
def tree_preorder(spark, sf_dir):
    return trees.preorder(trees.depths(_tree(spark, sf_dir))).select("label", "index")


@query("WITH d AS (SELECT date_part('day', ts)::BIGINT AS day, avg(value) AS mean FROM events GROUP BY 1) SELECT day, round(mean, 6) AS mean, round(avg(mean) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM d")
def moving_average(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").cast("long").alias("day")).agg(F.avg("value").alias("mean"))
    return rounded(charts.moving_average(days, "day", "mean", 5))


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY event_id) AS rn FROM events) SELECT k, count(*) AS n, round(avg(value), 6) AS mean FROM r JOIN (SELECT unnest([200, 500, 1000]) AS k) ON rn <= k GROUP BY 1")
def prefix_means(spark, sf_dir):
    return rounded(charts.prefix_mean(read(spark, sf_dir, "events"), "event_id", "value", [200, 500, 1000]))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 37 = 0")
def stride_sample(spark, sf_dir):
    return rows.every_nth(read(spark, sf_dir, "events").select("event_id"), "event_id", 37)


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT range AS sample, event_id FROM range(250) JOIN r ON i = floor(range * n / 250.0)")
def systematic_resample(spark, sf_dir):
    return rows.resampled(read(spark, sf_dir, "events").select("event_id"), "event_id", 250).select("sample", "event_id")


@query("WITH b AS (SELECT min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part), t AS (SELECT *, least(640 / ((x1 - x0) * 1.24), 480 / ((y1 - y0) * 1.24)) AS s FROM b) SELECT p_partkey, round(320 - s * (x0 + x1) / 2 + p_size * s, 6) AS sx, round(240 + s * (y0 + y1) / 2 - p_retailprice * s, 6) AS sy, 1 AS vis FROM part, t")
def point_projection(spark, sf_dir):
    return rounded(grid.project_fitted(read(spark, sf_dir, "part"), "p_size", "p_retailprice", 640, 480).select("p_partkey", "sx", "sy", "vis"))


def _cells(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy((F.dayofmonth("ts") % 7).alias("row"), F.hour("ts").alias("col")).agg(F.count("*").cast("double").alias("value"))


_CELLS = "WITH g AS (SELECT (date_part('day', ts) % 7)::BIGINT AS row, date_part('hour', ts)::BIGINT AS col, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2)"


def _heat_sql(k: int) -> str:
    out = f"{grid.HEAT[-1][1][k]}"
    for (a, x), (b, y) in reversed(list(zip(grid.HEAT, grid.HEAT[1:]))):
        out = f"CASE WHEN t <= {b} THEN {x[k]} + (t - {a}) / {b - a} * ({y[k]} - ({x[k]})) ELSE {out} END"
    return f"round(({out})::DOUBLE, 6)"


@query(_CELLS + f", h AS (SELECT row, col, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS t FROM g) SELECT row, col, {_heat_sql(0)} AS red, {_heat_sql(1)} AS green, {_heat_sql(2)} AS blue FROM h")
def heatmap_colors(spark, sf_dir):
    out = rounded(grid.heat_colors(_cells(spark, sf_dir)))
    return out.select(F.col("row").cast("long"), F.col("col").cast("long"), "red", "green", "blue")


@query(_CELLS + """, s AS (SELECT a.row, a.col, a.value AS tl, b.value AS tr, c.value AS bl, d.value AS br FROM g a JOIN g b ON b.row = a.row AND b.col = a.col + 1 JOIN g c ON c.row = a.row + 1 AND c.col = a.col JOIN g d ON d.row = a.row + 1 AND d.col = a.col + 1),
 z AS (SELECT k.range AS k, lo + (hi - lo) * k.range / 6 AS level FROM range(1, 6) k, (SELECT min(value) AS lo, max(value) AS hi FROM g))
SELECT k, row, col, round(level, 6) AS level, ((tl < level) <> (tr < level))::INT + ((tr < level) <> (br < level))::INT + ((bl < level) <> (br < level))::INT + ((tl < level) <> (bl < level))::INT AS sides FROM s, z WHERE sides >= 2""")
def contour_cells(spark, sf_dir):
    s = grid.contour_segments(_cells(spark, sf_dir), 5)
    return rounded(s.groupBy("k", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "level").agg((F.count("*") * 2).cast("int").alias("sides")))


@query(_CELLS + ", p AS (SELECT x.range * 0.7 AS fx, y.range * 0.45 AS fy FROM range(30) x, range(12) y), q AS (SELECT fx, fy, least(floor(fx), 22)::BIGINT AS col, least(floor(fy), 5)::BIGINT AS row FROM p) SELECT round(fx, 4)::DOUBLE AS fx, round(fy, 4)::DOUBLE AS fy, round((a.value * (1 - (fx - q.col)) + b.value * (fx - q.col)) * (1 - (fy - q.row)) + (c.value * (1 - (fx - q.col)) + d.value * (fx - q.col)) * (fy - q.row), 6)::DOUBLE AS value FROM q JOIN g a ON a.row = q.row AND a.col = q.col JOIN g b ON b.row = q.row AND b.col = q.col + 1 JOIN g c ON c.row = q.row + 1 AND c.col = q.col JOIN g d ON d.row = q.row + 1 AND d.col = q.col + 1")
def bilinear_sample(spark, sf_dir):
    p = spark.range(30).select((F.col("id") * 0.7).alias("fx")).crossJoin(F.broadcast(spark.range(12).select((F.col("id") * 0.45).alias("fy"))))
    return rounded(rounded(grid.bilinear(_cells(spark, sf_dir), p), 6).select(half_away(F.col("fx"), 4).alias("fx"), half_away(F.col("fy"), 4).alias("fy"), "value"))


def _bodies(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.sin("s_suppkey").alias("x"), F.cos("s_suppkey").alias("y"), F.sin(F.col("s_suppkey") * 2.0).alias("z"), (F.col("s_acctbal") / 1e4).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.1).alias("vz"), (1 + F.col("s_suppkey") % 5).cast("double").alias("m"))


_BODIES = "WITH b AS (SELECT s_suppkey AS id, sin(s_suppkey) AS x, cos(s_suppkey) AS y, sin(s_suppkey * 2.0::DOUBLE) AS z, s_acctbal / 1e4 AS vx, 0.0::DOUBLE AS vy, 0.1::DOUBLE AS vz, (1 + s_suppkey % 5)::DOUBLE AS m FROM supplier)"


@query(_BODIES + """, p AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, 0.05 * a.m * b.m AS gm, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) + 0.0009::DOUBLE AS r2 FROM b a JOIN b ON a.id <> b.id),
 f AS (SELECT id, sum(gm * dx / (r2 * sqrt(r2))) AS fx, sum(gm * dy / (r2 * sqrt(r2))) AS fy, sum(gm * dz / (r2 * sqrt(r2))) AS fz FROM p GROUP BY 1)
SELECT id, round(x + (vx + fx * 0.001) * 0.001, 6) + 0.0 AS x, round(y + (vy + fy * 0.001) * 0.001, 6) + 0.0 AS y, round(z + (vz + fz * 0.001) * 0.001, 6) + 0.0 AS z, round(vx + fx * 0.001, 6) + 0.0 AS vx, round(vy + fy * 0.001, 6) + 0.0 AS vy, round(vz + fz * 0.001, 6) + 0.0 AS vz, m FROM b JOIN f USING (id)""")
def nbody_step(spark, sf_dir):
    return rounded(motion.bodies_step(_bodies(spark, sf_dir)))


@query(_BODIES + ", k AS (SELECT sum(0.5 * m * (vx * vx + vy * vy + vz * vz)) AS kinetic FROM b), p AS (SELECT -sum(0.05 * a.m * b.m / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) + 0.0009::DOUBLE)) AS potential FROM b a JOIN b ON a.id < b.id) SELECT round(kinetic, 6) AS kinetic, round(potential, 6) AS potential, round(kinetic + potential, 6) AS energy FROM k, p")
def nbody_energy(spark, sf_dir):
    return rounded(motion.total_energy(_bodies(spark, sf_dir)))


@query("""WITH RECURSIVE s(id, t, x, y, vx, vy) AS (SELECT s_suppkey, 0, sin(s_suppkey), cos(s_suppkey), s_acctbal / 1e3, sin(s_suppkey * 3.0::DOUBLE) FROM supplier UNION ALL
 SELECT id, t + 1, greatest(-1.0, least(1.0, x + vx * 0.01::DOUBLE)), greatest(-1.0, least(1.0, y + vy * 0.01::DOUBLE)), CASE WHEN abs(x + vx * 0.01::DOUBLE) > 1 THEN -vx ELSE vx END, CASE WHEN abs(y + vy * 0.01::DOUBLE) > 1 THEN -vy ELSE vy END FROM s WHERE t < 240)
SELECT id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy FROM s WHERE t = 240""")
def particles_240(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.sin("s_suppkey").alias("x"), F.cos("s_suppkey").alias("y"), (F.col("s_acctbal") / 1e3).alias("vx"), F.sin(F.col("s_suppkey") * 3.0).alias("vy"))
    return rounded(motion.particles(s))


_ALIVE = "WITH a AS (SELECT o_orderkey % 40 AS x, o_custkey % 30 AS y FROM orders GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


@query(_ALIVE + ", n AS (SELECT (x + dx + 40) % 40 AS x, (y + dy + 30) % 30 AS y FROM a, (SELECT i.range - 1 AS dx, j.range - 1 AS dy FROM range(3) i, range(3) j) WHERE dx <> 0 OR dy <> 0), c AS (SELECT x, y, count(*) AS k FROM n GROUP BY 1, 2) SELECT x, y FROM c WHERE k = 3 UNION SELECT c.x, c.y FROM c JOIN a ON a.x = c.x AND a.y = c.y WHERE k = 2")
def life_step(spark, sf_dir):
    alive = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 40).alias("x"), (F.col("o_custkey") % 30).alias("y")).count().where("count % 2 = 1").drop("count")
    return grid.life_step(alive, 40, 30)


@query("""WITH RECURSIVE p AS (SELECT (range // 48)::INT AS row, (range % 48)::INT AS col, -0.5 + ((range % 48 + 0.5) / 48.0::DOUBLE - 0.5) * 3.0 AS cx, ((range // 48 + 0.5) / 32.0::DOUBLE - 0.5) * 3.0 * 32 / 48 AS cy FROM range(1536)),
 z(row, col, cx, cy, x, y, n, t) AS (SELECT row, col, cx::DOUBLE, cy::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0 FROM p UNION ALL SELECT row, col, cx, cy, CASE WHEN x * x + y * y <= 4 THEN x * x - y * y + cx ELSE x END, CASE WHEN x * x + y * y <= 4 THEN 2 * x * y + cy ELSE y END, n + (x * x + y * y <= 4)::INT, t + 1 FROM z WHERE t < 60)
SELECT row, col, n FROM z WHERE t = 60""")
def mandelbrot_counts(spark, sf_dir):
    return motion.escape_counts(spark, 48, 32, 60)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def linreg_fit(spark, sf_dir):
    fit = line_fit(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return fit.select(*(half_away(F.col(c), d).alias(c) for c, d in (("slope", 6), ("intercept", 4), ("r2", 6))))


def _more() -> None:
    """The queries of the readers and of large inputs, which use this module's helpers."""
    from . import queries_large, queries_readers  # noqa: F401


_more()
