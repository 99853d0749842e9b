"""Queries of readers, sinks and learners that no driver and no single task holds: files are written from the driver's tables, then
read back, and SQL says what must come out."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import colors
from .functions.numeric import half_away
from .functions.storage import shared_folder
from .operators import learn, rows, trees
from .plans import blocks, plugins
from .queries import query, read, rounded
from .sources import files, heads, json_documents, sinks
from .studio import Studio
from .table import ROW, Table


def folder(spark: SparkSession, ending: str = "") -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}{ending}"


# JSON documents


def documents_for(df: DataFrame, least: int = 3, size: int = 64 << 20) -> int:
    """How many JSON documents hold the rows with about `size` bytes each, which is what the task that writes one reads."""
    return max(least, math.ceil((df.agg(F.sum(F.octet_length(F.concat_ws(",", *df.columns)))).first()[0] or 0) / size))


_ODD = """ || '",[{\\'"""


@query(f"SELECT doc_id::DOUBLE AS doc_id, coalesce(text, ''){_ODD} AS text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE n_chars::VARCHAR END AS n_chars FROM documents")
def read_json_documents(spark, sf_dir):
    """Texts with the signs of JSON at their ends, as records of a document for each partition, and back."""
    path = folder(spark, ".json")
    d = read(spark, sf_dir, "documents")
    d = d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit('",[{\\')).alias("text"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("n_chars"))
    json_documents.write_documents(d.repartitionByRange(documents_for(d), "doc_id"), path)
    return files.load_file(spark, path).to_df()


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey::DOUBLE AS key, o_totalprice AS price, o_orderpriority AS priority FROM orders")
def read_json_order(spark, sf_dir):
    """The places of records are those in the document, whatever range of it they come from."""
    path = folder(spark, ".json")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    json_documents.write_documents(o.repartitionByRange(documents_for(o, 4), "key").sortWithinPartitions("key"), path)
    return files.load_file(spark, path).df.withColumnRenamed(ROW, "place")


# first bytes of files


def _image(kind: str, width: str, height: str) -> Column:
    """The head of an image file: a PNG where kind is 0, else a GIF."""
    big = lambda c: F.unhex(F.lpad(F.hex(F.expr(c).cast("long")), 8, "0"))
    little = lambda c: F.unhex(F.concat(F.lpad(F.hex((F.expr(c) % 256).cast("long")), 2, "0"), F.lpad(F.hex(F.floor(F.expr(c) / 256).cast("long")), 2, "0")))
    raw = lambda x: F.unhex(F.lit(x.hex()))
    png = F.concat(raw(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"), big(width), big(height))
    gif = F.concat(raw(b"GIF89a"), little(width), little(height))
    return F.when(F.expr(kind) == 0, png).otherwise(gif)


@query("SELECT page_id, (page_id % 900 + 1)::INT AS width, (length(html) % 60000)::INT AS height FROM pages")
def image_sizes(spark, sf_dir):
    """Sizes of images, a file for each page, whose bodies are the pages: headers alone are read."""
    path = folder(spark)
    p = read(spark, sf_dir, "pages")
    content = F.concat(_image("page_id % 2", "page_id % 900 + 1", "length(html) % 60000"), F.encode("html", "utf-8"))
    heads.write_files(p.select(F.concat("page_id", F.when(F.col("page_id") % 2 == 0, ".png").otherwise(".gif")).alias("name"), content.alias("content")), path)
    return files.image_sizes(spark, path).select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("page_id"), "width", "height")


_HEADS = "CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN NULL ELSE 'gif' END"
_ENDINGS = "CASE page_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE NULL END"


def _named_heads(spark, sf_dir) -> DataFrame:
    """Pages as files: names with endings of three kinds, heads of four."""
    p = read(spark, sf_dir, "pages")
    head = F.when(F.col("page_id") % 4 == 0, "%PDF").when(F.col("page_id") % 4 == 1, "PK\x03\x04").when(F.col("page_id") % 4 == 2, "<htm").otherwise("GIF8")
    ending = F.when(F.col("page_id") % 3 == 0, ".CSV").when(F.col("page_id") % 3 == 1, ".json").otherwise(".none")
    return p.select("page_id", F.concat(F.lit("f"), "page_id", ending).alias("name"), F.concat(F.encode(head, "utf-8"), F.encode("html", "utf-8")).alias("content"))


@query(f"SELECT page_id, concat_ws(',', {_HEADS}, {_ENDINGS}) AS formats FROM pages")
def formats_of_files(spark, sf_dir):
    path = folder(spark)
    heads.write_files(_named_heads(spark, sf_dir), path)
    return files.formats_in(spark, path).select(F.regexp_extract("path", r"/f(\d+)\.\w+$", 1).cast("long").alias("page_id"), F.array_join("formats", ",").alias("formats"))


@query("SELECT page_id, concat_ws(',', CASE WHEN page_id % 3 = 0 THEN 'bars' END, CASE WHEN page_id % 3 = 0 OR page_id % 4 = 3 THEN 'mixed' END, CASE WHEN page_id % 4 = 0 THEN 'paper' END) AS consumers FROM pages")
def routes_of_files(spark, sf_dir):
    consumers = {"bars": [".csv"], "mixed": [".GIF", ".csv"], "paper": [".pdf"]}
    return _named_heads(spark, sf_dir).select("page_id", F.array_join(files.consumers_of(F.col("name"), F.substring("content", 1, 32), consumers), ",").alias("consumers"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'mnist' WHEN p_partkey % 5 = 1 THEN 'nonlinear-nn' WHEN p_partkey % 5 = 2 THEN 'linear'
 WHEN p_size % 3 = 1 THEN 'linear' WHEN p_size % 3 = 2 THEN 'logistic' END AS kind FROM part""")
def kinds_of_models_by_column(spark, sf_dir):
    """Names speak for a kind, else the number of columns: two, three or four here."""
    p = read(spark, sf_dir, "part")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("MNIST_", "a_nonlinear", "Linear", "other", "data"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(".csv"))
    line = F.array_join(F.array_repeat(F.lit("1"), (F.col("p_size") - F.floor((F.col("p_size") - 1) / 3) * 3).cast("int") + 1), ", ")
    sized = F.when(F.col("p_size") % 3 == 0, "1 2 3 4").otherwise(line)
    return p.select("p_partkey", files.model_kinds(name, sized).alias("kind"))


# text at hand, in a column


@query("SELECT c_custkey::DOUBLE AS key, c_acctbal AS balance FROM customer UNION ALL SELECT c_custkey::DOUBLE, c_nationkey::DOUBLE FROM customer")
def read_csv_texts(spark, sf_dir):
    """A text of several lines in each row, all one table."""
    c = read(spark, sf_dir, "customer")
    text = F.concat_ws("\n", F.when(F.col("c_custkey") == 0, F.lit("key balance")), F.concat_ws(",", "c_custkey", "c_acctbal"), F.lit("not a row"), F.concat_ws(" ", "c_custkey", "c_nationkey"))
    return files.delimited_table(files.lines_of_texts(c.select("c_custkey", text.alias("text")), "text", "c_custkey")).to_df()


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line, p_partkey::DOUBLE AS size, p_retailprice AS price FROM part WHERE p_size > 5")
def read_learning_rows(spark, sf_dir):
    """Rows for learning: units after numbers don't count, rows of other widths or with words go."""
    p = read(spark, sf_dir, "part")
    line = F.when(F.col("p_size") > 5, F.concat("p_partkey", F.lit("mm, "), "p_retailprice", F.lit("EUR"))).when(F.col("p_size") > 2, F.lit("1 two")).otherwise(F.lit("1 2 3"))
    lines = p.select(F.col("p_partkey").cast("long").alias(ROW), line.alias("line")).union(spark.createDataFrame([(-1, "size price")], f"{ROW} long, line string"))
    found, names = files.learning_rows(lines)
    order = rows.ranked(found, ROW, rank="_k")
    return order.select((F.col("_k") - 1).alias("line"), *names)


# sinks


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS line, o_orderkey || ' ' || o_custkey AS text FROM orders UNION ALL SELECT 0, 'key customer'")
def written_lines(spark, sf_dir):
    """Orders by price as one text in part files, below a header, read back in its order."""
    path = folder(spark)
    o = read(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey", F.concat_ws(" ", "o_orderkey", "o_custkey").alias("line"))
    sinks.write_lines(o, path, ["o_totalprice", "o_orderkey"], header="key customer")
    return sinks.read_lines(spark, path).select(F.col(ROW).alias("line"), F.col("value").alias("text"))


def _order_table(spark, sf_dir) -> Table:
    o = read(spark, sf_dir, "orders")
    return Table(o.select(F.col("o_custkey").cast("double").alias("k"), (F.col("o_custkey") % 7).cast("double").alias("r"), F.col("o_orderkey").cast("long").alias(ROW)))


_LINES = "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, o_custkey::BIGINT AS k, (o_custkey % 7)::BIGINT AS r FROM orders) SELECT 'scatter' AS kind, line, k || ' ' || r AS text FROM o UNION ALL SELECT 'line', line, k || ',' || r FROM o UNION ALL SELECT 'histogram', line, r::VARCHAR FROM o UNION ALL SELECT 'pointcloud', line, k || ' ' || r FROM o"


def _written(spark, views: list) -> DataFrame:
    out = None
    for kind, view in views:
        path = folder(spark)
        sinks.write_view(view, path)
        own = sinks.read_lines(spark, path).select(F.lit(kind).alias("kind"), F.col(ROW).alias("line"), F.col("value").alias("text"))
        out = own if out is None else out.unionByName(own)
    return out


@query(_LINES)
def written_views_of_blocks(spark, sf_dir):
    """The texts that view blocks hand to their charts, as files."""
    known, t = blocks.standard(spark), _order_table(spark, sf_dir)
    chosen = (("scatter", "scatter", {"x": "k", "y": "r", "color": ""}), ("line", "line", {"x": "k", "y": "r"}), ("histogram", "histogram", {"column": "r"}), ("point_cloud_2d", "pointcloud", {"x": "k", "y": "r"}))
    return _written(spark, [(kind, known.blocks[f"viz.{name}"].apply({"table": t}, params)["view"]) for name, kind, params in chosen])


@query(_LINES)
def written_views_of_plot(spark, sf_dir):
    s, t = Studio(spark), _order_table(spark, sf_dir)
    chosen = (("scatter", {"x": "k", "y": "r"}), ("line", {"x": "k", "y": "r"}), ("histogram", {"column": "r"}), ("pointcloud", {}))
    return _written(spark, [(kind, s.plot(kind, t, **columns)) for kind, columns in chosen])


@query("SELECT printf('%d', o_orderkey) AS key, rtrim(rtrim(printf('%.4f', o_totalprice / 7), '0'), '.') AS seventh, o_orderstatus AS status FROM orders ORDER BY o_orderkey LIMIT 12")
def previewed_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") / 7).alias("seventh"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("long").alias(ROW))
    return Table(o).previewed(12).drop(ROW)


@query("SELECT p_partkey FROM part WHERE p_size > 30")
def parameter_filter(spark, sf_dir):
    """A parameter that is set once and asked for where it is needed; one that isn't set has a default."""
    s = Studio(spark)
    s.set_param("least", 30)
    t = Table(read(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return s.filter(s.filter(t, "p_size", ">", s.get_param("least")), "p_size", ">", s.get_param("other", 0)).to_df().select("p_partkey")


# colours and numbers


@query("""WITH c AS (SELECT c_custkey, (c_custkey % 360)::DOUBLE AS h, (c_nationkey / 24.0)::DOUBLE AS s, (c_custkey % 11 / 10.0)::DOUBLE AS l FROM customer),
 m AS (SELECT *, (1 - abs(2 * l - 1)) * s AS c FROM c), x AS (SELECT *, c * (1 - abs(((h / 60) % 2) - 1)) AS x, l - c / 2 AS m FROM m)
SELECT c_custkey, round((CASE WHEN h < 60 OR h >= 300 THEN c WHEN h < 120 OR h >= 240 THEN x ELSE 0 END + m) * 255, 6) + 0.0 AS red,
 round((CASE WHEN h < 60 OR h >= 180 AND h < 240 THEN x WHEN h < 180 THEN c ELSE 0 END + m) * 255, 6) + 0.0 AS green, round((CASE WHEN h < 120 THEN 0 WHEN h < 180 OR h >= 300 THEN x ELSE c END + m) * 255, 6) + 0.0 AS blue FROM x""")
def hues(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    channels = colors.hsl_channels((F.col("c_custkey") % 360).cast("double"), F.col("c_nationkey") / 24, F.col("c_custkey") % 11 / 10)
    return rounded(c.select("c_custkey", *((F.greatest(x, F.lit(0.0))).alias(n) for x, n in zip(channels, ("red", "green", "blue")))))


@query("""WITH c AS (SELECT c_custkey, c_custkey * 7919 % 16777216 AS v, c_custkey % 101 AS a FROM customer), t AS (SELECT *, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b FROM c)
SELECT c_custkey, r::INT AS red, g::INT AS green, b::INT AS blue, printf('#%02x%02x%02x', r, g, b) AS again,
 printf('#%02x%02x%02x', floor(r + (255 - r) * (a / 100.0::DOUBLE) + 0.5)::BIGINT, floor(g + (255 - g) * (a / 100.0::DOUBLE) + 0.5)::BIGINT, floor(b + (255 - b) * (a / 100.0::DOUBLE) + 0.5)::BIGINT) AS tint, gcd(c_custkey * 36, 1 + c_custkey % 97 * 24) AS divisor FROM t""")
def hex_colors(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("#"), F.lpad(F.hex(F.col("c_custkey") * 7919 % 16777216), 6, "0")).alias("h"))
    channels = colors.hex_channels(F.concat(F.lit(" "), "h"))
    tint = F.lower(colors.tinted(F.col("h"), F.col("c_custkey") % 101))
    return c.select("c_custkey", *(x.alias(n) for x, n in zip(channels, ("red", "green", "blue"))), colors.hex_text(channels).alias("again"), tint.alias("tint"), colors.greatest_divisor(F.col("c_custkey") * 36, 1 + F.col("c_custkey") % 97 * 24).alias("divisor"))


# learning


@query("SELECT p_partkey FROM part")
def gradient_lines(spark, sf_dir):
    """Parts whose value a line that was learnt by steps predicts to a hundredth of the span."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") * 3.0 + 7).alias("y"))
    model = learn.gradient_fit(p, ["p_size"], "y", "p_partkey", epochs=60)
    return p.where(F.abs(model.score() - F.col("y")) < 1.5).select("p_partkey")


@query("SELECT epoch, 'falls' AS loss FROM range(1, 31) r(epoch)")
def logistic_history(spark, sf_dir):
    """The record of each epoch of a logistic fit; its loss falls with every step. Training stops when it is told to."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") > 25).cast("double").alias("label"))
    history = learn.gradient_fit(p, ["p_size"], "label", "p_partkey", kind="logistic", stop=lambda r: r["epoch"] == 30).history
    falls = ["falls", *("falls" if b["loss"] < a["loss"] else "rises" for a, b in zip(history, history[1:]))]
    return spark.createDataFrame([(r["epoch"], f) for r, f in zip(history, falls)], "epoch long, loss string")


@query("SELECT p_partkey, round(7.0::DOUBLE + 3.0::DOUBLE * p_size, 2) AS score FROM part")
def exported_weights(spark, sf_dir):
    """A model's exported weights, applied as a column, are the model."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") * 3.0 + 7).alias("y"))
    model = learn.gradient_fit(p, ["p_size"], "y", "p_partkey", epochs=100)
    kernel, bias = (w["data"][0] for w in json.loads(model.to_json())["weights"])
    z = (F.col("p_size") - float(model.means[0])) / float(model.deviations[0])
    return p.select("p_partkey", half_away(z * kernel + bias, 2).alias("score"))


# deep trees


@query("SELECT o_orderkey AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS depth, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS below, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS total FROM orders")
def chains_of_orders(spark, sf_dir):
    """Each customer's orders as a chain, the next below the one before: depths, and the sizes of what hangs below."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"), F.col("o_totalprice").alias("size"))
    placed = trees.depths(o)
    found = trees.folded(placed, {"total": (F.col("size"), F.lit(0.0)), "below": (None, F.lit(1))})
    return placed.join(found, "label").select("label", F.col("depth").cast("long").alias("depth"), F.col("below").cast("long").alias("below"), "total")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 41 = 0")
def stride_in_file_order(spark, sf_dir):
    return rows.every_nth(read(spark, sf_dir, "events").select("event_id"), None, 41)


# plugins


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(avg((value - m) ** 3) / stddev_pop(value) ** 3, 6) AS skewness FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def plugin_moments(spark, sf_dir):
    """A plugin that says its own schema and partitioning, called for a DataFrame."""
    return rounded(plugins.applied(read(spark, sf_dir, "events").select("event_type", "value"), plugins.Moments, column="value", by="event_type"))


@query("WITH e AS (SELECT event_type, value > 60 AS above, lag(value > 60) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) SELECT event_type, count(*) FILTER (above AND NOT before) AS rises, count(*) FILTER (NOT above AND before) AS falls FROM e GROUP BY 1")
def plugin_crossings(spark, sf_dir):
    """A plugin that takes rows in an order of its own, called from SQL."""
    plugins.register(spark, plugins.Crossings)
    view = f"events_{uuid.uuid4().hex}"
    read(spark, sf_dir, "events").createOrReplaceTempView(view)
    out = spark.sql(f"SELECT * FROM crossings(TABLE({view}), column => 'value', by => 'event_type', along => 'event_id', level => 60.0)")
    spark.catalog.dropTempView(view)
    return out
