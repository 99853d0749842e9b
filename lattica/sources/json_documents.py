"""JSON documents of any size as tables: each is read in byte ranges, in parallel, also where it is a single line.

Spark's text source splits a file at commas, so a range's rows are fragments between commas wherever the range begins. What a
comma means depends on all that comes before it: whether a string is open, and how deep the brackets are. Each range tells how it
changes both, for either way to begin; running sums over the ranges, a row for each, then tell how each really begins. With that,
a second scan cuts the document at the commas of depth 1, which are those between records. Records that lie across ranges are put
together from their pieces. So no task holds more than a range's pieces, and none the document.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import erased, written
from ..table import ROW, Table, TableError

STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
ROWS = 20_000  # rows that a task hands out at once
BATCH = 8 << 20  # or characters


def scanned(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after a fragment, and how much deeper the brackets are, if one is open before it or not."""
    if inside:
        text = '"' + text
    if '"' in text:
        text, quote, _ = STRING.sub("", text).partition('"')
        inside = bool(quote)
    return inside, text.count("[") + text.count("{") - text.count("]") - text.count("}")


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the range begins) and value, in the order of the text within a block."""
    return spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def range_states(parts: DataFrame) -> DataFrame:
    """A row for each range: file, block, inside (whether it begins in a string), depth (of brackets where it begins), and broken (the
    file ends here, but a string or bracket is open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None  # of the two ways to begin: (inside, depth)
        rows: list[tuple] = []
        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    if at:
                        rows.append((*at, *state[0], *state[1]))
                    at, state = (file, block), [(False, 0), (True, 0)]
                for k, (inside, depth) in enumerate(state):
                    inside, more = scanned(value, inside)
                    state[k] = inside, depth + more
        if at:
            rows.append((*at, *state[0], *state[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "block", "end_out", "deeper_out", "end_in", "deeper_in"])

    ranges = parts.mapInArrow(run, "file string, block long, end_out boolean, deeper_out long, end_in boolean, deeper_in long")
    # a range either ends alike however it begins, or keeps its beginning, or turns it over: what it ends in is what the last of the
    # first kind ended in, turned over as often as ranges since then do
    order = Window.partitionBy("file").orderBy("block")
    ranges = ranges.withColumn("_run", F.count_if(F.col("end_out") == F.col("end_in")).over(order))
    fixed = F.max(F.when(F.col("end_out") == F.col("end_in"), F.col("end_out").cast("int"))).over(Window.partitionBy("file", "_run"))
    turns = F.count_if(F.col("end_out") & ~F.col("end_in")).over(Window.partitionBy("file", "_run").orderBy("block"))
    ranges = ranges.withColumn("_ends", (F.coalesce(fixed, F.lit(0)) + turns) % 2 == 1)
    ranges = ranges.withColumn("inside", F.coalesce(F.lag("_ends").over(order), F.lit(False)))
    deeper = F.when(F.col("inside"), F.col("deeper_in")).otherwise(F.col("deeper_out"))
    ranges = ranges.withColumn("_deeper", deeper).withColumn("_depth", F.sum("_deeper").over(order))
    broken = F.lead("block").over(order).isNull() & (F.col("_ends") | (F.col("_depth") != 0))
    return ranges.select("file", "block", "inside", (F.col("_depth") - F.col("_deeper")).alias("depth"), broken.alias("broken"))


def pieces(parts: DataFrame, states: DataFrame) -> DataFrame:
    """What lies between commas of depth 1: file, block, seq (from 0 in a block), text, and cut, false for the last of a block where
    no such comma ends it. The first of a block may be the rest of the block's before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, depth, seq = None, False, 0, 0
        held: list[str] = []
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["file", "block", "seq", "text", "cut"])
            rows.clear()
            return batch

        for batch in batches:
            for file, block, value, in_string, deep in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", "inside", "depth"))):
                if (file, block) != at:
                    if held:
                        rows.append((*at, seq, ",".join(held), False))
                        held = []
                    at, inside, depth, seq = (file, block), in_string, deep, 0
                inside, more = scanned(value, inside)
                depth += more
                held.append(value)
                size += len(value)
                if not inside and depth == 1:
                    rows.append((*at, seq, ",".join(held), True))
                    held, seq = [], seq + 1
                    if len(rows) >= ROWS or size >= BATCH:
                        yield out()
                        size = 0
        if held:
            rows.append((*at, seq, ",".join(held), False))
        if rows:
            yield out()

    return parts.join(F.broadcast(states), ["file", "block"]).mapInArrow(run, "file string, block long, seq long, text string, cut boolean")


def records(spark: SparkSession, path: str) -> DataFrame:
    """ROW and the text of each element of the array that a document at `path` is; of several documents, file by file in order of
    their names. Brackets of the array are left in the first and the last element's text of a file: see `element`. Written to the
    shared folder; the caller erases it."""
    parts = fragments(spark, path)
    states = written(range_states(parts))
    ranges, broken = states.agg(F.count("*"), F.count_if("broken")).first()
    if not ranges or broken:
        raise TableError("invalid JSON: a string or bracket is left open" if broken else "JSON is empty")
    found = written(pieces(parts, states.drop("broken")))
    # numbers of elements: how many commas of depth 1, and how many files, come before a block
    blocks = found.groupBy("file", "block").agg(F.count_if("cut").alias("cuts"))
    inside_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg((F.sum("cuts") + 1).alias("size"))
    in_order = Window.partitionBy(F.lit(1)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("file", F.coalesce(F.sum("size").over(in_order), F.lit(0)).alias("_files"), (F.col("size") - 1).alias("last"))
    blocks = blocks.withColumn("_cuts", F.coalesce(F.sum("cuts").over(inside_file), F.lit(0))).drop("cuts").join(files, "file")
    own = found.join(F.broadcast(blocks), ["file", "block"]).select((F.col("_cuts") + F.col("seq")).alias("number"), "_files", "last", "block", "text", "cut", "seq", "file")
    whole = own.where("seq > 0 and cut").select("number", "_files", "last", "text")
    open_ = own.where("seq = 0 or not cut").groupBy("file", "number", "_files", "last").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))).alias("_p"))
    joined = open_.select("number", "_files", "last", F.array_join(F.transform("_p", lambda p: p.text), ",").alias("text"))
    out = whole.unionByName(joined).select((F.col("_files") + F.col("number")).alias(ROW), (F.col("number") == 0).alias("first"), (F.col("number") == F.col("last")).alias("last"), "text")
    kept = written(out)
    erased(states, found)
    return kept


def element(text: str, first: bool, last: bool) -> dict | None:
    """The record of an element's text; None for the element of an empty array."""
    if first:
        text = text.lstrip("﻿ \t\r\n")
        if text[:1] != "[":
            raise ValueError("JSON is neither records nor columns")
        text = text[1:]
    if last:
        text = text.rstrip(" \t\r\n")
        if text[-1:] != "]":
            raise ValueError("invalid JSON: the array does not end")
        text = text[:-1]
    if first and last and not text.strip():
        return None
    record = json.loads(text, parse_constant=_not_json)
    if not isinstance(record, dict):
        raise ValueError("JSON is neither records nor columns")
    return record


def _not_json(word: str):
    raise ValueError(f"invalid JSON: {word}")


def numeric(value: object) -> bool:
    """A number that is finite as a double."""
    try:
        return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(float(value))
    except OverflowError:
        return False


def text_of(value: object) -> str:
    """A value in a text column: '' for what is missing, whole numbers without a point, lists joined by commas."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return ",".join(map(text_of, value))
    if isinstance(value, dict):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    try:
        v = float(value)
    except OverflowError:
        return "Infinity" if value > 0 else "-Infinity"
    if v == int(v) and abs(v) < 1e21 if math.isfinite(v) else False:
        return str(int(v))
    return re.sub(r"e([+-])0*(\d)", r"e\1\2", repr(v)) if math.isfinite(v) else "Infinity" if v > 0 else "-Infinity"


def columns_of(rows: DataFrame) -> list[tuple[str, bool]]:
    """Names of all records' keys, by first appearance, and whether each record has a finite number there. Counted in tasks; the
    driver gets a row for each name, as the table's schema has them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        total = 0
        for batch in batches:
            for place, text, first, last in zip(*(batch.column(c).to_pylist() for c in (ROW, "text", "first", "last"))):
                record = element(text, first, last)
                if record is None:
                    continue
                total += 1
                for k, (name, value) in enumerate(record.items()):
                    own = seen.get(name)
                    if own is None:
                        own = seen[name] = [place, k, 0]
                    elif place < own[0]:
                        own[:2] = place, k
                    own[2] += numeric(value)
        if total:
            rows = [("r", None, 0, 0, total), *(("c", name, *own) for name, own in seen.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), *[pa.int64()] * 3))], ["kind", "name", "place", "at", "n"])

    parts = rows.mapInArrow(run, "kind string, name string, place long, at long, n long")
    found = parts.groupBy("kind", "name").agg(F.min(F.struct("place", "at")).alias("first"), F.sum("n").alias("n")).orderBy("first").collect()
    total = sum(r.n for r in found if r.kind == "r")
    if not total:
        raise TableError("JSON is empty")
    return [(r.name, r.n == total) for r in found if r.kind == "c"]


def record_table(spark: SparkSession, path: str, name: str = "") -> Table:
    """The records of one JSON array, or of one in each file of a folder, as rows in the document's order. A column is numeric
    if each record has a finite number there, else text (see `text_of`). A name that a record has twice counts once, with its last
    value, as JSON readers have it. Errors: an empty document or array, other elements than records, text that isn't JSON."""
    rows = records(spark, path)
    named = columns_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(place, element(*rest)) for place, *rest in zip(*(batch.column(c).to_pylist() for c in (ROW, "text", "first", "last")))]
            found = [(place, r) for place, r in found if r is not None]
            columns = [pa.array([float(r[n]) for _, r in found], pa.float64()) if is_number else pa.array([text_of(r.get(n)) for _, r in found], pa.string()) for n, is_number in named]
            yield pa.RecordBatch.from_arrays([pa.array([place for place, _ in found], pa.int64()), *columns], [ROW, *(f"c{k}" for k in range(len(named)))])

    schema = ", ".join([f"{ROW} long", *(f"c{k} {'double' if is_number else 'string'}" for k, (_, is_number) in enumerate(named))])
    df = rows.mapInArrow(run, schema).toDF(ROW, *(n for n, _ in named))
    return Table(df, name, (), f"load:{name}")


def column_table(spark: SparkSession, path: str, name: str = "") -> Table:
    """{columns: [{name, data}]}, a document that a task can hold, since a row's values lie far apart in it: one task takes it apart
    into cells, and rows are made of these by their place. Shorter columns are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                columns = json.loads(text.lstrip("﻿"), parse_constant=_not_json).get("columns")
                if not isinstance(columns, list) or not columns:
                    raise ValueError("JSON is neither records nor columns")
                for k, c in enumerate(columns):
                    data = c.get("data") if isinstance(c.get("data"), list) else []
                    own = all(map(numeric, data))
                    for start in range(0, max(1, len(data)), ROWS):
                        part = data[start : start + ROWS]
                        n = max(1, len(part))  # a column without data is one row without a place
                        places = range(start, start + len(part)) if part else [None]
                        yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array([text_of(c.get("name"))] * n), pa.array([own] * n), pa.array(places, pa.int64()), pa.array([float(v) if own else None for v in part] or [None], pa.float64()), pa.array(["" if own else text_of(v) for v in part] or [None], pa.string())], ["k", "name", "own", "place", "v", "t"])

    cells = written(spark.read.text(path, wholetext=True).mapInArrow(run, "k long, name string, own boolean, place long, v double, t string"))
    named = cells.groupBy("k", "name", "own").agg(F.count("place").alias("n")).orderBy("k").collect()
    if len({r.n for r in named}) > 1:
        raise TableError("JSON has columns of unequal length")
    if not named or not named[0].n:
        raise TableError("JSON is empty")
    rows = cells.groupBy(F.col("place").alias(ROW)).agg(*(F.max(F.when(F.col("k") == r.k, F.col("v") if r.own else F.col("t"))).alias(f"c{r.k}") for r in named))
    return Table(rows.toDF(ROW, *(r.name for r in named)), name, (), f"load:{name}")


def json_file(spark: SparkSession, path: str, name: str = "") -> Table:
    """Records or columns, by the first sign of the document."""
    first = fragments(spark, path).where("block = 0").select(F.substring(F.ltrim(F.regexp_replace("value", "^[﻿\\s]+", "")), 1, 1)).first()
    if first is None:
        raise TableError("JSON is empty")
    return column_table(spark, path, name) if first[0] == "{" else record_table(spark, path, name)


def write_documents(df: DataFrame, path: str) -> None:
    """Writes rows as JSON records, a document in each file: what `record_table` reads back. A file has the rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = "["
        for batch in batches:
            if batch.num_rows:
                signs = [sign, *[","] * (batch.num_rows - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([s + t for s, t in zip(signs, batch.column(0).to_pylist())])], ["value"])
                sign = ","
        if sign == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string").write.text(path)
