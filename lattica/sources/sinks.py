"""Ordered text of any size: part files whose lines, file by file in the order of their names, are the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..table import ROW, View


def write_lines(lines: DataFrame, path: str, order: list[Column | str], line: str = "line", header: str | None = None) -> None:
    """Writes the column `line` in the given order, after a header line if there is one. Ranges of the order go to tasks, which write
    them sorted, and the files' numbers follow the ranges; the text stands when the job commits and leaves its success file, so a
    task that is lost and runs again changes nothing. A line that has line breaks is several lines for readers."""
    rows = lines.select(F.lit(1).alias("_first"), *((F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)), F.col(line).alias("value"))
    if header is not None:
        kinds = {f.name: f.dataType for f in rows.schema}
        top = lines.sparkSession.range(1).select(F.lit(0).alias("_first"), *(F.lit(None).cast(kinds[f"_o{k}"]).alias(f"_o{k}") for k in range(len(order))), F.lit(header).alias("value"))
        rows = top.unionByName(rows)
    keys = ["_first", *(f"_o{k}" for k in range(len(order)))]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.text(path)


def write_view(view: View, path: str) -> None:
    """The text of a view, in its table's order."""
    write_lines(view.lines(), path, [ROW])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """ROW (from 0, without gaps) and value: the lines of a file or of the files of a folder by their names. Two scans: the first
    counts lines by range of a file, a row for each range, which gives the ranges their first numbers."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    ranges = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")).orderBy("_file", "_block").collect()
    before, firsts = 0, []
    for r in ranges:
        firsts.append((r[0], r[1], before - r[2]))
        before += r[3]
    offsets = spark.createDataFrame(firsts, "_file string, _block long, _shift long")
    return lines.join(F.broadcast(offsets), ["_file", "_block"]).select((F.col("_id") + F.col("_shift")).alias(ROW), "value")
