"""Ranks and scalars without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def with_scalars(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Every row with one row of aggregates over all rows; that row is what is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def ranked(df: DataFrame, value: str, ties: list[Column | str] | None = None, within: list[str] | None = None, rank: str = "rn", descending: bool = False, weight: str | None = None) -> DataFrame:
    """Adds `rank`, from 1, in the order of value, then ties (ascending); of all rows or `within` groups. With `weight` it adds the
    sum of the weights of the rows up to this one instead.

    Rows are dealt by ranges of groups, value and ties together, into as many parts as shuffles have, sorted there and written with
    their places; the parts' sizes, a row each, give the places their offsets. So neither the whole table nor a large group, nor
    a value that very many rows have, meets in one task, as long as ties tell rows apart.
    """
    within = list(within or [])
    order = [*within, F.desc(value) if descending else F.asc(value), *(ties or [])]
    own = F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": own}))
    size = F.sum(weight) if weight else F.count("*")
    before = Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sizes = rows.groupBy("__part").agg(size.alias("__size")).select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    inside = F.sum(weight).over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)) if weight else F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = rows.withColumn("__inside", inside).join(F.broadcast(sizes), "__part")
    rows = rows.withColumn(rank, F.col("__before") + F.col("__inside")).drop("__part", "__place", "__before", "__inside")
    if not within:
        return rows
    firsts = rows.groupBy(*within).agg(F.min(F.col(rank) - (F.col(weight) if weight else 1)).alias("__first"))
    return rows.join(firsts, within).withColumn(rank, F.col(rank) - F.col("__first")).drop("__first")


def sums_before(df: DataFrame, order: list[Column | str], weight: Column | str, within: list[str], out: str) -> DataFrame:
    """Adds `out`: the sum of the weights of the rows before each, in the given order, of its group.

    Rows are dealt by ranges of groups and order together, sorted there and written, so a group of any size is spread out. Sums run
    within a part's groups; only a group that began in an earlier part adds what it has there, which is a row for each part at
    most. So a group in one part is summed in its order alone, and no other group's values round its sums.
    """
    keys = [*within, *order]
    weight = F.col(weight) if isinstance(weight, str) else weight
    rows = written(df.withColumn("__w", weight).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}))
    own = Window.partitionBy("__part", *within).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part", *within).agg(F.sum("__w").alias("__total"))
    begun = totals.withColumn("__before", F.sum("__total").over(earlier)).where("__before is not null").drop("__total")
    begun = begun.withColumnsRenamed({"__part": "__p", **{c: f"__g{k}" for k, c in enumerate(within)}})
    same = F.col("__part") == F.col("__p")
    for k, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{k}"))
    rows = rows.withColumn("__own", F.sum("__w").over(own)).join(F.broadcast(begun), same, "left")
    zero = F.lit(0).cast(dict(rows.dtypes)["__w"])
    return rows.withColumn(out, F.coalesce("__before", zero) + F.coalesce("__own", zero)).drop("__w", "__part", "__place", "__own", "__before", "__p", *(f"__g{k}" for k in range(len(within))))


def in_file_order(df: DataFrame, rank: str = "rn") -> DataFrame:
    """Adds `rank`, from 1, to the rows of a scan of Parquet files: by file name, then by place in the file. Scans know a row's place
    in its file, so nothing is shuffled or sorted; how many rows the files before it have comes from a count by file."""
    named = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = named.groupBy("__file").count().orderBy("__file").collect()  # a row for each file
    before, offsets = 0, []
    for r in counts:
        offsets.append((r[0], before))
        before += r[1]
    files = df.sparkSession.createDataFrame(offsets, "__file string, __before long")
    return named.join(F.broadcast(files), "__file").withColumn(rank, F.col("__before") + F.col("__at") + 1).drop("__file", "__at", "__before")
