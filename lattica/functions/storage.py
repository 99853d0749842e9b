"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}  # of applications whose setting is unset
_PATHS: weakref.WeakKeyDictionary[DataFrame, tuple[str, ...]] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a local folder, as in tests; a cluster has to
    set it, since a machine-local folder would lose rows there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _FOLDERS:
            _FOLDERS[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        folder = _FOLDERS[context.applicationId]
    return folder.rstrip("/")


def written(df: DataFrame, by: str | None = None, **options: str) -> DataFrame:
    """A step, written to the shared folder and read back: lineage ends there, and no executor's loss undoes it.

    by: a column whose values get folders of their own. options: of the Parquet writer. The files stay until `erased`."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    writer = df.write.options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = (path,)
    return out


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """`written`, and aggregates over its rows, read from the files. (Observed metrics would take them along with the writing, but a
    session that has observed anything can't run models of Spark's ML any more: it doesn't serialize.)"""
    out = written(df)
    row = out.agg(*(c.alias(n) for n, c in counts.items())).first()
    return out, {n: row[n] or 0 for n in counts}


def erased(*tables: DataFrame, part: str = "") -> None:
    """Deletes the files of tables that `written` returned and that nothing reads any more, or those of a part (`column=value`) of
    one that was written by a column. Other tables, and those that are derived from written ones, are left alone."""
    for df in tables:
        for own in (_PATHS.get(df) if part else _PATHS.pop(df, None)) or ():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{own}/{part}" if part else own)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def passed_on(view: DataFrame, *tables: DataFrame) -> DataFrame:
    """The view of written tables, which owns their files from now on."""
    _PATHS[view] = tuple(path for t in tables for path in _PATHS.pop(t, ()))
    return view
