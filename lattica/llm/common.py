"""Helpers that the corpus operators share: tables, durable steps, chunks of text and rolling hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import erased, written

#: Text handled at once in a task, in bytes or so.
CHUNK_BYTES = 4 << 20

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, by: str | None = None, row_group: int | None = None) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends there and no executor's loss undoes it. Shuffle
    files that led to them, which nothing refers to any more, go at once instead of whenever the driver collects garbage.
    by: a column whose values get folders of their own, so that reading one value reads no other's files. row_group: bytes in a row
    group, of which writers and readers hold one; for rows of large values, so that sizes are looked at from the second row on and
    not from the hundredth."""
    out = written(df, by, compression="zstd", **({"parquet.block.size": str(row_group), "parquet.page.size.row.check.min": "2", "parquet.block.size.row.check.min": "2"} if row_group else {}))
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


#: Deletes the files of durable tables that nothing reads any more, or a part's of one that was written in parts.
dropped = erased


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: at most so many of them go to Python at once, in this session from now on. And tables written by a column of
    a few values are written side by side, where a sort by that column would hold and spill their rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", CHUNK_BYTES)
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", 8)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, or longer ones where docs has columns of these names already (names differ in more than their capitals)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_CACHES: dict = {}


def worker_cache(owner: str, make: Callable):
    """A cache that lasts from task to task of a worker process. A worker serves many operators one after the other, so it holds
    only the cache that was asked for last."""
    if owner not in _CACHES:
        _CACHES.clear()
        _POWERS.clear()
        _CACHES[owner] = make()
    return _CACHES[owner]


def tidied(run: Callable) -> Callable:
    """A function on batches that gives free memory back to the system when its task ends: a worker process outlives the task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a fingerprint of the text, which tells rows of one doc_id apart. Other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("fp"))


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about `limit` bytes of text each, and their texts (None: null)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(at, stop - at)
            yield part, part.column(text).to_pylist()
            at = stop


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


class WordHash(dict):
    """64-bit hashes of words; what it keeps is bounded."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def hashed(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: well spread values, one to one."""
    x = x ^ np.uint64(salt) if salt else x.copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from sums of powers."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        up, self.down = powers(len(values) + 1, base)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def merged(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint [start, end) intervals that cover the same places; touching ones become one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s = np.asarray(starts, np.int64)[order]
    e = np.maximum.accumulate(s + np.asarray(lengths, np.int64)[order])
    first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(s) - 1]])
    return list(zip(s[first].tolist(), e[last].tolist()))

