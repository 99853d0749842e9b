"""Counts of words over all documents, and per-document sums of what a table says about words.

Looking every word of every document up in a table that grows with the corpus goes two ways, both exact. The commonest words,
a bounded number, go to every task, which sums them up in place; nearly all words of running text are among them. For the rest
a task puts out a row for each word and document, which meets the table in a join. Rare words have few rows, so no key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, tidied

HELD = 300_000  # distinct words that a task gathers before it hands counts out


def count_words(docs: DataFrame, words_of: Callable[[str | None], list[bytes]]) -> DataFrame:
    """word (binary) and n, how often it occurs in all texts of docs; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for _, texts in text_chunks(batches):
            for text in texts:
                held.update(words_of(text))
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(tidied(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def key_of(word: bytes) -> tuple[int, int]:
    """128 bits of a hash as two signed numbers; words themselves can be long."""
    raw = xxhash.xxh3_128_digest(word)
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def with_keys(words: DataFrame) -> DataFrame:
    """Adds k1 and k2 to a table with a column word."""
    schema = words.select("word", *(c for c in words.columns if c != "word")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(w.as_py()) for w in batch.column("word")]
            arrays = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "k1", "k2"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return words.select(*schema.names).mapInArrow(tidied(run), f"{fields}, k1 long, k2 long")


def head_of(words: DataFrame, order: list, most: int) -> pa.Table:
    """The first `most` rows of a table of words: bounded, so the driver may take them and hand them to all tasks."""
    return words.orderBy(*order).limit(most).toArrow()


def rows_outside(docs: DataFrame, words_of: Callable[[str | None], list[bytes]], head) -> DataFrame:
    """A row (doc_id, fp, k1, k2, n) for each row of docs and each distinct word of it that is not in `head`, a broadcast
    container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch, texts in text_chunks(batches):
            rows, keys, n = [], [], []
            for row, text in enumerate(texts):
                rare = Counter(filterfalse(known.__contains__, words_of(text)))
                rows.append(np.full(len(rare), row))
                keys += map(xxhash.xxh3_128_digest, rare)
                n += rare.values()
            if n:
                take = pa.array(np.concatenate(rows))
                both = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("fp").take(take), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n, pa.int64())], ["doc_id", "fp", "k1", "k2", "n"])

    return docs.select("doc_id", "fp", "text").mapInArrow(tidied(run), "doc_id long, fp long, k1 long, k2 long, n long")


def add_sums(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Left-joins sums over all rows of a (doc_id, fp), shared out evenly among the rows that have them: equal rows have equal
    texts, and so equal shares."""
    every = rows.groupBy("doc_id", "fp").agg(F.count("*").alias("_rows"))
    names = [c for c in sums.columns if c not in ("doc_id", "fp")]
    same = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("fp").eqNullSafe(F.col("_f"))]
    sums = sums.withColumnsRenamed({"doc_id": "_d", "fp": "_f"})
    shares = every.join(sums, same, "inner").select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), *((F.col(c) / F.col("_rows")).alias(c) for c in names))
    return rows.join(shares, same, "left").drop("_d", "_f").fillna(0.0, names)
