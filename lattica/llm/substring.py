"""Substring dedup over windows of words, behind a count-min sketch.

First pass: every task counts the anchors of its windows in sketch counters, and the counters of all tasks are merged. A window's
anchor occurs at least as often as the window, so the merged sketch overestimates every window's count, and a window estimated to
occur once does occur once. Second pass: only windows estimated repeated are grouped, exactly (see repeats.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch as sketches
from .common import Rolling, WordHash, dropped, durable, hashed, keyed, small_batches, table, text_chunks, tidied, utf8, worker_cache
from .repeats import Runs, covered, exploded, find_runs, owned, runs_of

PART = 13  # words of an anchor


def split(text: str | None) -> list[bytes]:
    """Words: runs of anything but ASCII white space, which is what bytes.split() goes by."""
    return utf8(text).split()


def word_values(texts: list) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache("words", WordHash)
    parts = [hashed(split(t), cache) for t in texts]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def repeated_words(docs: DataFrame, window: int, part: int) -> DataFrame:
    """doc_id, fp, spans (start and number of consecutive window starts): the windows of docs (doc_id, text, fp) that also start
    in a document with a smaller doc_id."""
    spark = docs.sparkSession
    bits = sketches.size_bits(sketches.text_bytes(docs) / 40)
    merged_sketch = sketches.build(docs, lambda texts: runs_of(*word_values(texts), window, part).anchor, bits)
    shared = spark.sparkContext.broadcast(merged_sketch)

    def body(r: Runs, second: Rolling, keep: np.ndarray) -> list[bytes]:
        hashes = second.windows(window).astype("<u8")
        return [hashes[a : a + n].tobytes() for a, n in zip(r.at[keep].tolist(), r.n[keep].tolist())]

    found = durable(find_runs(docs.where("doc_id is not null"), word_values, body, window, part, shared, 4 << 20))
    short = found.drop("body")
    runs = durable(short.groupBy("anchor", "run").agg(F.min("doc_id").alias("owner")))
    anchors = durable(runs.groupBy("anchor").count().where("count > 1").select("anchor"))
    several = runs.join(anchors, "anchor")
    whole = short.join(runs, ["anchor", "run"]).where("owner < doc_id").select("doc_id", "fp", "start", "n")
    own = found.join(several, ["anchor", "run"]).where("owner = doc_id")
    windows = durable(exploded(own, lambda b, n: np.frombuffer(b, "<u8")))
    single = owned(windows, ["anchor", "window"]).select("doc_id", "fp", F.col("pos").alias("start"), F.lit(1).cast("long").alias("n"))
    spans = durable(whole.unionByName(single))
    dropped(found, runs, anchors, windows)
    return spans.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = 50, part: int = PART) -> DataFrame:
    """Removes every word covered by a window of `window` consecutive words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept (the other words, joined by one space) and removed (stretches of removed words as
    start and end). Windows are judged on the input. Words are runs of characters other than ASCII white space, unchanged. Null
    and empty texts have no words and keep the empty string. Rows with one doc_id never remove from each other; a row with a null
    doc_id is kept whole and removes from none. Other columns are left out. No documents: no rows.
    """
    small_batches(docs.sparkSession)
    docs = keyed(docs)
    spans = repeated_words(docs, window, part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            rows = []
            for text, gone in zip(texts, covered(batch.column("spans"), window)):
                words = split(text)
                n = len(words)
                if gone:
                    edges = [0, *(x for span in gone for x in span), n]
                    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                rows.append((n, n - len(words), b" ".join(words).decode(), [{"start": a, "end": b} for a, b in gone]))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    return docs.join(spans, ["doc_id", "fp"], "left").select("doc_id", "text", "spans").mapInArrow(tidied(cut), "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start: long, end: long>>")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
