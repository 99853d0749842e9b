"""What a task of the suffix index holds at once is bounded by suffixes, not by text."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lattica.functions.storage import _PATHS
from lattica.llm import common, sketch, suffix_index
from lattica.llm.common import mixed

SHAPE = suffix_index.Shape(50, 20)


def test_slices_are_whole_documents():
    row = np.array([2, 0, 0, 2, 2, 5, 6])
    got = [x.tolist() for x in suffix_index.document_slices(row, 3)]
    assert got == [[1, 2], [0, 3, 4], [5, 6]]
    assert [x.tolist() for x in suffix_index.document_slices(row, 2)] == [[1, 2], [0, 3, 4], [5, 6]]  # a document's are never parted


def test_shards_follow_the_suffixes_that_the_sketch_lets_through():
    data = np.random.default_rng(0).integers(97, 123, 200_000).astype(np.uint8)
    start, n, at, anchor = suffix_index.anchors_of(data, np.array([len(data)]), 50, 20)
    sample = SHAPE.suffixes(data, at, at - start, n)[:, :50]
    bits = 16

    def seen(keys, often):
        plane = np.zeros((1, 1, 1 << (bits - 3)), np.uint8)
        on = sketch.counters(keys, bits, 0).astype(np.int64)
        np.bitwise_or.at(plane[0, 0], on >> 3, (1 << (on & 7)).astype(np.uint8))
        return sketch.Sketch(plane, bits, [np.sort(sketch.counters(often, bits, 0))])

    none = np.zeros(0, np.uint64)
    every = suffix_index.shard_splitters(sample, seen(anchor, none), SHAPE, 0, 100_000)
    assert abs(len(every) + 1 - len(sample) * SHAPE.width / 100_000) <= 1 and (every[1:] > every[:-1]).all()
    few = suffix_index.shard_splitters(sample, seen(anchor[:100], none), SHAPE, 0, 100_000)
    assert len(few) < len(every) / 3
    dense = suffix_index.shard_splitters(sample, seen(anchor, anchor), SHAPE, 0, 100_000)
    assert len(dense) > 10 * len(every)  # each window is a suffix
    assert len(suffix_index.shard_splitters(sample[:0], seen(anchor, none), SHAPE, 0, 100)) == 0
    assert (mixed((suffix_index._BYTES[sample[:, :20]] * common.powers(20, common.BASE)[0]).sum(1, dtype=np.uint64)) == anchor).all()


def test_row_groups_are_small_and_no_sort_comes_before_parts(spark):
    common.small_batches(spark)
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 5
    rows = spark.range(0, 400, 1, 1).select((F.col("id") % 2).alias("kind"), F.transform(F.sequence(F.lit(1), F.lit(600)), lambda k: F.xxhash64(k, "id")).alias("x"))
    out = common.durable(rows, by="kind", row_group=1 << 19)
    files = glob.glob(_PATHS[out][0].removeprefix("file://") + "/kind=0/*.parquet")
    assert files and pq.ParquetFile(files[0]).metadata.num_row_groups > 1
    common.dropped(out)


def test_row_groups_of_a_few_large_rows_are_small(spark):
    rows = spark.range(0, 40, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda k: F.xxhash64(k, "id")).alias("x"))
    out = common.durable(rows, row_group=4 << 20)
    of = pq.ParquetFile(glob.glob(_PATHS[out][0].removeprefix("file://") + "/*.parquet")[0]).metadata
    assert max(of.row_group(k).num_rows for k in range(of.num_row_groups)) <= 16 and of.num_rows == 40
    common.dropped(out)


def test_places_go_out_in_rows_of_bounded_size(spark, prose, monkeypatch):
    texts = [prose(300, k % 30) for k in range(120)] + [prose(9_000, 200)] * 2
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    whole, rows = suffix_index.durable, []

    def watched(df, *a, **o):
        out = whole(df, *a, **o)
        if "starts" in out.columns:
            rows.extend(out.where("batch = -1").selectExpr("length(starts) div 8 AS places", "length(docs) div 8 AS docs").collect())
        if "spans" in out.columns:
            lists = [sorted(map(tuple, r.spans)) for r in out.collect()]
            assert lists and all(a + n < b for spans in lists for (a, n), (b, _) in zip(spans, spans[1:]))  # none meet
        return out

    monkeypatch.setattr(suffix_index, "durable", watched)
    monkeypatch.setattr(suffix_index, "PLACES", 500)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_index.suffix_dedup(docs).collect()}
    assert len(rows) > 20 and all(r.places < 1_000 or r.docs <= 2 for r in rows)
    assert all(got[k] == (len(texts[k]), 1) for k in [*range(30, 120), 121]) and got[0] == got[120] == (0, 0)
