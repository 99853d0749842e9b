"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped into buckets of similar length. A block of the longest candidates gives every query a first bound: its
k-th best score there. In a bucket with greatest length l, a candidate can only reach a query's bound t if its cosine with the
query is at least t / (|q| l), the local threshold. Above 1 the query doesn't go there; a high threshold prunes by coordinates
(on the query's largest coordinates a close candidate lies in a narrow range, cut out of sorted lists); a low one prunes by
length only (candidates of the bucket from the longest down to t / |q|). What is left is verified by exact integer products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, tidied

STEPS = 16  # length classes to a factor of two
FOCUS = 3  # coordinates that prune
STEEP = 0.75  # local thresholds from here on prune by coordinates
ASKED = "asked"


def whole_vectors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, row (a number of its own for each row), vector (floor(64 x), whole numbers as double), norm2 and dims, for vectors without
    null or non-finite components. An id is cast to long."""
    x = F.col(vector).cast("array<double>")
    sound = x.isNotNull() & F.col(ident).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v * 64).cast("double")).otherwise(v * 64)  # noqa: E731  beyond, doubles are whole
    out = rows.where(sound).select(F.col(ident).cast("long").alias("id"), F.transform(x, whole).alias("vector"), *(c for c in rows.columns if c == ASKED))
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    return out.withColumns({"row": F.monotonically_increasing_id(), "norm2": norm2, "dims": F.size("vector")})


def matrix(column, dims: int) -> np.ndarray:
    """Rows of a column of arrays of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy() if isinstance(column, pa.Array) else np.concatenate([np.zeros(0), *column.to_numpy()])
    return flat.reshape(len(column), dims).astype(np.float64)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where every partial sum is exact there, else in whole numbers of 64 bits, or of
    any size where 64 bits may not do. Those beyond a long count as the greatest or least long."""
    tops, reach = np.abs(p).max(1, initial=0), float(np.abs(q).max(initial=0)) * max(1, q.shape[1])
    out = np.empty((len(q), len(p)), np.int64)
    small, large = tops <= 2**53 / max(reach, 1.0), tops > 2**62 / max(reach, 1.0)
    middle = ~small & ~large
    if small.any():
        out[:, small] = (q @ p[small].T).astype(np.int64)
    if middle.any():
        out[:, middle] = q.astype(np.int64) @ p[middle].astype(np.int64).T
    if large.any():
        rows = [[int(x) for x in r] for r in p[large].tolist()]
        exact = [[sum(map(int.__mul__, map(int, a), b)) for b in rows] for a in q.tolist()]
        out[:, large] = [[max(-(1 << 63), min((1 << 63) - 1, x)) for x in r] for r in exact]
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Bucket:
    """Candidates, longest first. marks: what tells a candidate from a query's own row."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray):
        with np.errstate(over="ignore"):
            length = np.sqrt((vectors**2).sum(1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.marks, self.vectors, self.length = ids[order], marks[order], vectors[order], length[order]
        self.unit = self.vectors / np.maximum(self.length, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if c not in self.lists:
            order = np.argsort(self.unit[:, c], kind="stable")
            self.lists[c] = order, self.unit[order, c]
        return self.lists[c]

    def close(self, q: np.ndarray, threshold: float) -> np.ndarray:
        """Candidates whose cosine with the unit vector q may reach the threshold, by the ranges of its largest coordinates. For a
        coordinate a of q and b of the candidate, cosine <= a b + sqrt(1 - a^2) sqrt(1 - b^2), so b lies within an arc around a."""
        arc = math.acos(min(1.0, threshold)) + 1e-9
        out = None
        for c in np.argsort(-np.abs(q))[:FOCUS].tolist():
            a = math.acos(max(-1.0, min(1.0, q[c])))
            low, high = math.cos(min(math.pi, a + arc)) - 1e-9, math.cos(max(0.0, a - arc)) + 1e-9
            if out is None:
                order, values = self.list_of(c)
                out = order[np.searchsorted(values, low) : np.searchsorted(values, high, side="right")]
            else:
                own = self.unit[out, c]
                out = out[(own >= low) & (own <= high)]
        return out

    def search(self, marks: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its number and the k best here at least as good as its bound: their ids and scores."""
        with np.errstate(over="ignore"):
            size = np.sqrt((queries**2).sum(1))
            reach = size * self.length[0]
        local = np.where(reach > 0, bounds / np.maximum(reach, 1e-300), np.where(bounds > 0, 2.0, -1.0))
        local = np.where(np.isneginf(bounds), -1.0, local)
        live = local <= 1 + 1e-9
        for n in np.flatnonzero(live & (local >= STEEP)).tolist():
            near = self.close(queries[n] / size[n], float(local[n]) - 1e-9)
            yield from self.verified(n, marks[n], queries[n : n + 1], near, bounds[n], k)
        flat = np.flatnonzero(live & (local < STEEP))
        for a in range(0, len(flat), 256):
            part = flat[a : a + 256]
            need = np.min(np.where(bounds[part] > 0, bounds[part] / np.maximum(size[part], 1e-300), 0.0))
            far = int(np.searchsorted(-self.length, -need * (1 - 1e-9), side="right"))
            scores = products(queries[part], self.vectors[:far])
            for n, s in zip(part.tolist(), scores):
                keep = np.flatnonzero((s >= bounds[n]) & (self.marks[:far] != marks[n]))
                top = keep[best(s[keep], self.ids[keep], k)]
                if len(top):
                    yield n, self.ids[top], s[top]

    def verified(self, n: int, own: int, query: np.ndarray, near: np.ndarray, bound: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        near = near[self.marks[near] != own]
        s = products(query, self.vectors[near])[0] if len(near) else np.zeros(0, np.int64)
        keep = np.flatnonzero(s >= bound)
        top = keep[best(s[keep], self.ids[near[keep]], k)]
        if len(top):
            yield n, self.ids[near[top]], s[top]


def top_k(candidates: DataFrame, queries: DataFrame | Column, k: int = 20, ident: str = "vec_id", vector: str = "embedding", bucket_rows: int = 8192, block_rows: int = 16_384, seed_rows: int = 4096) -> DataFrame:
    """The k candidates of highest inner product for every query.

    queries: a condition, which the rows of candidates that are queries fulfil; then a query's candidates are all rows but its own,
    others of its id among them. Or another table; then candidates of the query's id are left out. Every query row is ranked for
    itself, also where an id repeats. Returns query_id, rank (from 1), vec_id, score. Components x count as floor(64 x). Ties go
    to the smaller vec_id; fewer than k candidates give all. Null vectors or ids and vectors with null or non-finite components
    take no part; vectors without components do, with a score of 0. Vectors of other lengths than the query's are not compared
    with it. Scores beyond a long count as the greatest or least long. Other columns are left out.

    A query goes to the buckets that its own bound doesn't rule out; a bucket goes once to each block of queries (`block_rows`), so
    rows shuffled are candidates times blocks, and queries times live buckets (`bucket_rows`). The driver takes `seed_rows`
    vectors in all, shared out between the commonest 64 lengths; queries of other lengths start without a bound.
    """
    spark = candidates.sparkSession
    condition = not isinstance(queries, DataFrame)
    if condition:
        candidates = candidates.select(ident, vector, F.coalesce(queries, F.lit(False)).alias(ASKED))
    # buckets: length classes, each cut into parts of bucket_rows or so; the number of classes is bounded by the range of doubles
    kind = F.when(F.col("norm2") > 0, F.floor(F.log2(F.least("norm2", F.lit(1e308))) * (STEPS / 2))).otherwise(-(1 << 20)).cast("int")
    cand = durable(whole_vectors(candidates, ident, vector).withColumn("class", kind))
    asked = cand.where(ASKED) if condition else durable(whole_vectors(queries, ident, vector))
    asked = asked.select("id", "row", "vector", "norm2", "dims", F.col("row" if condition else "id").alias("mark"))
    cand = cand.withColumn("mark", F.col("row" if condition else "id"))
    classes = cand.groupBy("dims", "class").agg(F.count("*").alias("rows"), F.max("norm2").alias("top"))
    classes = classes.withColumn("parts", F.ceil(F.col("rows") / bucket_rows).cast("int"))
    # the longest candidates bound every query's k-th score from below
    common = [r.dims for r in cand.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(64).collect()]
    seeds = {}
    for dims in common:
        longest = cand.where(F.col("dims") == dims).select("id", "mark", "vector", "norm2").orderBy(F.desc("norm2"), "id").limit(max(1, seed_rows // len(common))).toPandas()
        seeds[dims] = Bucket(longest["id"].to_numpy(), longest["mark"].to_numpy(), matrix(longest["vector"], dims))
    shared = spark.sparkContext.broadcast(seeds)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, dims = batch.column("mark").to_numpy(), batch.column("dims").to_numpy()
            bounds = np.full(batch.num_rows, -np.inf)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                if d in shared.value:
                    q = matrix(batch.column("vector").take(pa.array(rows)), d)
                    for n, _, scores in shared.value[d].search(marks[rows], q, bounds[rows], k):
                        if len(scores) == k:
                            bounds[rows[n]] = scores[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row", "mark", "vector", "norm2", "dims")), pa.array(bounds)], ["id", "row", "mark", "vector", "norm2", "dims", "bound"])

    bounded = durable(asked.mapInArrow(tidied(bound), "id long, row long, mark long, vector array<double>, norm2 double, dims int, bound double"))
    blocks = max(1, math.ceil(bounded.count() / block_rows))
    # the local threshold, before anything is shuffled: above 1, the query skips the bucket
    live = F.expr("bound <= 0 or bound <= sqrt(norm2) * sqrt(top) * (1 + 1e-9)")
    keys = ["dims", "class", "part", "block"]
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    left = bounded.join(classes, "dims").where(live).select("dims", "class", parts, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "id", "row", "mark", "vector", "bound").toDF(*keys, "id", "row", "mark", "vector", "bound")
    needed = cand.join(classes.select("dims", "class", "parts"), ["dims", "class"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    right = needed.select("dims", "class", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "mark", "vector").toDF(*keys, "id", "mark", "vector")

    def meet(key, queries_: pa.Table, bucket: pa.Table) -> pa.Table:
        out = []
        if queries_.num_rows and bucket.num_rows:
            dims = key[0].as_py()
            one = Bucket(bucket.column("id").to_numpy(), bucket.column("mark").to_numpy(), matrix(bucket.column("vector"), dims))
            ids, rows = queries_.column("id").to_numpy(), queries_.column("row").to_numpy()
            for n, found, scores in one.search(queries_.column("mark").to_numpy(), matrix(queries_.column("vector"), dims), queries_.column("bound").to_numpy(), k):
                out.append((np.full(len(found), rows[n]), np.full(len(found), ids[n]), found, scores))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), columns)))

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
