"""Near-duplicate classes: an exact Jaccard join over word n-grams that skips by set relations.

A set's tokens have one global order: first those that no other set has, then the rare, then the frequent, as a merged count-min
sketch tells. Two sets that are similar enough share a token among the first few in this order, so only those are indexed, and
of them only tokens that may occur twice: most documents index nothing.

Index lists are cut into blocks of similar set sizes. Skipping inside the index: a set meets only the blocks whose sizes can
match, and in them only entries whose positions leave enough tokens to share. Skipping between sets: each block's first set is
compared with the block's other sets, once; sets similar to it take over its class and need no comparison among themselves; and
for the others the overlaps known with it bound those with each other, so that a pair is compared only if the bound allows it.
Equal sets are one set from the start. So a group of thousands of copies costs about as many comparisons, not their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import passed_on
from . import sketch as sketches
from .common import Rolling, WordHash, dropped, durable, fresh, hashed, mixed, small_batches, table, text_chunks, tidied, utf8, worker_cache
from .components import components

SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LIMITS = (2, 16, 255)  # token counts that the global order tells apart


def sets_of(texts: list, size: int) -> list[np.ndarray]:
    """Distinct `size`-word shingles of each text as sorted 64-bit hashes; all words as one where there are fewer."""
    cache = worker_cache("words", WordHash)
    values = [hashed(utf8(t).translate(SMALL).split(), cache) for t in texts]
    counts = np.array([len(v) for v in values])
    rolling = Rolling(np.concatenate(values) if values else np.zeros(0, np.uint64))
    whole = mixed(rolling.windows(size))
    out = []
    for begin, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist()):
        if n >= size:
            out.append(np.unique(whole[begin : begin + n - size + 1]))
        elif n:
            out.append(mixed(rolling.spans(np.array([begin]), np.array([begin + n])), n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not in `gone`, hardly any of them shuffled: what a sketch of gone's keys doesn't know is kept at once;
    of what it knows, the keys that it only seems to know are found without the rows' other columns."""
    spark = rows.sparkSession
    rows = rows.withColumn("_key", F.xxhash64(*keys))
    bits = sketches.size_bits(16 * gone.count())
    seen = spark.sparkContext.broadcast(sketches.of_keys(gone.select(F.xxhash64(*keys).alias("_key")), "_key", bits))
    mistaken = durable(sketches.perhaps_in(rows.select(*keys, "_key"), "_key", seen).join(gone.select(*keys).distinct(), keys, "left_anti").distinct())
    again = spark.sparkContext.broadcast(sketches.of_keys(mistaken, "_key", sketches.size_bits(16 * mistaken.count())))
    back = sketches.perhaps_in(rows, "_key", again).join(mistaken.select(*keys), keys, "left_semi")
    return sketches.perhaps_in(rows, "_key", seen, False).unionByName(back.select(*rows.columns)).drop("_key")


SETS = "doc_id long, n long, s1 long, s2 long, first int, last int, tokens binary"


def indexed_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """For each row its set's size n and, where the set may be similar to another, the tokens in global order, a signature, and
    which tokens (first to last) the index has."""
    bits = sketches.size_bits(sketches.text_bytes(docs) / 14)
    sketch = sketches.build(docs, lambda texts: np.concatenate(sets_of(texts, size)), bits, depth=1, limits=LIMITS)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch, texts in text_chunks(batches):
            sets = sets_of(texts, size)
            flat = np.concatenate(sets)
            kind = np.zeros(len(flat), np.uint8)
            for level in range(len(LIMITS)):
                kind += seen.reached(flat, level)
            ends = np.cumsum([len(s) for s in sets])
            rows = []
            for s, end in zip(sets, ends.tolist()):
                n = len(s)
                own = kind[end - n : end]
                last = n - -(-n * percent // 100) + 1 if n else 0
                first = n - np.count_nonzero(own)
                if first >= last:
                    rows.append((n, None, None, None, None, None))
                    continue
                order = np.argsort(own, kind="stable")  # hashes are in order already
                sums = [int(mixed(s, salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (1, 2)]
                rows.append((n, *sums, first, last, s[order].astype("<u8").tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*rows), kinds)], [x.split()[0] for x in SETS.split(", ")])

    return docs.mapInArrow(tidied(run), SETS)


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """The index: token, block (of sizes), doc, n, pos (in the global order). Sizes of similar sets are in the same block or in
    neighbouring ones."""
    ratio = max(100 / percent, 1.01) * (1 + 1e-9)  # so that rounding never puts two blocks between sizes 100/percent apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            take = pa.array(np.repeat(np.arange(batch.num_rows), last - first))
            parts = [np.frombuffer(t.as_py(), "<u8")[a:b] for t, a, b in zip(batch.column("tokens"), first.tolist(), last.tolist())]
            pos = [np.arange(a, b) for a, b in zip(first.tolist(), last.tolist())]
            if len(take):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), batch.column("doc").take(take), batch.column("n").take(take), pa.array(np.concatenate(pos))], ["token", "doc", "n", "pos"])

    rows = sets.select("doc", "n", "first", "last", "tokens").mapInArrow(tidied(run), "token long, doc long, n long, pos long")
    return rows.withColumn("block", F.floor(F.log(F.col("n").cast("double")) / math.log(ratio)).cast("int"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, common: the pairs (a, b) with the sizes of their sets and of what these share. A sketch of the pairs' numbers
    keeps sets that no pair needs out of the shuffles."""
    pairs = durable(pairs)
    bits = sketches.size_bits(8 * pairs.count())
    needed = sketches.of_keys(pairs.select(F.explode(F.array("a", "b")).alias("doc")), "doc", bits)
    sets = sketches.perhaps_in(sets.select("doc", "tokens"), "doc", pairs.sparkSession.sparkContext.broadcast(needed))
    left = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = (np.frombuffer(v.as_py(), "<u8") for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                sizes.append((len(x), len(y), int(np.count_nonzero(both[1:] == both[:-1]))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in zip(*sizes))], ["a", "b", "na", "nb", "common"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(tidied(run), "a long, b long, na long, nb long, common long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of at least percent/100 on distinct `size`-word shingles.

    Returns doc_id, n_shingles (the set's size), component_id (the smallest doc_id reachable by links, itself included), a row
    for each row of docs. Words are runs of characters other than ASCII white space, A-Z in small letters; fewer than `size`
    words are one shingle. Null and empty texts have an empty set and no link. Rows of one doc_id are one document: what one of
    them links to, all do. A null doc_id is its own class, null. Other columns are left out. No documents: no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = durable(indexed_sets(docs, size, percent))
    signature = ["n", "s1", "s2"]
    narrow = every.select("doc_id", *signature).where("s1 is not null and doc_id is not null")
    equal = durable(narrow.groupBy(*signature).agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last")).where("doc < last").drop("last"))
    copies = durable(narrow.join(equal, signature).where("doc_id <> doc"))
    sets = durable(without(every.where("tokens is not null and doc_id is not null"), copies, ["doc_id", *signature]).select(F.col("doc_id").alias("doc"), "n", "first", "last", "tokens"))
    every, wide = durable(every.select("doc_id", "n")), every
    dropped(wide)
    copies = copies.select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    index = durable(postings(sets, percent))
    similar = f"100 * common >= {percent} * (na + nb - common)"

    # each block's first set against the block's others: for a set, the two first sets it meets in most blocks
    head = [F.min("doc").alias("head"), F.min_by("n", "doc").alias("h_n"), F.min_by("pos", "doc").alias("h_pos"), F.max("doc").alias("_last")]
    heads = durable(index.groupBy("token", "block").agg(*head).where("head < _last").drop("_last"))
    enough = f"100 * least(n, h_n) >= {percent} * greatest(n, h_n) and least(n - pos, h_n - h_pos) >= ceil({percent} * (n + h_n) / {100 + percent}D)"
    met = index.join(heads, ["token", "block"]).where("doc <> head").groupBy("doc", "head").agg(F.count("*").alias("count"), F.max(F.expr(enough)).alias("able")).where("able")
    heads = passed_on(heads.select("token", "block", "head"), heads)
    most = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("count"), "head"))
    star = durable(overlaps(met.withColumn("rn", most).where("rn <= 2").select(F.col("doc").alias("a"), F.col("head").alias("b")), sets))
    classes = components(star.where(similar).select("a", "b"))

    # what is left: pairs of different classes that share an indexed token, unless sizes, positions or known overlaps rule them out
    known = star.select(F.col("a").alias("doc"), F.col("b").alias("head"), "common")
    entries = index.join(classes, F.col("doc") == F.col("node"), "left").withColumn("class", F.coalesce("component", "doc")).drop("node", "component")
    entries = entries_ = durable(entries)
    share = entries.groupBy("token", "class").count()
    lists = durable(share.groupBy("token").agg(F.max_by("class", "count").alias("major"), F.count("*").alias("classes")).where("classes > 1").drop("classes"))
    entries = entries.join(lists, "token")
    entries = entries.join(heads, ["token", "block"], "left").join(known, ["doc", "head"], "left")
    entries = durable(entries.withColumn("common", F.when(F.col("doc") == F.col("head"), F.col("n")).otherwise(F.col("common"))))
    names = ["doc", "n", "pos", "class", "head", "common"]
    left = entries.where("class <> major").select("token", F.explode(F.array(*(F.col("block") + k for k in (-1, 0, 1)))).alias("block"), *(F.col(c).alias(f"l_{c}") for c in names))
    right = entries.select("token", "block", "major", *(F.col(c).alias(f"r_{c}") for c in names))
    need = f"ceil({percent} * (l_n + r_n) / {100 + percent}D)"
    bound = "case when l_head = r_head and l_common is not null and r_common is not null then least(l_common, r_common) + least(l_n - l_common, r_n - r_common) else least(l_n, r_n) end"
    apart = "l_class <> r_class and (r_class = major or l_doc < r_doc)"
    able = f"100 * least(l_n, r_n) >= {percent} * greatest(l_n, r_n) and least(l_n - l_pos, r_n - r_pos) >= {need} and {bound} >= {need}"
    pairs = left.join(right, ["token", "block"]).where(f"{apart} and {able}").selectExpr("least(l_doc, r_doc) a", "greatest(l_doc, r_doc) b").distinct()
    more = overlaps(pairs, sets).where(similar).select("a", "b")
    links = classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(copies)
    found = components(links)
    dropped(equal, copies, sets, index, heads, star, classes, entries_, entries, lists)
    out = every.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its class (see near_duplicates), and those without one."""
    (name,) = fresh(docs, "gone")
    gone = near_duplicates(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
