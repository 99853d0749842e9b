"""Benchmark decontamination with suffix arrays of the training text.

Each task builds suffix arrays of its documents, a shard of a few MB at a time: the positions whose word occurs in the
benchmark, in the order of the words that follow. Every suffix of every benchmark item is then found in each shard by binary
search, which gives the stretch of the array with an equal beginning, and so all the places of verbatim matches; each is
followed to the longest one. A word outside the benchmark's vocabulary ends any match, so the arrays leave suffixes that start
with one out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh, table, text_chunks, tidied, utf8

#: ASCII letters become small; what is not in words becomes a space. Bytes from 128 on belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


class Items:
    """A block of benchmark items: their vocabulary, their words as codes (0 ends an item), and their suffixes in sorted order, in
    groups with the same first `window` words (all words, where an item has fewer). Equal items are one, with several names."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        distinct: dict[tuple, set[str]] = {}
        for name, words in items:
            distinct.setdefault(tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), set()).add(name)
        self.names = list(distinct.values())
        self.codes = np.array([c for x in distinct for c in (*x, 0)] + [0] * window, np.int64)
        lengths = np.array([len(x) for x in distinct], np.int64)
        self.begins = np.cumsum(lengths + 1) - lengths - 1
        self.bits = max(1, (len(self.vocabulary) + 1).bit_length())
        self.per_key = 62 // self.bits
        need = np.minimum(window, lengths)
        starts = lengths - need + 1
        item = np.repeat(np.arange(len(lengths)), starts)
        at = self.begins[item] + np.arange(len(item)) - np.repeat(np.cumsum(starts) - starts, starts)
        heads = np.where(np.arange(window) < need[item][:, None], self.codes[at[:, None] + np.arange(window)], 0)
        order = np.lexsort((need[item], *heads.T[::-1])) if len(at) else np.zeros(0, np.int64)
        heads, self.at, self.item, need = heads[order], at[order], item[order], need[item][order]
        new = np.ones(len(order), bool)
        new[1:] = (heads[1:] != heads[:-1]).any(1) | (need[1:] != need[:-1])
        self.first = np.append(np.flatnonzero(new), len(order))  # where groups begin
        self.heads, self.need = heads[new], need[new]
        for g in np.flatnonzero(np.diff(self.first) > 1).tolist():  # in order beyond the first words too
            a, b = self.first[g], self.first[g + 1]
            own = sorted(zip((tuple(self.codes[p : self.begins[i] + lengths[i]].tolist()) for p, i in zip(self.at[a:b], self.item[a:b])), self.at[a:b].tolist(), self.item[a:b].tolist()))
            self.at[a:b], self.item[a:b] = [x[1] for x in own], [x[2] for x in own]
        self.depth = int(self.need.max(initial=0))
        self.ranges = np.array([self.range(x[:n], 0) for x, n in zip(self.heads, self.need.tolist())], np.int64).reshape(-1, 2)

    def range(self, codes, level: int) -> tuple[int, int]:
        """Keys of this level that begin with the words of the suffix that fall in it: from the first to below the second."""
        own = codes[level * self.per_key : (level + 1) * self.per_key]
        key = 0
        for c in own:
            key = key << self.bits | int(c)
        room = self.bits * (self.per_key - len(own))
        return key << room, (key + 1) << room

    def longest(self, group: int, codes: np.ndarray, place: int) -> tuple[int, int, int]:
        """The longest match of a text's suffix among a group's: its length in words, the item, and the place there. By binary
        search: the longest is a neighbour of where the suffix would stand."""
        a, b = int(self.first[group]), int(self.first[group + 1])
        best = (0, 0, 0)
        while a < b:
            mid = (a + b) // 2
            length = common(codes, place, self.codes, int(self.at[mid]))
            if length > best[0]:
                best = (length, int(self.item[mid]), int(self.at[mid] - self.begins[self.item[mid]]))
            if codes[place + length] < self.codes[self.at[mid] + length] or not codes[place + length] and not self.codes[self.at[mid] + length]:
                b = mid
            else:
                a = mid + 1
        return best


def common(x: np.ndarray, i: int, y: np.ndarray, j: int) -> int:
    """How many words x from i and y from j have in common before they differ or end."""
    n, step = 0, 32
    while True:
        a, b = x[i + n : i + n + step], y[j + n : j + n + step]
        m = min(len(a), len(b))
        differ = np.flatnonzero((a[:m] != b[:m]) | (a[:m] == 0))
        if len(differ):
            return n + int(differ[0])
        n += m
        if m < step:
            return n
        step *= 2


class SuffixArray:
    """Suffixes of a coded text (0: a word of no item, or a document's end), sorted by their first `depth` words."""

    def __init__(self, codes: np.ndarray, items: Items):
        q, bits = items.per_key, items.bits
        levels = -(-items.depth // q)
        padded = np.concatenate([codes, np.zeros(q * levels, np.int64)])
        packed = np.zeros(len(codes) + q * (levels - 1), np.int64)
        for j in range(q):
            packed = packed << bits | padded[j : j + len(packed)]
        at = np.flatnonzero(codes)
        at = at[np.argsort(packed[at], kind="stable")]
        self.keys = [packed[at]]
        whole = np.int64((1 << bits) - 1)
        for level in range(1, levels):
            # only where all keys so far are equal and full does the next one matter
            last = self.keys[-1]
            same = (last[1:] == last[:-1]) & ((last[1:] & whole) > 0)
            if level > 1:
                same &= tied
            tied = same
            group = np.concatenate([[False], same])
            group[:-1] |= same
            rows = np.flatnonzero(group)
            if len(rows):
                run = np.cumsum(np.concatenate([[True], ~same]))[rows]
                at[rows] = at[rows][np.lexsort((packed[at[rows] + q * level], run))]
            nxt = packed[at + q * level]
            self.keys.append(nxt)
            if level + 1 < levels:
                tied = tied & (nxt[1:] == nxt[:-1])
        self.at = at

    def find(self, items: Items) -> Iterator[tuple[int, np.ndarray]]:
        """For each group of the items' suffixes with matches, its number and the places where all its first words follow."""
        low = np.searchsorted(self.keys[0], items.ranges[:, 0])
        high = np.searchsorted(self.keys[0], items.ranges[:, 1])
        for k in np.flatnonzero(high > low).tolist():
            codes = items.heads[k][: items.need[k]]
            a, b = int(low[k]), int(high[k])
            for level in range(1, -(-len(codes) // items.per_key)):
                lo, hi = items.range(codes, level)
                part = self.keys[level][a:b]
                a, b = a + int(np.searchsorted(part, lo)), a + int(np.searchsorted(part, hi))
                if a == b:
                    break
            if a < b:
                yield k, self.at[a:b]


MATCHES = "array<struct<start: long, length: long, item: string, item_start: long>>"
FOUND = f"doc_id long, fp long, n_words long, matches {MATCHES}, items array<string>"


def find_matches(docs: DataFrame, items: Items, every: bool) -> DataFrame:
    """Per row of docs (doc_id, text, fp; with `every`, of those without a match too): its words, its longest matches and the items
    that have one. A longest match (start, length in words, item, item_start) lies in no other; where several items have it,
    one is named, of equal items the first."""
    match = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), match, pa.list_(pa.string())]
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for part, texts in text_chunks(batches):
            codes, counts = [], []
            for text in texts:
                words = words_of(text)
                codes.append(np.fromiter(map(items.vocabulary.get, words, repeat(0)), np.int64, len(words)))
                codes.append(np.zeros(1, np.int64))
                counts.append(len(words))
            begins = np.cumsum([0] + [n + 1 for n in counts])
            flat = np.concatenate(codes)
            met: dict[int, list[tuple[int, int]]] = {}
            if len(items.need):
                for group, places in SuffixArray(flat, items).find(items):
                    for row, place in zip((np.searchsorted(begins, places, side="right") - 1).tolist(), places.tolist()):
                        met.setdefault(row, []).append((place, group))
            rows = []
            for row, (doc, fp) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("fp").to_pylist())):
                found, names, end = [], set(), -1
                for place, group in sorted(met.get(row, ())):
                    names.update(*(items.names[i] for i in set(items.item[items.first[group] : items.first[group + 1]].tolist())))
                    length, item, start = items.longest(group, flat, place)
                    if place + length > end:
                        end = place + length
                        found.append({"start": place - int(begins[row]), "length": length, "item": min(items.names[item]), "item_start": start})
                if found or every:
                    rows.append((doc, fp, counts[row], found, sorted(names)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "fp", "n_words", "matches", "items"])

    return docs.mapInArrow(tidied(run), FOUND)


def read_items(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of at most `block_bytes` of text (or one item), each small enough to go to every task. A block at
    a time passes through the driver. An item's name is its item_id as a string; null ids and texts without words are left out."""
    own, size, none = [], 0, True
    for row in benchmark.select(F.col("item_id").cast("string").alias("name"), "text").where("item_id is not null and text is not null").toLocalIterator():
        words = words_of(row.text)
        if size and size + len(row.text) > block_bytes:
            yield Items(own, window)
            own, size, none = [], 0, False
        if words:
            own.append((row.name, words))
            size += len(row.text)
    if own or none:
        yield Items(own, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, least_share: float = 0.05, block_bytes: int = 16 << 20) -> DataFrame:
    """Per row of docs: doc_id, fp, n_words, n_hit, n_items, items, matches, contaminated.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, in small letters. A window is `window`
    consecutive words of an item, or all words of a shorter one. matches are the longest stretches of at least a window that the
    document shares with an item, word by word: start and length in the document's words, item, and item_start in the item's.
    n_hit counts the document's words inside of them, and items are the sorted names of all items with a window there. A document
    is contaminated with n_hit over 0 and at least `least_share` of its words. Null and empty texts have no words. Repeated rows
    are judged each for itself; other columns are left out. No documents: no rows. An empty benchmark: no hits.

    A benchmark of more than `block_bytes` takes a pass over the documents for each so many bytes; a block and its suffixes go to
    every task.
    """
    per_mille = round(least_share * 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("fp"))
    found, more = None, None
    for items in read_items(benchmark, window, block_bytes):
        if found is None:
            found = find_matches(docs, items, True)
        else:
            next_ = durable(find_matches(docs, items, False))
            more = next_ if more is None else more.unionByName(next_)
    if more is not None:  # to each row what its doc_id and text have in the other blocks
        flat = lambda c: F.flatten(F.collect_list(c)).alias(f"more_{c}")
        more = more.groupBy(F.col("doc_id").alias("other_id"), F.col("fp").alias("other_fp")).agg(flat("matches"), flat("items"))
        joined = found.join(more, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("fp") == F.col("other_fp")), "left")
        both = lambda c: F.concat(c, F.coalesce(f"more_{c}", F.array())).alias(c)
        found = joined.select("doc_id", "fp", "n_words", both("matches"), both("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            kept, hits = [], []
            for matches in rows["matches"]:
                own, end, hit = [], 0, 0
                for m in sorted(matches, key=lambda m: (m["start"], -m["length"], m["item"])):
                    stop = m["start"] + m["length"]
                    if stop > end:
                        own.append(m)
                        hit += stop - max(end, m["start"])
                        end = stop
                kept.append(own)
                hits.append(hit)
            names = [sorted(set(x)) for x in rows["items"]]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("fp"),
                    b.column("n_words"),
                    pa.array(hits, pa.int64()),
                    pa.array(map(len, names), pa.int64()),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(kept, b.schema.field("matches").type),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    pa.array([h > 0 and 1000 * h >= per_mille * n for h, n in zip(hits, rows["n_words"])], pa.bool_()),
                ],
                ["doc_id", "fp", "n_words", "n_hit", "n_items", "items", "matches", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(tidied(finish), f"doc_id long, fp long, n_words long, n_hit long, n_items long, items array<string>, matches {MATCHES}, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated (see contamination). Rows with a null doc_id are judged too."""
    ident, mark = fresh(docs, "judged_id", "judged_fp")
    judged = contamination(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias(ident), F.col("fp").alias(mark)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col(mark))
    return docs.join(judged, same, "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
