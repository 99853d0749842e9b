"""How the tokens of two tokenizers go together, counted over a corpus.

Both tokenizers cut the same bytes. Places where both end a token cut a text into groups; the tokens of a group are linked, each of
the one side (A) with each of the other (B). A pair of ids counts the documents that have it linked.

Counting: the ids of side A are dealt into stripes (id modulo the number of stripes), so that each stripe has a dense matrix of its
ids by the ids of side B, of a size that the vocabularies alone bound. Tasks add equal pairs up before anything is shuffled, what
they have is merged once more by stripe and a salt, and then added into the stripes' matrices; a row's maximum is its id's best
count. Scoring: the links, cut by stripe when the texts were tokenized, go to where their stripe's counts are, and only sums a
document come back. A stripe's links are dealt over as many tasks as their size asks for, each of which gets the stripe's counts.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, durable, small_batches, table, text_chunks, tidied, utf8, worker_cache
from .packing import BYTE_NAMES, vocabulary

STRIPES = 128
UNIT = re.compile(r" *[^ ]+(?: +\Z)?| +\Z")
SPACE = "▁"  # of pieces, stands for a space
PROBES = ("It's a test,  isn't it? 12 34ab ", "Été naïve (x)--y!!\n\n next\tline \r\n", "a 'x' ''s </s> <|endoftext|> ##  __", "日本 語 \U0001f600 é́ ß")


class Both:
    """Two tokenizers, and what they make of units of text: runs that begin with spaces, if any, and end where the next spaces
    begin; spaces at the end are the last's. A unit's groups are kept for the next time, as numbers of groups, which are kept too.
    Where tokenizers could join or see across the ends of units, which is tried out first, a whole text is one unit."""

    def __init__(self, byte_level: str, pieces: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        named = {BYTE_NAMES.get(b, chr(b)): b for b in range(256)}
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        spelled = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(named[c] for c in t) if all(c in named for c in t) else t.encode() for t in spelled]
        texts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:-1], 16)]) if self.b.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.most = most
        self.forget()
        self.units = not any(SPACE in t.lstrip(SPACE) for t in texts) and all(self.whole([p]) == self.whole(UNIT.findall(p)) for p in (" " + p for p in PROBES))

    def forget(self) -> None:
        self.known: dict[str, bytes | None] = {}  # of a unit: its groups' numbers, None where bytes differ
        self.numbers: dict[tuple[bytes, bytes], int] = {}
        self.spelled: list[str] = []  # of a group: a1,a2|b1
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # its distinct pairs and how often it has them
        self.sizes: list[tuple[int, int]] = []

    def whole(self, units: list[str]) -> tuple[list[int], list[int]]:
        return [i for e in self.a.encode_batch_fast(units, add_special_tokens=False) for i in e.ids], [i for e in self.pieces(units) for i in e]

    def pieces(self, units: list[str]) -> list[list[int]]:
        """B puts a space before a text itself."""
        return self.b.encode([u[1:] for u in units], num_threads=1)

    def number(self, a: bytes, b: bytes) -> int:
        key = (a, b)
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.spelled)
            x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
            self.spelled.append(f"{','.join(map(str, x.tolist()))}|{','.join(map(str, y.tolist()))}")
            (x, x_times), (y, y_times) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
            self.pairs.append((np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(x_times, y_times).ravel()))
            self.sizes.append((len(a) // 4, len(b) // 4))
        return n

    def learn(self, units: list[str]) -> None:
        """The groups of units that are not known, all at once: common ends in the joined bytes of all of them."""
        both = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)], self.pieces(units)
        raw = [utf8(u) for u in units]
        for k, spelled in enumerate((self.a_bytes, self.b_bytes)):
            if b"".join(spelled[i] for ids in both[k] for i in ids) != b"".join(raw):
                for u, ids, x in zip(units, both[k], raw):
                    if b"".join(map(spelled.__getitem__, ids)) != x:
                        self.known[u] = None
        fine = [n for n, u in enumerate(units) if u not in self.known]
        if not fine:
            return
        a, b = (np.array([i for n in fine for i in side[n]], "<u4") for side in both)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cuts, b_cuts = (4 * np.concatenate([[0], np.searchsorted(e, common) + 1]) for e in (a_ends, b_ends))
        a, b, a_cuts, b_cuts = a.tobytes(), b.tobytes(), a_cuts.tolist(), b_cuts.tolist()
        number = self.number
        groups = np.array([number(a[a_cuts[k] : a_cuts[k + 1]], b[b_cuts[k] : b_cuts[k + 1]]) for k in range(len(common))], "<i4").tobytes()
        ends = (4 * (np.searchsorted(common, np.cumsum([len(raw[n]) for n in fine])) + 1)).tolist()
        for n, start, end in zip(fine, [0, *ends], ends):
            self.known[units[n]] = groups[start:end]

    def documents(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Numbers of the groups of each text, in order; None where a text has no tokens."""
        if len(self.known) > self.most or len(self.spelled) > self.most:
            self.forget()
        cut = [None if not t or SPACE in t else UNIT.findall(" " + t) if self.units else [" " + t] for t in texts]
        new = list({u for units in cut if units for u in units if u not in self.known})
        for k in range(0, len(new), 20_000):
            self.learn(new[k : k + 20_000])
        out = []
        for units in cut:
            parts = [self.known[u] for u in units] if units else [None]
            out.append(None if None in parts else np.frombuffer(b"".join(parts), "<i4"))
        return out


def both(byte_level: str, pieces: str) -> Both:
    """One for a worker process, which runs many tasks."""
    return worker_cache(f"both {byte_level} {pieces}", lambda: Both(byte_level, pieces))


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers of at least 0 in as few bytes each as the greatest needs."""
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def wide(x: bytes, n: int) -> np.ndarray:
    """What `narrow` packed: n numbers."""
    return np.frombuffer(x, f"<u{len(x) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with the sums of n."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n[order], first) if len(first) else n


TOKENIZED = "kind int, key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, size int, docs binary, a binary, b binary, times binary"
COUNTED = "stripe int, salt int, size int, a binary, b binary, n binary"
_names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def tokenized(docs: DataFrame, byte_level: str, pieces: str, stripes: int) -> DataFrame:
    """Kind 0: a row for each document, with its own key. Kind 1: a row for each chunk of documents (keys from `key` on) and stripe:
    the distinct pairs of each document, and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = both(byte_level, pieces)
        key = TaskContext.get().partitionId() << 40
        for part, texts in text_chunks(batches):
            rows, at, numbers, times = [], [], [], []
            for k, g in enumerate(of.documents(texts)):
                if g is None:
                    rows.append((0, 0, 0, 0, ""))
                    continue
                spelled = of.spelled
                own, n = np.unique(g, return_counts=True)
                sizes = np.array([of.sizes[i] for i in own.tolist()], np.int64).reshape(-1, 2)
                digest = hashlib.sha256(";".join([spelled[i] for i in g.tolist()]).encode()).hexdigest()
                rows.append((int(n @ sizes[:, 0]), int(n @ sizes[:, 1]), len(g), int(n @ (sizes[:, 0] * sizes[:, 1])), digest))
                at.append(np.full(len(own), k))
                numbers.append(own)
                times.append(n)
            columns = list(zip(*rows))
            none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.int32(), *[pa.binary()] * 4)]
            ids = [pa.array(np.full(len(rows), 0, np.int32)), pa.array(np.arange(key, key + len(rows))), part.column("doc_id")]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), *none], _names(TOKENIZED))
            if at:
                yield chunk_links(of, key, np.concatenate(at), np.concatenate(numbers), np.concatenate(times), stripes)
            key += len(rows)

    return docs.mapInArrow(tidied(run), TOKENIZED)


def chunk_links(of: Both, key: int, at: np.ndarray, numbers: np.ndarray, times: np.ndarray, stripes: int) -> pa.RecordBatch:
    """The rows of kind 1 of one chunk: documents `at` have the groups `numbers` so many times."""
    used, number = np.unique(numbers, return_inverse=True)
    parts = [of.pairs[i] for i in used.tolist()]
    size = np.array([len(p[0]) for p in parts])
    starts = np.cumsum(size) - size
    a, b, each = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3))
    n = size[number]
    take = np.repeat(starts[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    a, b, docs, each = a[take], b[take], np.repeat(at, n), each[take] * np.repeat(times, n)
    width_a, width_b, width = (len(of.a_bytes) // stripes).bit_length(), len(of.b_bytes).bit_length(), int(at.max()).bit_length()
    if (stripes - 1).bit_length() + width_a + width_b + width > 63:
        raise ValueError("ids and documents of a chunk must fit 63 bits together")
    codes = (((a % stripes << width) + docs << width_a) + a // stripes << width_b) + b
    codes, each = added(codes, each)
    b, codes = codes & ((1 << width_b) - 1), codes >> width_b
    a, codes = codes & ((1 << width_a) - 1), codes >> width_a
    docs, stripe = codes & ((1 << width) - 1), codes >> width
    first = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]]))
    bounds = list(zip(first.tolist(), [*first[1:].tolist(), len(stripe)]))
    packed = [pa.array([narrow(x[i:j]) for i, j in bounds], pa.binary()) for x in (docs, a, b, each)]
    none = [pa.nulls(len(bounds), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
    head = [pa.array(np.full(len(bounds), 1, np.int32)), pa.array(np.full(len(bounds), key))]
    return pa.RecordBatch.from_arrays([*head, *none, pa.array(stripe[first].astype(np.int32)), pa.array([j - i for i, j in bounds], pa.int32()), *packed], _names(TOKENIZED))


def partial_counts(links: DataFrame, spread: int, held: int = 4 << 20) -> DataFrame:
    """Documents that have a pair, added up in each task before the shuffle; a task holds about `held` pairs at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % spread
        sums, new, waiting = {}, {}, 0
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def settle() -> int:
            for stripe, codes in new.items():
                own, n = sums.get(stripe, nothing)
                codes = np.concatenate(codes)
                sums[stripe] = added(np.concatenate([own, codes]), np.concatenate([n, np.ones(len(codes), np.int64)]))
            new.clear()
            return sum(len(c) for c, _ in sums.values())

        for batch in batches:
            for stripe, size, a, b in zip(*(batch.column(c).to_pylist() for c in ("stripe", "size", "a", "b"))):
                new.setdefault(stripe, []).append(wide(a, size) << 32 | wide(b, size))
                waiting += size
            if waiting > held:
                waiting = 0
                if settle() > held:
                    yield counted(sums, salt)
                    sums.clear()
        settle()
        if sums:
            yield counted(sums, salt)

    return links.select("stripe", "size", "a", "b").mapInArrow(tidied(run), COUNTED)


def counted(sums: dict[int, tuple[np.ndarray, np.ndarray]], salt: int) -> pa.RecordBatch:
    rows = [(stripe, salt, len(codes), narrow(codes >> 32), narrow(codes & 0xFFFFFFFF), narrow(n)) for stripe, (codes, n) in sums.items()]
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _names(COUNTED))


def merged_counts(counts: DataFrame) -> DataFrame:
    """One row for each stripe and salt, from sorted rows: what is held are the distinct pairs of one stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            for stripe, salt, size, a, b, n in zip(*(batch.column(c).to_pylist() for c in _names(COUNTED))):
                codes, n = wide(a, size) << 32 | wide(b, size), wide(n, size)
                if at == (stripe, salt):
                    sums = added(np.concatenate([sums[0], codes]), np.concatenate([sums[1], n]))
                else:
                    if at:
                        yield counted({at[0]: sums}, at[1])
                    at, sums = (stripe, salt), (codes, n)
        if at:
            yield counted({at[0]: sums}, at[1])

    return counts.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").mapInArrow(tidied(run), COUNTED)


def best_counts(counts: DataFrame, byte_level: str, pieces: str, stripes: int) -> DataFrame:
    """One row for each stripe: its pairs, their counts, and 1 in `best` where a count is its row's maximum in the stripe's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = both(byte_level, pieces)
        matrix, at, used = None, None, set()

        def out() -> pa.RecordBatch:
            rows = np.array(sorted(used))
            block = matrix[rows]
            a, b = np.nonzero(block)
            n = block[a, b]
            best = (n == block.max(axis=1)[a]).astype(np.uint8)
            matrix[rows] = 0
            used.clear()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(n)], pa.int32()), *(pa.array([narrow(x)], pa.binary()) for x in (rows[a], b, n, best))], ["stripe", "size", "a", "b", "n", "best"])

        for batch in batches:
            for stripe, size, a, b, n in zip(*(batch.column(c).to_pylist() for c in ("stripe", "size", "a", "b", "n"))):
                if matrix is None:
                    matrix = np.zeros((len(of.a_bytes) // stripes + 1, len(of.b_bytes)), np.int64)
                if at is not None and stripe != at:
                    yield out()
                at, a = stripe, wide(a, size)
                np.add.at(matrix, (a, wide(b, size)), wide(n, size))
                used.update(np.unique(a).tolist())
        if at is not None:
            yield out()

    rows = counts.select("stripe", "size", "a", "b", "n").repartition("stripe").sortWithinPartitions("stripe")
    return rows.mapInArrow(tidied(run), "stripe int, size int, a binary, b binary, n binary, best binary")


def link_sums(links: DataFrame, best: DataFrame, parts: int) -> DataFrame:
    """key (of a document), n_best and count_sum, from the links of one stripe in one chunk: several rows a document. Links meet
    the counts of their stripe in `parts` tasks or so a stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = counts = highest = None
        for batch in batches:
            keys, bests, sums = [], [], []
            for key, size, docs, a, b, times, n, top in zip(*(batch.column(c).to_pylist() for c in ("key", "size", "docs", "a", "b", "times", "n", "best"))):
                own = wide(a, size) << 32 | wide(b, size)
                if key is None:
                    codes, counts, highest = own, wide(n, size), wide(top, size)
                    continue
                docs, times = wide(docs, size), wide(times, size)
                place = np.searchsorted(codes, own)
                first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
                keys.append(key + docs[first])
                bests.append(np.add.reduceat(times * highest[place], first))
                sums.append(np.add.reduceat(times * counts[place], first))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, bests, sums)], ["key", "n_best", "count_sum"])

    none = [F.lit(None).cast(t).alias(c) for c, t in (("docs", "binary"), ("times", "binary"))]
    salts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt")
    first = best.select("stripe", salts, F.lit(None).cast("long").alias("key"), "size", none[0], "a", "b", none[1], "n", "best")
    rest = links.select("stripe", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("salt"), "key", "size", "docs", "a", "b", "times", *(F.lit(None).cast("binary").alias(c) for c in ("n", "best")))
    rows = first.unionByName(rest).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "key")  # nulls come first
    return rows.mapInArrow(tidied(run), "key long, n_best long, count_sum long")


def aligned(docs: DataFrame, byte_level: str, pieces: str, stripes: int = STRIPES, spread: int = 16, chunks: int = 256) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of occurrences within groups), n_best (links
    whose pair no other pair of its A id is in more documents than), count_sum (documents of each link's pair, added up),
    groups_sha256 (of the groups written as a1,a2|b1;a3|b2,b3).

    byte_level: a tokenizer file of byte-level tokens (A), which gets a space and the text; pieces: a model of pieces (B), which
    adds the space itself. Special strings in texts are text. A null or empty text, and one whose bytes either side does not give
    back, has no tokens: zeros, and an empty string for the digest. Repeated rows are documents each; a null doc_id stays null;
    other columns are left out. No documents: no rows.

    Texts are tokenized once, and written with their links as numbers of one or two bytes. A task holds a chunk of texts, a
    stripe's matrix (vocabulary A / stripes x vocabulary B numbers of 8 bytes), or a stripe's counts and one chunk's links.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = durable(tokenized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), byte_level, pieces, stripes), by="kind")
    links = rows.where("kind = 1").select("key", "stripe", "size", "docs", "a", "b", "times")
    best = durable(best_counts(merged_counts(partial_counts(links, spread)), byte_level, pieces, stripes))
    n = links.select("key").distinct().count()
    parts = max(1, math.ceil(n / chunks), math.ceil(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) / stripes))
    sums = durable(link_sums(links, best, parts).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    dropped(rows, part="kind=1")
    dropped(best)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.where("kind = 0").select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
