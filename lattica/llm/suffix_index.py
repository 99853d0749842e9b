"""Suffix-array dedup with a logarithmic family of indexes.

The arrays are sparse: of a text's suffixes they hold those that start at anchors, chosen by content so that every window of
`length` bytes contains one at the same place wherever the window occurs (the least hash among the window's stretches of `part`
bytes, the leftmost of equal ones). A suffix is held as far as its anchor's windows reach, with the bytes before it that they
reach back to, so two suffixes show every window that they have in common. An array is sorted by the suffixes' bytes, from the
anchor on, then by the bytes before.

Documents come in batches, in the order of their ids. The sorted order is cut into shards by splitters, strings taken from a
sample of the text, and a shard of an array is a row or a few: its sorted suffixes, one after the other. For a batch, every
shard's new suffixes are sorted and merged with the same shard of every level of the index; suffixes that share an anchor are
then neighbours, and their windows are matched there. A window that a level has, or a smaller document of the batch, is
repeated. The batch's array becomes a level, and levels of equal size merge into one of twice the size, as when counting in
binary, within the same pass.

Documents are handled in chunks. A chunk sends each distinct suffix once, with the smallest and greatest document that has it,
and gets back owners of windows; its list of occurrences, which stays behind, then gives the repeated places. So a passage costs
a shard one suffix for a chunk, however many documents have it. Anchors that the corpus has very often, in ever new surroundings,
would pile up suffixes in one place of the order; of those every window is a suffix of its own, which equal ones collapse into.
A count-min sketch, merged over all tasks, leaves out anchors that occur once and tells the very frequent ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch as sketches
from .common import BASE, Rolling, dropped, durable, fresh, keyed, mixed, powers, sliding_min, small_batches, table, text_chunks, tidied, utf8, worker_cache
from .repeats import SECOND, covered

PART = 20  # bytes of an anchor
SEGMENT = 1 << 16  # window starts looked at together
PLACE = np.uint64((1 << 17) - 1)  # bits of a place in a segment
NONE = np.uint64((1 << 64) - 1)
SLICE = 400_000  # windows matched together, or suffixes of a chunk
PLACES = 20_000  # occurrences in a row, or a document's
LEAST = 32  # windows that a suffix counts as at least
BLOCK = 1 << 20  # bytes of suffixes in a row
ROW_GROUP = 16 << 20  # bytes in a row group of the tables with suffixes, which a reader holds whole
LEVEL_OWNER = np.iinfo(np.int64).min  # any document of a level is smaller than those of the batch
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(SECOND))


def anchors_of(data: np.ndarray, counts: np.ndarray, length: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts laid end to end, for each stretch of windows with one anchor: the first window's start, the number of
    windows, the anchor's place, and the anchor's hash. Windows don't cross texts; stretches are cut at multiples of SEGMENT."""
    if length > SEGMENT:
        raise ValueError("the length is too great")
    ends = np.cumsum(counts)
    edge = np.zeros(len(data) + 1, np.int8)
    if len(ends):
        np.add.at(edge, np.maximum(ends - counts, ends - length + 1), 1)
        np.add.at(edge, ends, -1)
    crossing = np.cumsum(edge, dtype=np.int8) > 0
    out = []
    for a in range(0, len(data) - length + 1, SEGMENT):
        hashes = mixed(Rolling(_BYTES[data[a : a + SEGMENT + length - 1]]).windows(part))
        keys = hashes & ~PLACE
        keys |= np.arange(len(keys), dtype=np.uint64)
        least = sliding_min(keys, length - part + 1)
        least = np.where(crossing[a : a + len(least)], NONE, least)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        n = np.diff(np.append(first, len(least)))
        keep = least[first] != NONE
        first, n = first[keep], n[keep]
        at = (least[first] & PLACE).astype(np.int64)
        out.append((first + a, n, at + a, hashes[at]))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    return tuple(map(np.concatenate, zip(*out)))


def document_slices(row: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of row (the document of each suffix), whole documents at a time: up to `most` places, or one document's."""
    order = np.argsort(row, kind="stable")
    totals = np.cumsum(np.bincount(row))
    a = 0
    while a < len(order):
        b = int(totals[max(np.searchsorted(totals, a + most, side="right") - 1, row[order[a]])])
        yield order[a:b]
        a = b


class Shape:
    """How a suffix is laid out: `length` bytes from the anchor on, then the `back` bytes before it, in zeros where its windows don't
    reach. left: how many bytes before the anchor its first window starts; n: its windows."""

    def __init__(self, length: int, part: int):
        self.length, self.part, self.back = length, part, length - part
        self.width = length + self.back
        self.kind = np.dtype("<u1" if length < 256 else "<u4")

    def suffixes(self, data: np.ndarray, at: np.ndarray, left: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The rows for suffixes at places of data."""
        padded = np.concatenate([np.zeros(self.back, np.uint8), data, np.zeros(self.length, np.uint8)])
        right = np.lib.stride_tricks.sliding_window_view(padded[self.back :], self.length)[at]
        right[np.arange(self.length) >= (n - 1 + self.length - left)[:, None]] = 0
        if not self.back:
            return right
        before = np.lib.stride_tricks.sliding_window_view(padded, self.back)[at]
        before[np.arange(self.back) < (self.back - left)[:, None]] = 0
        return np.concatenate([right, before], axis=1)

    def ordered(self, rows: np.ndarray) -> np.ndarray:
        """The rows as strings, which compare as the suffixes do."""
        return np.ascontiguousarray(rows).view(f"S{self.width}").ravel()

    def windows(self, rows: np.ndarray, left: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row of each window, and two independent hashes of its bytes."""
        natural = np.concatenate([rows[:, self.length :], rows[:, : self.length]], axis=1)
        row = np.repeat(np.arange(len(n)), n)
        column = self.back - left[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hashes = []
        for salt, base in ((0, BASE), (SECOND, BASE ^ 0x5DEECE66C)):
            up, down = powers(self.width + 1, base)
            sums = np.zeros((len(rows), self.width + 1), np.uint64)
            np.cumsum((mixed(_BYTES, salt)[natural] * up[:-1]), axis=1, out=sums[:, 1:])
            hashes.append((sums[row, column + self.length] - sums[row, column]) * down[column])
        return row, *hashes


def numbers(column, kind=np.int64) -> np.ndarray:
    """A column of binaries that hold numbers, one after the other."""
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def sizes(column, width: int) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // width


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after the other, from rows that are sorted by it."""
    held, now = [], None
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and values[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


SUFFIXES = "batch int, shard int, chunk long, ids binary, suffixes binary, left binary, n binary, least binary, most binary, docs binary, fps binary, starts binary"
SURVEY = "block long, counts binary, sample binary"


def surveyed(docs: DataFrame, shape: Shape, bits: int, sparse: int) -> DataFrame:
    """One pass over the texts: the sketch's counters of anchors (block, counts), and the suffixes at one anchor in 2**sparse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("suffixes", dict)  # what another operator has left goes
        held: list[np.ndarray] = []
        names = [x.split()[0] for x in SURVEY.split(", ")]

        def counters() -> pa.RecordBatch:
            got = sketches.sparse(np.concatenate(held), bits, 2)
            held.clear()
            return pa.RecordBatch.from_arrays([got.column("block"), got.column("counts"), pa.nulls(got.num_rows, pa.binary())], names)

        for _, texts in text_chunks(batches):
            raw = [utf8(t) for t in texts]
            data = np.frombuffer(b"".join(raw), np.uint8)
            start, n, at, anchor = anchors_of(data, np.array(list(map(len, raw)), np.int64), shape.length, shape.part)
            few = np.flatnonzero(mixed(anchor, 5) >> np.uint64(64 - sparse) == 0) if sparse else np.arange(len(anchor))
            if len(few):
                sample = shape.suffixes(data, at[few], at[few] - start[few], n[few])[:, : shape.length]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([sample.tobytes()], pa.binary())], names)
            held.append(anchor)
            if sum(map(len, held)) >= sketches.HELD:
                yield counters()
        if sum(map(len, held)):
            yield counters()

    return docs.select("text").mapInArrow(tidied(run), SURVEY)


def chunk_suffixes(docs: DataFrame, shape: Shape, sketch, splitters, edges: list[int], chunk_bytes: int) -> DataFrame:
    """The suffixes of all rows of docs (doc_id, text, fp) at anchors that may occur twice. For each chunk and batch, a row of its
    distinct suffixes in each shard (ids: their numbers in the chunk), and rows (batch -1) of where they occur, PLACES or so and whole
    documents in each: ids and starts of the first windows; docs, fps and n (how many of the places) of the documents. A chunk with
    more than SLICE suffixes goes out as several."""
    names = [x.split()[0] for x in SUFFIXES.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 3)]

    def batch_of(lines: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: sketches.Sketch = sketch.value
        cuts: np.ndarray = splitters.value
        number = TaskContext.get().partitionId() << 31
        for part, texts in text_chunks(batches, limit=chunk_bytes):
            raw = [utf8(t) for t in texts]
            data = np.frombuffer(b"".join(raw), np.uint8)
            counts = np.array(list(map(len, raw)), np.int64)
            start, n, at, anchor = anchors_of(data, counts, shape.length, shape.part)
            keep = np.flatnonzero(seen.reached(anchor))
            start, n, at, anchor = start[keep], n[keep], at[keep], anchor[keep]
            dense = seen.very_frequent(anchor)
            if dense.any():  # each window is a suffix of its own
                each = np.repeat(np.flatnonzero(dense), n[dense])
                own = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[dense]) - n[dense], n[dense])
                start, at = np.concatenate([start[~dense], own]), np.concatenate([at[~dense], own])
                n = np.concatenate([n[~dense], np.ones(len(own), np.int64)])
                dense = np.arange(len(start)) >= len(start) - len(own)
            else:
                dense = np.zeros(len(start), bool)
            if not len(start):
                continue
            begins = np.cumsum(counts) - counts
            row = np.searchsorted(begins + counts, start, side="right")
            for some in document_slices(row, SLICE):
                yield from slice_lines(part, data, begins, row[some], start[some], n[some], at[some], dense[some], cuts, number)
                number += len(edges) + 1

    def slice_lines(part: pa.RecordBatch, data: np.ndarray, begins: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, at: np.ndarray, dense: np.ndarray, cuts: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
        left = at - start
        rows = shape.suffixes(data, at, left, n)
        ids = part.column("doc_id").to_numpy()
        doc, batch = ids[row], np.searchsorted(edges, ids[row]).astype(np.int32)
        # distinct suffixes of the chunk and batch
        words = np.zeros((len(rows), -(-shape.width // 8) * 8), np.uint8)
        words[:, : shape.width] = rows
        word = words.view("<u8")
        hashed = mixed(left.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64) << np.uint64(16), 1) + batch.astype(np.uint64)
        for k in range(word.shape[1]):
            hashed = mixed(hashed + word[:, k])
        order = np.argsort(hashed, kind="stable")
        new = np.ones(len(order), bool)
        x, y = order[1:], order[:-1]
        new[1:] = (hashed[x] != hashed[y]) | (batch[x] != batch[y]) | (left[x] != left[y]) | (n[x] != n[y]) | (word[x] != word[y]).any(1)
        first = np.flatnonzero(new)
        ident = np.empty(len(order), np.int32)
        ident[order] = np.cumsum(new) - 1
        one = order[first]
        least, most = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
        key = rows[one][:, : shape.length].copy()
        key[~dense[one], shape.part :] = 0  # suffixes that share an anchor go to one shard
        shard = np.searchsorted(cuts, key.view(f"S{shape.length}").ravel(), side="right")
        # a row for each batch and shard
        to = np.lexsort((shard, batch[one]))
        group = batch[one][to].astype(np.int64) << 32 | shard[to]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist()
        sorted_ = one[to]
        out = [to.astype("<i4"), rows[sorted_], left[sorted_].astype(shape.kind), n[sorted_].astype(shape.kind), least[to], most[to]]
        lines, held = [], 0
        for a, b in zip(begin, [*begin[1:], len(to)]):
            k, s = int(group[a] >> 32), int(group[a] & 0xFFFFFFFF)
            lines.append((k, s, number + k, *(x[a:b].tobytes() for x in out), None, None, None))
            held += (b - a) * shape.width
            if held >= BLOCK:
                yield batch_of(lines)
                lines, held = [], 0
        if lines:
            yield batch_of(lines)
        fps = part.column("fp").to_numpy()
        for k in np.unique(batch).tolist():
            of = np.flatnonzero(batch == k)
            of = of[np.argsort(row[of], kind="stable")]
            begin = np.flatnonzero(np.concatenate([[True], row[of][1:] != row[of][:-1]]))  # of each document
            end = np.append(begin[1:], len(of))
            cut = np.flatnonzero(np.concatenate([[True], begin[1:] // PLACES != begin[:-1] // PLACES])).tolist()
            for a, b in zip(cut, [*cut[1:], len(begin)]):
                o, one = of[begin[a] : end[b - 1]], of[begin[a:b]]
                starts = (start - begins[row])[o]
                yield batch_of([(-1, None, number + k, ident[o].tobytes(), None, None, (end - begin)[a:b].tobytes(), None, None, doc[one].tobytes(), fps[row[one]].tobytes(), starts.tobytes())])

    return docs.mapInArrow(tidied(run), SUFFIXES)


SCANNED = "kind int, shard int, chunk long, piece int, ids binary, suffixes binary, left binary, n binary, owners binary"


class SuffixIndex:
    """Levels of suffix arrays: level k has the suffixes of 2**k batches, or none. A level is a table with rows shard, piece, and
    suffixes, left and n: the shard's sorted distinct suffixes, cut into pieces."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.levels: dict[int, DataFrame] = {}
        self.files: dict[int, DataFrame] = {}  # the tables that the levels are parts of
        self.scanned: list[DataFrame] = []  # all tables that scans have written

    def scan(self, suffixes: DataFrame, keep: bool = True) -> DataFrame:
        """Merges a batch's suffixes with every level, shard by shard. Returns chunk, ids, left (window in the suffix), n (windows) and
        owners: the windows' smallest documents, where a smaller one than the chunk's greatest has them. With `keep` the batch
        becomes a level, merged with those of equal size."""
        free = next(k for k in range(64) if k not in self.levels)  # levels below merge with the batch into this one
        new = suffixes.select("shard", F.lit(-1).alias("level"), F.lit(0).alias("piece"), "chunk", "ids", "suffixes", "left", "n", "least", "most")
        every = new
        for k, level in self.levels.items():
            every = every.unionByName(level.select("shard", F.lit(k).alias("level"), "piece", "suffixes", "left", "n"), allowMissingColumns=True)
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_cache("suffixes", dict)
            for rows in by_key(batches, "shard"):
                yield from scan_shard(rows, shape, free if keep else -1)

        found = durable(every.repartition("shard").sortWithinPartitions("shard", "level", "piece").mapInArrow(tidied(run), SCANNED), by="kind", row_group=ROW_GROUP)
        self.scanned.append(found)
        if keep:
            for k in range(free):
                del self.levels[k]
                dropped(self.files.pop(k), part="kind=1")
            self.files[free] = found
            self.levels[free] = found.where("kind = 1").select("shard", "piece", "suffixes", "left", "n")
        return found.where("kind = 0").select("chunk", "ids", "left", "n", "owners")


def scan_shard(rows: pa.Table, shape: Shape, free: int) -> Iterator[pa.RecordBatch]:
    """One shard of a batch and of all levels, in the columns of SCANNED: kind 0, a row for each chunk that has a repeated window,
    and kind 1, the sorted suffixes of the batch and the levels below `free` (-1: none)."""
    level = np.repeat(rows.column("level").to_numpy(), count := sizes(rows.column("suffixes"), shape.width))
    text = numbers(rows.column("suffixes"), np.uint8).reshape(-1, shape.width)
    left, n = (numbers(rows.column(c), shape.kind).astype(np.int64) for c in ("left", "n"))
    n_new = int(np.count_nonzero(level < 0))  # the batch's rows come first
    owner = np.full(len(level), LEVEL_OWNER)
    new_rows = rows.filter(pc.less(rows.column("level"), 0))
    if n_new:
        owner[:n_new] = numbers(new_rows.column("least"))
        most = numbers(new_rows.column("most"))
        ids = numbers(new_rows.column("ids"), "<i4")
        chunk = np.repeat(new_rows.column("chunk").to_numpy(), count[: new_rows.num_rows])
    strings = shape.ordered(text)
    # the batch is sorted; levels are, so that the second sort only merges them
    sorted_new = np.argsort(strings[:n_new], kind="stable")
    merged = np.concatenate([sorted_new, np.arange(n_new, len(level))])
    order = merged[np.argsort(strings[merged], kind="stable")]
    del strings
    text, left, n = text[order], left[order], n[order]
    same_anchor = (text[1:, : shape.part] == text[:-1, : shape.part]).all(1)
    # suffixes with equal bytes have differing reaches only where the texts have zeros; those are neighbours all the same
    equal = same_anchor & (text[1:] == text[:-1]).all(1) & (left[1:] == left[:-1]) & (n[1:] == n[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~equal]))
    suffix = np.cumsum(np.concatenate([[True], ~equal])) - 1  # of the distinct ones, for each row
    least = np.minimum.reduceat(owner[order], first)
    if free >= 0:
        own = np.maximum.reduceat((level[order] < free).astype(np.int8), first) > 0
        kept = first[own]
        step = max(1, BLOCK // shape.width)
        for piece, a in enumerate(range(0, len(kept), step)):
            k = kept[a : a + step]
            yield scanned(1, rows.column("shard")[0].as_py(), None, piece, None, text[k].tobytes(), left[k].astype(shape.kind).tobytes(), n[k].astype(shape.kind).tobytes(), None)
    if not n_new:
        return
    # owners of windows: of all of a suffix at once where its anchor has no other suffix, else window by window
    group = np.cumsum(np.concatenate([[True], ~same_anchor]))[first] - 1
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lone = np.repeat(np.diff(np.append(begins, len(group))) == 1, np.diff(np.append(begins, len(group))))
    spans = [(np.flatnonzero(lone), np.zeros(int(lone.sum()), np.int64), n[first[lone]], least[lone])]
    several = np.flatnonzero(~lone)
    total = np.cumsum(np.maximum(n[first[several]], LEAST))  # a suffix's bytes take memory too
    starts = np.flatnonzero(np.concatenate([[True], group[several][1:] != group[several][:-1]])) if len(several) else several
    a = 0
    while a < len(several):
        done = total[a - 1] if a else 0
        cut = starts[np.searchsorted(starts, np.searchsorted(total, done + SLICE), side="right") - 1] if total[-1] > done + SLICE else len(several)
        if cut <= a:  # one anchor's suffixes, which the frequent ones' bound keeps few
            after = np.searchsorted(starts, a, side="right")
            cut = starts[after] if after < len(starts) else len(several)
        these = several[a:cut]
        a = int(cut)
        at = first[these]
        row, one, two = shape.windows(text[at], left[at], n[at])
        near = np.argsort(one, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], (one[near][1:] != one[near][:-1]) | (two[near][1:] != two[near][:-1])]))
        of = np.empty(len(near), np.int64)
        of[near] = np.repeat(np.minimum.reduceat(least[these][row[near]], begin), np.diff(np.append(begin, len(near))))
        edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (of[1:] != of[:-1])]))
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
        spans.append((these[row[edge]], inside[edge], np.diff(np.append(edge, len(row))), of[edge]))
    of, window, length, owned_by = map(np.concatenate, zip(*spans))
    by = np.argsort(of, kind="stable")
    window, length, owned_by = window[by], length[by], owned_by[by]
    each = np.bincount(of, minlength=len(first))
    # to each of the batch's suffixes its stretches that have a smaller owner
    mine = np.flatnonzero(order < n_new)
    mine = mine[np.argsort(chunk[order[mine]], kind="stable")]
    own = suffix[mine]
    at = np.repeat((np.cumsum(each) - each)[own], each[own]) + np.arange(each[own].sum()) - np.repeat(np.cumsum(each[own]) - each[own], each[own])
    source = np.repeat(order[mine], each[own])
    smaller = owned_by[at] < most[source]
    at, source = at[smaller], source[smaller]
    if not len(at):
        return
    cuts = np.flatnonzero(np.concatenate([[True], chunk[source][1:] != chunk[source][:-1]])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(at)]):
        s, w = source[a:b], at[a:b]
        yield scanned(0, None, int(chunk[s[0]]), None, ids[s].tobytes(), None, window[w].astype(shape.kind).tobytes(), length[w].astype(shape.kind).tobytes(), owned_by[w].tobytes())


def scanned(*values) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [x.split()[0] for x in SCANNED.split(", ")])


def repeated_places(found: DataFrame, answers: DataFrame, shape: Shape) -> DataFrame:
    """doc_id, fp, spans (start and number of window starts, apart from each other): what the owners of windows mean at the chunks'
    occurrences."""
    places = found.where("batch = -1").select("chunk", F.lit(0).alias("kind"), "ids", "n", "docs", "fps", "starts")
    every = places.unionByName(answers.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, "chunk"):
            said = rows.filter(pc.equal(rows.column("kind"), 1))
            here = rows.filter(pc.equal(rows.column("kind"), 0))
            if not said.num_rows or not here.num_rows:
                continue
            ids, owner = numbers(said.column("ids"), "<i4"), numbers(said.column("owners"))
            window, n = (numbers(said.column(c), shape.kind).astype(np.int64) for c in ("left", "n"))
            order = np.argsort(ids, kind="stable")
            own, start = numbers(here.column("ids"), "<i4"), numbers(here.column("starts"))
            doc, fp = (np.repeat(numbers(here.column(c)), numbers(here.column("n"))) for c in ("docs", "fps"))
            each = np.bincount(ids, minlength=int(own.max()) + 1)
            at = order[np.repeat((np.cumsum(each) - each)[own], each[own]) + np.arange(each[own].sum()) - np.repeat(np.cumsum(each[own]) - each[own], each[own])]
            place = np.repeat(np.arange(len(own)), each[own])
            smaller = owner[at] < doc[place]
            at, place = at[smaller], place[smaller]
            if not len(at):
                continue
            other = np.concatenate([[True], (doc[place][1:] != doc[place][:-1]) | (fp[place][1:] != fp[place][:-1])])
            first, text = np.flatnonzero(other), np.cumsum(other) - 1
            # a document's stretches that meet become one
            begin = start[place] + window[at]
            far = int((begin + n[at]).max()) + 1
            begin += text * far
            near = np.argsort(begin, kind="stable")
            begin, end = begin[near], np.maximum.accumulate((begin + n[at])[near])
            edge = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
            begin, end = begin[edge], end[np.append(edge[1:], len(end)) - 1]
            spans = pa.StructArray.from_arrays([pa.array(begin % far), pa.array(end - begin)], ["start", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, np.arange(len(first) + 1) * far), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([pa.array(doc[place[first]]), pa.array(fp[place[first]]), lists], ["doc_id", "fp", "spans"])

    places = every.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(tidied(run), "doc_id long, fp long, spans array<struct<start: long, n: long>>")
    return places.groupBy("doc_id", "fp").agg(F.first("spans").alias("spans"))  # equal rows have equal places


def shard_splitters(sample: np.ndarray, seen: sketches.Sketch, shape: Shape, sparse: int, shard_bytes: int) -> np.ndarray:
    """Strings that cut the order into shards of about `shard_bytes` of suffixes, by the suffixes (from the anchor on) at one anchor in
    2**sparse. Those that the sketch leaves out weigh nothing, and those whose windows are suffixes of their own as many."""
    if not len(sample):
        return np.zeros(0, f"S{shape.length}")
    anchor = mixed((_BYTES[sample[:, : shape.part]] * powers(shape.part, BASE)[0]).sum(1, dtype=np.uint64))
    weight = seen.reached(anchor) * np.where(seen.very_frequent(anchor), (shape.back + 1) / 2, 1.0)
    strings, of = np.unique(np.ascontiguousarray(sample).view(f"S{shape.length}").ravel(), return_inverse=True)
    total = np.cumsum(np.bincount(of, weight))
    shards = int(min(1 << 20, max(1, math.ceil(total[-1] * (1 << sparse) * shape.width / shard_bytes))))
    return strings[np.unique(np.searchsorted(total, total[-1] * np.arange(1, shards) / shards))]


def repeated_bytes(docs: DataFrame, length: int, part: int, batches: int, shard_bytes: int, frequent: int, chunk_bytes: int) -> DataFrame:
    """doc_id, fp, spans: the windows of docs (doc_id, text, fp) that also start in a document with a smaller doc_id."""
    spark = docs.sparkSession
    shape = Shape(length, part)
    docs = docs.where("doc_id is not null")
    steps = F.percentile_approx("doc_id", F.array([F.lit(k / batches) for k in range(1, batches)]), 10_000) if batches > 1 else F.lit(None)
    size, steps = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), steps).first()
    edges = sorted(set(steps or []))
    bits = sketches.size_bits(size / 3)
    shards = int(min(1 << 20, max(1, math.ceil(size / shard_bytes))))
    sampled = max(0, int(math.log2(max(1.0, 2 * size / (length - part + 1) / (128 * shards)))))
    survey = durable(surveyed(docs, shape, bits, sampled))
    limit = frequent + int(8 * size / (length - part) / (1 << bits))  # above what a full sketch shows of any anchor
    seen = sketches.merged(survey.where("block is not null").select("block", "counts"), bits, 2, (2,), limit)
    sample = survey.where("sample is not null").select("sample").toArrow().column("sample")
    sample = np.frombuffer(b"".join(x.as_py() for x in sample), np.uint8).reshape(-1, length)
    splitters = spark.sparkContext.broadcast(shard_splitters(sample, seen, shape, sampled, shard_bytes))
    sketch = spark.sparkContext.broadcast(seen)
    found = durable(chunk_suffixes(docs, shape, sketch, splitters, edges, chunk_bytes), by="batch", row_group=ROW_GROUP)
    dropped(survey)
    index, answers = SuffixIndex(shape), None
    for k in range(len(edges) + 1):
        got = index.scan(found.where(F.col("batch") == k), keep=k < len(edges))
        dropped(found, part=f"batch={k}")
        answers = got if answers is None else answers.unionByName(got)
    places = durable(repeated_places(found, answers, shape))
    dropped(found, *index.scanned)
    return places


OPTIONS = {"batches": 4, "shard_bytes": 16 << 20, "frequent": 20_000, "chunk_bytes": 4 << 20}


def suffix_dedup(docs: DataFrame, length: int = 50, part: int = PART, **options) -> DataFrame:
    """Removes every byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

    Returns doc_id, fp, n_bytes, n_removed, n_spans, kept (binary: what is left of the text's UTF-8 bytes) and removed (maximal
    stretches of removed bytes as start and end). Strings are judged on the input and never cross documents; overlaps count. Null
    and empty texts have no bytes. Rows with one doc_id never remove from each other; a row with a null doc_id is kept whole and
    removes from none. Other columns are left out. No documents: no rows.

    Options (see OPTIONS): documents come in so many `batches` of about as many rows; every batch is scanned against all levels, so
    there are few. The order is cut into shards for each `shard_bytes` of suffixes; anchors that occur more often than `frequent`
    times or so have their windows as suffixes; chunks have `chunk_bytes` of text. None of them changes results.
    """
    small_batches(docs.sparkSession)
    docs = keyed(docs)
    spans = repeated_bytes(docs, length, part, **{**OPTIONS, **options})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            rows = []
            for text, gone in zip(texts, covered(batch.column("spans"), length)):
                raw = utf8(text)
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(raw), len(raw) - len(kept), len(gone), kept, [{"start": a, "end": b} for a, b in gone]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = map(pa.array, zip(*rows), kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), *columns], ["doc_id", "fp", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    joined = docs.join(spans, ["doc_id", "fp"], "left").select("doc_id", "fp", "text", "spans")
    return joined.mapInArrow(tidied(cut), "doc_id long, fp long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start: long, end: long>>")


def cut_repeats(docs: DataFrame, length: int = 50, part: int = PART, **options) -> DataFrame:
    """The rows of docs, all columns, with the repeated bytes (see suffix_dedup) cut out of text; n_chars, if there is such a
    column, follows. A character goes if one of its bytes does, so that what is left is text."""
    small_batches(docs.sparkSession)
    spans = repeated_bytes(keyed(docs), length, part, **{**OPTIONS, **options})
    own, ident, mark, gone_at = fresh(docs, "fp", "span_doc_id", "span_fp", "spans")
    spans = spans.toDF(ident, mark, gone_at)
    joined = docs.withColumn(own, F.xxhash64("text")).join(spans, (F.col("doc_id").cast("long") == F.col(ident)) & (F.col(own) == F.col(mark)), "left")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            for row, gone in enumerate(covered(batch.column(gone_at), length)):
                if gone:
                    raw = utf8(texts[row])
                    edges = [0, *(x for span in gone for x in span), len(raw)]
                    texts[row] = "".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2]))
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pc.cast(pc.utf8_length(columns["text"]), columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return joined.select(*names, gone_at).mapInArrow(tidied(cut), docs.schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
