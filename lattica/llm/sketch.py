"""A count-min sketch of 64-bit keys, built in pieces by the tasks and merged by counter range.

A task adds its keys to sparse counters and hands them out block by block (a block is a range of counters of one row); blocks
merge by saturating addition, each on its own. All that operators ask of the sketch is whether a key's count may have reached
one of a few limits, so a merged block becomes one bit a counter and limit. The estimate is never too low. The whole has a size
fixed by `bits` and `depth`, whatever the input: 2**bits * depth * len(limits) / 8 bytes, so it may be broadcast, beside the few
counters above one more limit, for very frequent keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, text_chunks, tidied

BLOCK = 16  # a block has 2**BLOCK counters
HELD = 4_000_000  # keys a task gathers before it hands counters out
MOST_BITS = 28


def counters(keys: np.ndarray, bits: int, row: int) -> np.ndarray:
    return mixed(keys, 0x5851F42D4C957F2D * (row + 1) & (1 << 64) - 1) >> np.uint64(64 - bits)


class Sketch:
    """Merged bits: planes[limit][row] is a bitmap over the counters; often[row] are the counters of very frequent keys."""

    def __init__(self, planes: np.ndarray, bits: int, often: list[np.ndarray]):
        self.planes, self.bits, self.often = planes, bits, often

    def very_frequent(self, keys: np.ndarray) -> np.ndarray:
        """True for each key whose count may be `frequent` or more (see merged)."""
        out = np.ones(len(keys), bool)
        for row, often in enumerate(self.often):
            at = counters(keys, self.bits, row)
            place = np.minimum(np.searchsorted(often, at), max(0, len(often) - 1))
            out &= often[place] == at if len(often) else False
        return out

    def reached(self, keys: np.ndarray, limit: int = 0) -> np.ndarray:
        """True for each key whose count may be the limit or more."""
        out = np.ones(len(keys), bool)
        for row in range(self.planes.shape[1]):
            at = counters(keys, self.bits, row)
            out &= (self.planes[limit, row][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def size_bits(expected: float, most: int = MOST_BITS) -> int:
    """Counters for the expected number of keys: twice as many or so, within 2**most."""
    return int(min(most, max(BLOCK, np.ceil(np.log2(max(2.0, 2 * expected))))))


def sparse(keys: np.ndarray, bits: int, depth: int) -> pa.RecordBatch:
    """A task's counters, a row for each block: block, counts."""
    blocks, data = [], []
    for row in range(depth):
        at = np.sort(counters(keys, bits, row))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.minimum(np.diff(np.append(first, len(at))), 65535).astype("<u2")
        at = at[first]
        block = (at >> np.uint64(BLOCK)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
        low = (at & np.uint64((1 << BLOCK) - 1)).astype("<u2")
        for a, b in zip(begins, [*begins[1:], len(at)]):
            blocks.append(row << (bits - BLOCK) | int(block[a]))
            step = low[a:b].copy()
            step[1:] -= low[a : b - 1]
            data.append(zlib.compress(step.tobytes() + count[a:b].tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], ["block", "counts"])


def merged(rows: DataFrame, bits: int, depth: int, limits: tuple[int, ...], frequent: int = 65535) -> Sketch:
    """The sketch of all tasks' counters. Counters stop at 65535, so that `frequent` counts as that at most."""
    frequent = min(frequent, 65535)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, now = np.zeros(1 << BLOCK, np.uint16), None

        def out() -> pa.RecordBatch:
            planes = [np.packbits(acc >= x, bitorder="little").tobytes() for x in limits]
            often = np.flatnonzero(acc >= frequent).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(planes)], pa.binary()), pa.array([often], pa.binary())], ["block", "bitmaps", "often"])

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counts")):
                if block != now:
                    if now is not None:
                        yield out()
                    now = block
                    acc[:] = 0
                raw = zlib.decompress(data.as_py())
                n = len(raw) // 4
                low = np.cumsum(np.frombuffer(raw, "<u2", n), dtype=np.uint16)
                acc[low] = np.minimum(acc[low].astype(np.uint32) + np.frombuffer(raw, "<u2", n, 2 * n), 65535)
        if now is not None:
            yield out()

    blocks = rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidied(merge), "block long, bitmaps binary, often binary").toArrow()
    width = 1 << (BLOCK - 3)
    planes = np.zeros((len(limits), depth, 1 << (bits - 3)), np.uint8)
    often: list[list[np.ndarray]] = [[] for _ in range(depth)]
    for block, data, above in zip(blocks.column("block").to_pylist(), blocks.column("bitmaps"), blocks.column("often")):
        row, at = block >> (bits - BLOCK), block & ((1 << (bits - BLOCK)) - 1)
        planes[:, row, at * width : (at + 1) * width] = np.frombuffer(data.as_py(), np.uint8).reshape(len(limits), width)
        often[row].append(np.frombuffer(above.as_py(), "<u2").astype(np.uint64) + np.uint64(at << BLOCK))
    return Sketch(planes, bits, [np.sort(np.concatenate([np.zeros(0, np.uint64), *x])) for x in often])


def build(docs: DataFrame, keys_of: Callable[[list], np.ndarray], bits: int, depth: int = 2, limits: tuple[int, ...] = (2,), chunk: int = 2 << 20) -> Sketch:
    """The sketch of keys_of(texts) over all rows of docs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, texts in text_chunks(batches, limit=chunk):
            held.append(keys_of(texts))
            if sum(map(len, held)) >= HELD:
                yield sparse(np.concatenate(held), bits, depth)
                held = []
        if sum(map(len, held)):
            yield sparse(np.concatenate(held), bits, depth)

    return merged(docs.select("text").mapInArrow(tidied(add), "block long, counts binary"), bits, depth, limits)


def of_keys(rows: DataFrame, column: str, bits: int, depth: int = 1, limits: tuple[int, ...] = (1,)) -> Sketch:
    """The sketch of a column of numbers; by default, which may occur at all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield sparse(np.concatenate(held), bits, depth)
                held = []
        if held:
            yield sparse(np.concatenate(held), bits, depth)

    return merged(rows.select(F.col(column).cast("long")).dropna().mapInArrow(tidied(add), "block long, counts binary"), bits, depth, limits)


def perhaps_in(rows: DataFrame, column: str, seen, wanted: bool = True) -> DataFrame:
    """The rows whose number may be in a sketch, a broadcast one, or else the others, which certainly aren't. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(seen.value.reached(batch.column(column).to_numpy().view(np.uint64)) == wanted))

    return rows.mapInArrow(tidied(run), rows.schema)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
