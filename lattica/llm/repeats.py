"""Fixed-length windows that occur in a document with a smaller id, found through anchors.

Every window of `length` units owns one anchor: the least hash among its stretches of `part` units. Neighbouring windows mostly
share it, and a maximal row of neighbours that do is a run, about (length - part) / 2 windows long. Equal windows have equal
anchors, so an anchor seen once proves all its windows unique, and windows need to be compared only where anchors agree:

- runs with an equal anchor and equal content belong to the smallest id that has one; in all others every window is repeated;
- of each distinct run, only that owner's copy remains; where an anchor has several distinct runs, their windows are compared
  one by one.

So a passage that thousands of documents share costs a short row for each copy, and its windows are looked at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, durable, merged, mixed, sliding_min, text_chunks, tidied
from .sketch import Sketch

SECOND = 0xD1342543DE82EF95
OTHER = 0xAEF17502108EF2D9  # a base for contents; odd
EXPLODED = 100_000  # windows handled at once, here and there
RUNS = "doc_id long, fp long, start long, n long, anchor long, run long"


@dataclass
class Runs:
    """Runs of a chunk of documents; row: which of them, at: the place in the chunk, start: the place in the document."""

    row: np.ndarray
    at: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    rolling: Rolling


def grams_of(values: np.ndarray, part: int) -> tuple[Rolling, np.ndarray]:
    """The hashes that anchors are chosen from."""
    rolling = Rolling(values)
    return rolling, mixed(rolling.windows(part))


def runs_of(values: np.ndarray, counts: np.ndarray, length: int, part: int, skip: np.ndarray | None = None, grams: tuple | None = None) -> Runs:
    """The runs of a chunk. Windows where `skip` is true, by their starts in the chunk, are left out."""
    begins = np.cumsum(counts) - counts
    rolling, hashes = grams or grams_of(values, part)
    windows = np.maximum(counts - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = start + begins[row]
    if skip is not None:
        keep = ~skip[at]
        row, start, at = row[keep], start[keep], at[keep]
    if not len(row):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, np.zeros(0, np.uint64), rolling)
    least = sliding_min(hashes, length - part + 1)[at]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
    n = np.diff(np.append(first, len(at)))
    return Runs(row[first], at[first], start[first], n, least[first], rolling)


def find_runs(docs: DataFrame, values_of: Callable[[list], tuple[np.ndarray, np.ndarray]], body_of: Callable, length: int, part: int, sketch, chunk: int, kind: str = "body binary") -> DataFrame:
    """Runs of all rows of docs (doc_id, text, fp, and spans to leave out) whose anchor may be repeated; body_of(runs, hashes, kept)
    gives one more column, of the name and type `kind`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Sketch = sketch.value
        for batch, texts in text_chunks(batches, limit=chunk):
            values, counts = values_of(texts)
            skip = None
            if "spans" in batch.schema.names:  # windows that are known to be repeated
                skip = np.zeros(len(values), bool)
                for begin, gone in zip((np.cumsum(counts) - counts).tolist(), covered(batch.column("spans"), 1)):
                    for a, b in gone:
                        skip[begin + a : begin + b] = True
            r = runs_of(values, counts, length, part, skip)
            keep = np.flatnonzero(seen.reached(r.anchor))
            if not len(keep):
                continue
            at, n = r.at[keep], r.n[keep]
            second = Rolling(values, OTHER)  # anchors and contents by independent hashes
            content = mixed(second.spans(at, at + n + length - 1), SECOND) + n.astype(np.uint64)
            doc, fp = (batch.column(c).take(pa.array(r.row[keep])) for c in ("doc_id", "fp"))
            yield pa.RecordBatch.from_arrays(
                [doc, fp, pa.array(r.start[keep]), pa.array(n), pa.array(r.anchor[keep].view(np.int64)), pa.array(content.view(np.int64)), pa.array(body_of(r, second, keep))],
                ["doc_id", "fp", "start", "n", "anchor", "run", kind.split()[0]],
            )

    return docs.mapInArrow(tidied(run), f"{RUNS}, {kind}")


def exploded(rows: DataFrame, windows_of: Callable[[bytes, int], np.ndarray]) -> DataFrame:
    """A row for each window of each run: doc_id, fp, pos, anchor, window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(whole.column("n").to_numpy())
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + EXPLODED, side="right")))
                batch, a = whole.slice(a, b - a), b
                n = batch.column("n").to_numpy()
                parts = [windows_of(body.as_py(), k) for body, k in zip(batch.column("body"), n.tolist())]
                row = pa.array(np.repeat(np.arange(len(n)), n))
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = batch.column("start").to_numpy()[row.to_numpy()] + inside
                arrays = [batch.column("doc_id").take(row), batch.column("fp").take(row), pa.array(pos), batch.column("anchor").take(row), pa.array(np.concatenate(parts).view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "fp", "pos", "anchor", "window"])

    return rows.select("doc_id", "fp", "start", "n", "anchor", "body").mapInArrow(tidied(run), "doc_id long, fp long, pos long, anchor long, window long")


def covered(spans: pa.Array, length: int) -> list[list[tuple[int, int]]]:
    """For each list of spans (null: none) the disjoint [start, end) that windows of `length` units starting in them cover."""
    flat = pc.list_flatten(spans)
    start, n = (flat.field(c).to_numpy() for c in ("start", "n"))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
    return [merged(start[a:b], n[a:b] + length - 1) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def owned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys also come with a smaller doc_id, the owner. Minima are taken before the shuffle; they are written, so
    that the join deals both sides out anew and can split a key with very many rows."""
    first = rows.groupBy(*keys).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    return rows.join(durable(first.drop("last")), keys).where("owner < doc_id")
