"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds documents longer than capacity/(k+1) and at most capacity/k, and a
bin of class k takes exactly k of them, whole. The last class has all documents of capacity/`classes` or less, as many as a bin
holds. Documents longer than the capacity have to be cut in any case: their pieces fill up the room that bins of all classes have
left, and what is left of them makes full sequences. Where a task has met too few of such documents and bins wait for pieces, it
cuts the next document instead. Every task fills the bins of its own rows: nothing is shuffled, and no task waits for another.
When a task ends, the pieces of its unfinished bins are put one after the other, cut at the capacity, and at powers of two in
the end.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_chunks, tidied, worker_cache

END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Pre-tokens of runs in small letters of the plain alphabet: the characters below U+0180, without controls and odd white space.
_PLAIN = [c for c in map(chr, range(0x180)) if c in "\t\n\r" or c.isprintable() and c not in "\xa0\u0130"]
_class = lambda kind: "".join(map(re.escape, (c for c in _PLAIN if unicodedata.category(c)[0] == kind)))
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")
OUTSIDE = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]|<\\|")  # "<|" may begin a special string
#: Names of bytes in byte-level vocabularies: printable ones are themselves, the others take the characters from U+0100 on.
_NAMED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _NAMED)}
PROBES = ("It's a test, isn't it?  12 34ab", "\u00c9t\u00e9 na\u00efve (x)--y!!", "a\tb\r\n c 'x' ''s", "# A_b \u00df\u0141\u00f3d\u017a 1/2 \u00b2")


class TokenIds(dict):
    """Little-endian 32-bit ids of runs of text without white space and of their pre-tokens, kept for the next time. Whether a
    tokenizer file allows that is tried out when it is loaded: `how` is "pretoken" where texts may be cut at white space, and runs
    of the plain alphabet by PRETOKEN in small letters, "run" where texts may be cut at white space only, else "whole"."""

    def __init__(self, path: str, most: int = 800_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        for how in ("pretoken", "run", "whole"):
            self.how = how
            self.clear()
            if all(self.text(x) == self.encoded(x) for x in PROBES):
                break

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, pretoken: str) -> bytes:
        """The model's ids alone, without the steps before it, which don't change a pre-token but for naming its bytes."""
        named = pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(BYTE_NAMES)
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def __missing__(self, run: str) -> bytes:
        if self.how == "pretoken" and not OUTSIDE.search(run):
            parts = PRETOKEN.findall(run.lower())
            ids = self.piece(run) if parts == [run] else b"".join(map(self.__getitem__, parts))
        else:
            ids = self.encoded(run) if run else b""
        if len(run) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[run] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.how == "whole":
            return self.encoded(text)
        runs = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, runs))


def token_ids(path: str) -> TokenIds:
    """One for a worker process, which runs many tasks."""
    return worker_cache(f"ids {path}", lambda: TokenIds(path))


class Bins:
    """The open bins of one task. A piece is (document, start, length, tokens of the document)."""

    def __init__(self, first_id: int, capacity: int, classes: int, waiting: int):
        self.next_id, self.capacity, self.classes, self.most = first_id, capacity, classes, waiting
        self.open: dict[int, tuple[list, int]] = {}  # of a class: pieces and their tokens
        self.waiting: deque = deque()  # bins with all their documents, which have room left
        self.spare: deque = deque()  # pieces of cut documents that no bin has asked for yet
        self.spared = 0

    def close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield (*piece, self.next_id, offset)
            offset += piece[2]
        self.next_id += 1

    def document(self, doc, total: int) -> Iterator[tuple]:
        """Takes a document of `total` tokens; yields the pieces of bins that are full now."""
        if total > self.capacity or len(self.waiting) > self.most and not self.spared:
            self.spare.append((doc, 0, total, total))
            self.spared += total
        else:
            kind = min(self.capacity // total, self.classes)
            pieces, size = self.open.get(kind, ([], 0))
            if size + total > self.capacity:  # of the last class only
                self.waiting.append((pieces, size))
                pieces, size = [], 0
            pieces.append((doc, 0, total, total))
            self.open[kind] = pieces, size + total
            if len(pieces) == kind < self.classes:
                self.waiting.append(self.open.pop(kind))
        while self.waiting and self.spared >= self.capacity - self.waiting[0][1]:
            pieces, size = self.waiting.popleft()
            yield from self.close(pieces + self.taken(self.capacity - size))
        while self.spared >= 2 * self.capacity:
            yield from self.close(self.taken(self.capacity))

    def taken(self, room: int) -> list:
        """So many tokens of the spare pieces."""
        out = []
        self.spared -= room
        while room:
            doc, start, length, total = self.spare.popleft()
            n = min(room, length)
            out.append((doc, start, n, total))
            room -= n
            if n < length:
                self.spare.appendleft((doc, start + n, length - n, total))
        return out

    def last(self) -> Iterator[tuple]:
        """Puts all that is left one after the other, without padding: full sequences, then powers of two."""
        left = [p for pieces, _ in [*self.waiting, *(self.open[k] for k in sorted(self.open))] for p in pieces]
        self.spare.extend(left)
        self.spared += sum(p[2] for p in left)
        self.waiting.clear()
        self.open.clear()
        while self.spared:
            yield from self.close(self.taken(min(self.capacity, 1 << (self.spared.bit_length() - 1))))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, classes: int = 64, waiting: int = 256, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` tokens (a power of two).

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the piece's ids. A document's tokens
    are the tokenizer's, then `end_id`. Null and empty texts have just `end_id`. Rows that repeat, also with one doc_id, are
    packed each on its own; a null doc_id stays null; other columns are left out. No rows: none. Sequences end full or at a
    power of two; sequence ids are unique, not gapless. Documents of at most `capacity` tokens stay whole, but for those that a
    task cuts while more than `waiting` bins have room and no longer document has come, and in its last bins.
    """
    if capacity & (capacity - 1) or not 1 <= classes <= capacity:
        raise ValueError("capacity is a power of two, and there are at most so many classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bins = token_ids(tokenizer), Bins(TaskContext.get().partitionId() << 33, capacity, classes, waiting)
        held: dict[int, list] = {}  # tokens of documents with pieces in open bins: [bytes, tokens not yet put out]
        end = np.uint32(end_id).astype("<u4").tobytes()
        rows: list[tuple] = []

        def put(piece: tuple) -> None:
            (doc, key), start, length, total, sequence, offset = piece
            own = held[key]
            part = own[0][4 * start : 4 * (start + length)]
            own[1] -= length
            if not own[1]:
                del held[key]
            rows.append((doc, start, length, zlib.crc32(part), total, sequence, offset, part))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                ends = np.zeros(len(rows) + 1, np.int32)
                np.cumsum(columns[2], out=ends[1:])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(columns[7]), "<i4"))))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        key = 0
        for part, texts in text_chunks(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), texts):
                tokens = ids.text(text) + end
                key += 1
                held[key] = [tokens, len(tokens) // 4]
                for piece in bins.document((doc, key), len(tokens) // 4):
                    put(piece)
            if rows:
                yield flush()
        for piece in bins.last():
            put(piece)
        if rows:
            yield flush()

    schema = SCHEMA + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidied(run), schema)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
