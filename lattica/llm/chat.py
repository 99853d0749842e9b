"""Chat formatting as prefix trees: what conversations share at their start is put out once.

A turn is formatted as a mark, the role, the text and an end mark; control strings inside roles and texts are broken up by a
backslash, reversibly. Conversations are sorted by their turns, so that those with common first turns lie side by side, and
neighbours are merged into a prefix tree of bounded size. A tree is emitted depth first: every node's tokens once, each token
with its position in its conversation (which goes on from the parent's end) and, for each node, the stretches of the tree's
tokens that it may attend to: its ancestors' and, causally, its own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied, worker_cache

TURN, END = "<|turn|>", "<|end|>"
#: Strings that mark structure in this or other common templates; none of them survives inside a text.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Doubles backslashes, then puts one after the first character of every control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cached_encoding(path: str):
    return worker_cache(f"encoding {path}", lambda: encoding(path))


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role and text in order) and path: a chain of hashes, equal for two conversations up to where they part."""
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = F.transform("turns", lambda t: F.substring(F.sha2(F.concat_ws("\n", t["role"], t["text"]), 256), 1, 16))
    return whole.select("conv_id", "turns", F.concat_ws("", own).alias("path"))


TREE = (
    "tree long, ids array<int>, positions array<int>, loss array<boolean>, "
    "nodes array<struct<parent: int, start: int, end: int, text_start: int, text_end: int, chars: int, attends: array<struct<start: int, end: int>>>>, "
    "leaves array<struct<conv_id: long, node: int>>"
)


class Tree:
    """A prefix tree being filled, depth first. Columns of nodes and leaves are lists of their own; tokens are stretches of ids."""

    def __init__(self, encode):
        self.encode = encode
        self.ids: list[int] = []
        self.parent: list[int] = []
        self.bounds: list[tuple[int, int, int, int]] = []  # start, text_start, text_end, end
        self.position: list[int] = []  # of a node's first token
        self.learned: list[bool] = []
        self.chars: list[int] = []
        self.attends: list[list[tuple[int, int]]] = []
        self.leaves: list[tuple[int | None, int]] = []
        self.branch: list[tuple[tuple[str, str], int]] = []  # the last conversation's turns and their nodes
        self.heads: dict[str, tuple[int, list[int]]] = {}
        self.tail = encode(f"{END}\n")

    def add(self, conv: int | None, keys: list[tuple[str, str]]) -> None:
        common = 0
        while common < min(len(keys), len(self.branch)) and keys[common] == self.branch[common][0]:
            common += 1
        del self.branch[common:]
        for key in keys[common:]:
            self.branch.append((key, self.node(*key)))
        self.leaves.append((conv, self.branch[-1][1] if self.branch else -1))

    def node(self, role: str, text: str) -> int:
        parent = self.branch[-1][1] if self.branch else -1
        if role not in self.heads:
            head = f"{TURN}{escape(role)}\n"
            self.heads[role] = len(head), self.encode(head)
        size, head = self.heads[role]
        body = escape(text)
        start = len(self.ids)
        self.ids += head
        text_start = len(self.ids)
        self.ids += self.encode(body)
        text_end = len(self.ids)
        self.ids += self.tail
        end = len(self.ids)
        attends = list(self.attends[parent]) if parent >= 0 else []
        if attends and attends[-1][1] == start:
            attends[-1] = attends[-1][0], end  # the parent's own tokens lie just before
        else:
            attends.append((start, end))
        self.position.append(self.position[parent] + self.bounds[parent][3] - self.bounds[parent][0] if parent >= 0 else 0)
        self.parent.append(parent)
        self.bounds.append((start, text_start, text_end, end))
        self.learned.append(role == "assistant")
        self.chars.append(size + len(body) + len(END) + 1)
        self.attends.append(attends)
        return len(self.parent) - 1

    def row(self, ident: int) -> pa.RecordBatch:
        bounds = np.array(self.bounds, np.int64).reshape(-1, 4)
        n = bounds[:, 3] - bounds[:, 0]
        positions = np.arange(len(self.ids)) - np.repeat(bounds[:, 0], n) + np.repeat(self.position, n)
        cuts = np.concatenate([bounds[:, 1:3], bounds[:, 3:]], axis=1)
        marks = np.stack([np.zeros(len(n), bool), np.array(self.learned, bool), np.zeros(len(n), bool)], 1)
        loss = np.repeat(marks.ravel(), np.diff(cuts, axis=1, prepend=bounds[:, :1]).ravel())
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        small = lambda x: pa.array(x, pa.int32())
        ends = np.cumsum([0, *map(len, self.attends)])
        flat = np.array([s for x in self.attends for s in x], np.int64).reshape(-1, 2)
        spans = pa.ListArray.from_arrays(small(ends), pa.StructArray.from_arrays([small(flat[:, 0]), small(flat[:, 1])], ["start", "end"]))
        nodes = pa.StructArray.from_arrays([small(self.parent), small(bounds[:, 0]), small(bounds[:, 3]), small(bounds[:, 1]), small(bounds[:, 2]), small(self.chars), spans], ["parent", "start", "end", "text_start", "text_end", "chars", "attends"])
        leaves = pa.StructArray.from_arrays([pa.array([c for c, _ in self.leaves], pa.int64()), small([n for _, n in self.leaves])], ["conv_id", "node"])
        columns = [pa.array([ident], pa.int64()), one(small(self.ids)), one(small(positions)), one(pa.array(loss)), one(nodes), one(leaves)]
        return pa.RecordBatch.from_arrays(columns, ["tree", "ids", "positions", "loss", "nodes", "leaves"])


def format_trees(rows: DataFrame, vocabulary: str, tree_tokens: int = 65_536, tree_leaves: int = 1_024) -> DataFrame:
    """Prefix trees over conversations (conv_id, turn, role, text; a row is a turn).

    Returns a row for each tree: tree (a unique id), ids, positions and loss (a value for each token; loss marks the tokens of
    assistants' texts), nodes (depth first: parent, or -1; its tokens start to end; its text's tokens text_start to text_end; its
    characters; the stretches of tokens it attends to, its own last and causal) and leaves (conv_id and its last node). A tree
    is closed once it has `tree_tokens` tokens or `tree_leaves` conversations; the next one repeats the nodes they share.
    Turns are in order of turn (null first), then role and text; repeated rows are repeated turns; null roles and texts are
    empty; a row with a null conv_id is a conversation of its own. Other columns are left out. No rows: none. A conversation is handled
    in one task, so it must fit there; groups of equal or similar conversations are split between tasks.
    """
    whole = conversations_of(rows)
    ordered = whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached_encoding(vocabulary).encode_ordinary
        tree, ident = Tree(encode), TaskContext.get().partitionId() << 32
        for batch in batches:
            flat = pc.list_flatten(batch.column("turns"))
            keys = list(zip(flat.field("role").to_pylist(), flat.field("text").to_pylist()))
            ends = np.cumsum(pc.list_value_length(batch.column("turns")).to_numpy()).tolist()
            for conv, a, b in zip(batch.column("conv_id").to_pylist(), [0, *ends], ends):
                tree.add(conv, keys[a:b])
                if len(tree.ids) >= tree_tokens or len(tree.leaves) >= tree_leaves:
                    yield tree.row(ident)
                    tree, ident = Tree(encode), ident + 1
        if tree.leaves:
            yield tree.row(ident)

    return ordered.select("conv_id", "turns").mapInArrow(tidied(build), TREE)


def read_back(trees: DataFrame, vocabulary: str) -> DataFrame:
    """Every conversation as its tree has it: conv_id, turns (role and text), loss_text (the unescaped text under the loss mask)
    and formatted_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = cached_encoding(vocabulary).decode_bytes
        turn = re.compile(re.escape(TURN) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)
        said = pa.struct([("role", pa.string()), ("text", pa.string())])
        for batch in batches:
            for row in range(batch.num_rows):
                ids, loss, nodes, leaves = (batch.column(c)[row].values for c in ("ids", "loss", "nodes", "leaves"))
                ids, loss = ids.to_numpy(), loss.to_numpy(zero_copy_only=False)
                parents = nodes.field("parent").to_pylist()
                roles, texts, learned, chars = [], [], [], []
                for a, b in zip(nodes.field("start").to_pylist(), nodes.field("end").to_pylist()):
                    own, mask = ids[a:b], loss[a:b]
                    whole = decode(own.tolist()).decode()
                    role, text = turn.fullmatch(whole).groups()
                    roles.append(unescape(role))
                    texts.append(unescape(text))
                    learned.append(unescape(decode(own[mask].tolist()).decode()) if mask.any() else "")
                    chars.append(len(whole))
                paths = []
                for n in leaves.field("node").to_pylist():
                    path = []
                    while n >= 0:
                        path.append(n)
                        n = parents[n]
                    paths.append(path[::-1])
                flat = pa.array([n for p in paths for n in p], pa.int32())
                ends = pa.array(np.cumsum([0, *map(len, paths)]), pa.int32())
                turns = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(roles, pa.string()).take(flat), pa.array(texts, pa.string()).take(flat)], ["role", "text"]))
                columns = [leaves.field("conv_id"), turns.cast(pa.list_(said)), pa.array(["".join([learned[n] for n in p]) for p in paths], pa.string()), pa.array([sum(chars[n] for n in p) for p in paths], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turns", "loss_text", "formatted_chars"])

    return trees.select("ids", "loss", "nodes", "leaves").mapInArrow(tidied(read), "conv_id long, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(format_trees(rows, path), path)
    as_text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(as_text, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
