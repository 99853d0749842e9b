"""Token counts under a unigram model, computed once for every distinct pre-token, in a trie.

A pre-token's best segmentation maximises the sum of its pieces' log probabilities. The forward score of a prefix is the same in
all pre-tokens that begin with it, so the distinct pre-tokens go into a trie and every node is scored once from its ancestors;
a node where a pre-token ends stores its number of tokens. Sorted order is the trie's depth-first order: tasks get ranges of the
sorted distinct pre-tokens and keep only the path from the root to the present node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, small_batches, table, text_chunks, tidied, utf8, worker_cache
from .words import add_sums, count_words, head_of, rows_outside, with_keys

SPACE = "▁"  # stands for the white space before a word


def words_of(text: str | None) -> list[bytes]:
    """Pre-tokens: runs of characters other than ASCII white space, unchanged."""
    return utf8(text).split()


class Pieces:
    """Pieces with their log probabilities, in a trie from their last character to their first. The vocabulary file ranks its
    pieces, so the piece of rank r gets the probability of Zipf's law, in proportion to 1 / (r + 1). A character that no piece
    covers is one token for each of its bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        norm = math.log(sum(1 / (r + 1) for r in range(len(plain))))
        self.score = {model.id_to_piece(i): -math.log(r + 1) - norm for r, i in enumerate(plain)}
        self.byte = min(self.score.values()) - 1
        self.backwards: dict = {}
        for piece, own in self.score.items():
            node = self.backwards
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = own

    def step(self, text: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Forward score and number of tokens of text[:end], from those of its shorter prefixes; ties to fewer tokens."""
        size = len(text[end - 1].encode("utf-8", "replace"))
        top, count = best[end - 1] + size * self.byte, tokens[end - 1] + size
        node = self.backwards
        for start in range(end - 1, -1, -1):
            node = node.get(text[start])
            if node is None:
                break
            if "" in node:
                own = node[""] + best[start]
                if own > top or own == top and tokens[start] + 1 < count:
                    top, count = own, tokens[start] + 1
        return top, count


def pieces(path: str) -> Pieces:
    return worker_cache(f"pieces {path}", lambda: Pieces(path))


class Trie:
    """Walks the trie of sorted texts: scores of the nodes from the root to the present one."""

    def __init__(self, of: Pieces):
        self.of, self.text, self.best, self.tokens, self.scored = of, "", [0.0], [0], 0

    def terminal(self, text: str) -> tuple[int, float]:
        """Goes to the node of text, scoring only nodes that it does not share with the text before."""
        shared, most = 0, min(len(text), len(self.text))
        while shared < most and text[shared] == self.text[shared]:
            shared += 1
        del self.best[shared + 1 :], self.tokens[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            top, count = self.of.step(text, end, self.best, self.tokens)
            self.best.append(top)
            self.tokens.append(count)
            self.scored += 1
        self.text = text
        return self.tokens[-1], self.best[-1]


def pretoken_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Distinct pre-tokens of docs: word, n (occurrences), tokens and log_score, terminal values of the trie."""
    counts = count_words(docs, words_of)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pieces(vocabulary))
        for batch in batches:
            ends = [trie.terminal(SPACE + w.as_py().decode("utf-8", "replace")) for w in batch.column("word")]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends])], ["word", "n", "tokens", "log_score"])

    # as many ranges as shuffles have parts: the words are short, but each takes work, so ranges must not be joined by their bytes
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(ranges, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(tidied(walk), "word binary, n long, tokens long, log_score double")


def token_counts(docs: DataFrame, vocabulary: str, head_words: int = 1 << 18) -> DataFrame:
    """doc_id, fp, n_words (pre-tokens) and n_tokens of every row of docs, from whole texts.

    Null and empty texts have none. Repeated rows are counted each; a null doc_id stays null; other columns are left out. No
    documents: no rows. The `head_words` commonest pre-tokens and their counts go to every task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("fp"))
    known = durable(with_keys(pretoken_table(docs, vocabulary)))
    head = head_of(known.select("word", "n", "tokens"), [F.desc("n"), F.col("word")], head_words)
    shared = spark.sparkContext.broadcast(dict(zip(head.column("word").to_pylist(), head.column("tokens").to_pylist())))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value.get
        for batch, texts in text_chunks(batches):
            words = [words_of(t) for t in texts]
            sums = [sum(filter(None, map(look, w))) for w in words]  # no word has 0 tokens
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(list(map(len, words)), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "fp", "n_words", "tokens"])

    here = docs.select("doc_id", "fp", "text").mapInArrow(tidied(add), "doc_id long, fp long, n_words long, tokens long")
    rare = rows_outside(docs, words_of, shared).join(known.select("k1", "k2", F.col("tokens").alias("each")), ["k1", "k2"])
    rare = rare.groupBy("doc_id", "fp").agg(F.sum(F.col("n") * F.col("each")).cast("double").alias("more"))
    out = add_sums(durable(here), rare)
    return out.select("doc_id", "fp", "n_words", (F.col("tokens") + F.round("more").cast("long")).alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_words", "n_tokens")
