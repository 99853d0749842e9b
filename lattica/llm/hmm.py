"""A hidden Markov language model of words, trained by Baum-Welch over all documents.

The commonest words are observed as themselves, all others through a bucket that their last bytes give; within a bucket a word
has its smoothed share of the training counts. So a text's probability is that of its observed sequence, summed over all state
sequences by the scaled forward recursion, times the shares of its rarer words. Every round of training maps the documents to
expected counts, which are added up slice by slice across all partitions; the driver sees sums of a fixed size only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, small_batches, table, text_chunks, tidied, utf8
from .jaccard import SMALL
from .quality import fold
from .words import add_sums, count_words, head_of, rows_outside, with_keys

END = b" "  # no word has a space
STRETCH = 256  # tokens of a training sequence; longer documents make several
SLICE = 64  # classes whose expected counts are added up together
TOKENS = 1_000_000  # handled at once


def tokens_of(text: str | None) -> list[bytes]:
    return [*utf8(text).translate(SMALL).split(), END]


class Classes(dict):
    """From words to classes: the `most` commonest to their own, others to one of `buckets` more."""

    def __init__(self, common: list[bytes], buckets: int):
        super().__init__({w: k for k, w in enumerate(common)})
        self.own, self.buckets = len(common), buckets
        self.size = self.own + buckets

    def bucket(self, word: bytes) -> int:
        return crc32(word[-3:]) % self.buckets

    def __missing__(self, word: bytes) -> int:
        return self.own + self.bucket(word)

    def __reduce__(self):
        return _classes, (list(self), self.buckets)


def _classes(common: list[bytes], buckets: int) -> Classes:
    return Classes(common, buckets)


@dataclass
class Hmm:
    """first: of a document's states, later: of a later stretch's, follow[a, b]: from state a to b, emit[class, state]."""

    first: np.ndarray
    later: np.ndarray
    follow: np.ndarray
    emit: np.ndarray


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences longest first: their order, and how many have a token of each number."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")


def log_likelihood(model: Hmm, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each whole sequence of classes (codes: one after the other), by the scaled forward recursion."""
    order, live = layout(lengths)
    begins = (np.cumsum(lengths) - lengths)[order]
    total = np.zeros(len(lengths))
    emit, into = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.follow.T)
    alpha = np.zeros((len(model.first), 0))
    for t, n in enumerate(live.tolist()):  # arrays have a row for each state
        seen = emit.take(codes[begins[:n] + t], axis=1)
        alpha = (into @ alpha[:, :n] if t else model.first[:, None]) * seen
        scale = alpha.sum(0)
        alpha /= scale
        total[:n] += np.log10(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def expected(model: Hmm, codes: np.ndarray, lengths: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over sequences: first and later states, transitions, emissions. start: whether a document begins there."""
    order, live = layout(lengths)
    begins, start = (np.cumsum(lengths) - lengths)[order], start[order]
    k, steps = len(model.first), len(live)
    emit, follow = np.ascontiguousarray(model.emit.T, np.float32), model.follow.astype(np.float32)
    into = np.ascontiguousarray(follow.T)
    at, seen, alpha = [], [], []  # for each step; arrays have a row for each state
    for t, n in enumerate(live.tolist()):
        at.append(codes[begins[:n] + t])
        own = emit.take(at[t], axis=1)
        x = into @ alpha[t - 1][:, :n] if t else np.where(start[:n], model.first[:, None], model.later[:, None]).astype(np.float32)
        x *= own
        scale = x.sum(0)
        x /= scale
        own /= scale
        seen.append(own)
        alpha.append(x)
    beta = np.ones((k, live[0] if steps else 0), np.float32)
    moved = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            ahead, m = seen[t + 1], live[t + 1]
            ahead *= beta[:, :m]
            moved += alpha[t][:, :m] @ ahead.T
            beta[:, :m] = follow @ ahead
        alpha[t] *= beta[:, : live[t]]  # now the states' probabilities
    where, none = np.concatenate([codes[:0], *at]), np.zeros((k, 0), np.float32)
    emitted = np.stack([np.bincount(where, np.concatenate([none[s], *(x[s] for x in alpha)]), len(model.emit)) for s in range(k)], 1)
    top = alpha[0] if steps else none
    start = start[: top.shape[1]]
    return top[:, start].sum(1, dtype=float), top[:, ~start].sum(1, dtype=float), moved * model.follow, emitted


def stretches(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the training sequences that documents make, and whether a document begins there."""
    parts = -(-lengths // STRETCH)
    out = np.full(parts.sum(), STRETCH)
    ends = np.cumsum(parts)
    out[ends - 1] = lengths - (parts - 1) * STRETCH
    start = np.zeros(len(out), bool)
    start[ends - parts] = True
    return out, start


def maximised(counts: tuple, share: np.ndarray) -> Hmm:
    """The model of most likelihood for the expected counts, with a little of the classes' overall shares in every state."""
    first, later, moved, emitted = counts
    emitted = emitted + 20 * share[:, None]
    norm = lambda x, axis=None: x / x.sum(axis, keepdims=True)
    return Hmm(norm(first + 1), norm(later + 1), norm(moved + 1, 1), norm(emitted, 0))


def read_codes(batches: Iterator[pa.RecordBatch], tokens: int = TOKENS) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of the table of codes, `tokens` or so at once: the rows, their codes and lengths."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("codes").nbytes // 2
        if size >= tokens:
            yield _codes(held)
            held, size = [], 0
    if held:
        yield _codes(held)


def _codes(held: list) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    rows = pa.Table.from_batches(held)
    data = [x.as_py() for x in rows.column("codes")]
    return rows, np.frombuffer(b"".join(data), "<u2"), np.array([len(x) // 2 for x in data], np.int64)


def train(coded: DataFrame, size: int, share: np.ndarray, states: int, rounds: int) -> Hmm:
    """Baum-Welch: `rounds` rounds over all training documents, from a fixed random start."""
    own = coded.where("trained").select("codes")
    random = np.random.default_rng(7)
    emit = share[:, None] * random.uniform(0.5, 1.5, (size, states))
    flat = np.full(states, 1 / states)
    model = Hmm(flat, flat, np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))
    if own.isEmpty():
        return model
    for _ in range(rounds):
        model = maximised(count_over(own, model), share)
    return model


def count_over(coded: DataFrame, model: Hmm) -> tuple:
    """Expected counts over all rows, added up across partitions in slices of the emissions, one by one for the rest."""
    size, k = model.emit.shape
    shared = coded.sparkSession.sparkContext.broadcast(model)
    edges = [*range(0, size, SLICE), size]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, codes, lengths in read_codes(batches):
            cut, start = stretches(codes, lengths)
            got = expected(shared.value, codes, cut, start)
            total = got if total is None else tuple(a + b for a, b in zip(total, got))
        if total is not None:
            head = np.concatenate([total[0], total[1], total[2].ravel()])
            parts = [head, *(total[3][a:b].ravel() for a, b in zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts) - 1), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                x = np.frombuffer(counts.as_py())
                total[at] = total[at] + x if at in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])

    kind = "slice long, counts binary"
    got = coded.mapInArrow(tidied(expect), kind).repartition("slice").mapInArrow(tidied(add), kind).toArrow()
    parts = {at: np.frombuffer(x.as_py()) for at, x in zip(got.column("slice").to_pylist(), got.column("counts"))}
    if not parts:
        return np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    head = parts[-1]
    return head[:k], head[k : 2 * k], head[2 * k :].reshape(k, k), np.concatenate([parts[i] for i in range(len(edges) - 1)]).reshape(size, k)


def score_texts(docs: DataFrame, trained, states: int = 8, rounds: int = 14, own_classes: int = 4096, buckets: int = 64, head_words: int = 1 << 18) -> DataFrame:
    """Scores every text of docs by a model of those for which the condition `trained` holds.

    Returns doc_id, fp, trained, n_tokens, n_known (tokens that training has seen), train_tokens, base_score (add-one unigram) and
    score (hidden Markov model), both log10 probabilities of the whole text and its end. Tokens are runs of characters other
    than ASCII white space, A-Z in small letters, then one end; null and empty texts are just the end. A null condition counts as
    not trained. Repeated rows are trained on and scored each; other columns are left out. No documents: no rows; nothing to
    train on: a base of probability 1 for every token and a uniform model. `head_words` words and their counts go to every task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("fp"), F.coalesce(trained, F.lit(False)).alias("trained"))
    counts = durable(with_keys(count_words(docs.where("trained"), tokens_of)))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = head_of(counts.select("word", "n"), [F.desc("n"), F.col("word")], head_words)
    common = head.column("word").to_pylist()
    known = dict(zip(common, np.log10(head.column("n").to_numpy() + 1.0).tolist()))
    own = [END, *(w for w in common[:own_classes] if w != END)][:own_classes]
    classes = Classes(own, buckets)
    n_head = dict(zip(common, head.column("n").to_pylist()))
    shared_known, shared_classes = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(classes)

    def bucket_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_classes.value
        n, v = np.zeros(own.buckets, np.int64), np.zeros(own.buckets, np.int64)
        for batch in batches:
            for word, count in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if word not in own:
                    b = own.bucket(word)
                    n[b] += count
                    v[b] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(own.buckets)), pa.array(n), pa.array(v)], ["bucket", "n", "v"])

    sums = counts.select("word", "n").mapInArrow(tidied(bucket_sums), "bucket long, n long, v long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    in_bucket, kinds_in = np.zeros(buckets), np.zeros(buckets)
    in_bucket[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    kinds_in[sums.column("bucket").to_numpy()] = sums.column("v").to_numpy()
    share = np.concatenate([[n_head.get(w, 0) for w in own], in_bucket]) + 1.0
    share /= share.sum()
    within = np.log10(in_bucket + kinds_in + 1)

    # a table by the words' ranks: their classes, and the logs of their counts (nothing where the end isn't among the commonest)
    ranks = {w: k for k, w in enumerate(common)}
    ranks.setdefault(END, len(ranks))
    class_of = np.fromiter(map(classes.__getitem__, ranks), np.int64, len(ranks))
    log_of = np.array([known.get(w, np.nan) for w in ranks])
    shared_ranks = spark.sparkContext.broadcast((ranks, class_of, log_of))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, class_of, log_of = shared_ranks.value
        of = shared_classes.value
        for batch, texts in text_chunks(batches):
            words = [tokens_of(text) for text in texts]
            sizes = np.array(list(map(len, words)), np.int64)
            begins = np.cumsum(sizes) - sizes
            words = list(chain.from_iterable(words))
            rank = np.fromiter(map(ranks.get, words, repeat(-1)), np.int64, len(words))
            codes, logs = class_of[rank], log_of[rank]
            rest = np.flatnonzero(rank < 0)
            codes[rest] = [of.own + of.bucket(words[k]) for k in rest.tolist()]
            logs[rest] = np.nan
            seen = ~np.isnan(logs)
            logs[~seen] = 0
            rare = np.where(codes < of.own, 0, logs - within[np.maximum(codes - of.own, 0)])
            data = codes.astype("<u2").tobytes()
            codes_of = [data[2 * a : 2 * (a + n)] for a, n in zip(begins.tolist(), sizes.tolist())]
            total, rare, seen = (np.add.reduceat(x, begins) for x in (logs, rare, seen.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("fp"), batch.column("trained"), pa.array(codes_of, pa.binary()), pa.array(seen), pa.array(total), pa.array(rare)],
                ["doc_id", "fp", "trained", "codes", "seen", "logs", "rare"],
            )

    coded = durable(docs.select("doc_id", "fp", "trained", "text").mapInArrow(tidied(code), "doc_id long, fp long, trained boolean, codes binary, seen long, logs double, rare double"))
    model = spark.sparkContext.broadcast(train(coded, classes.size, share, states, rounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, codes, lengths in read_codes(batches, 4 * TOKENS):  # a step for each token of the longest text, whatever their number
            likely = log_likelihood(model.value, codes, lengths)
            columns = [*(rows.column(c).combine_chunks() for c in ("doc_id", "fp", "trained", "seen", "logs")), pa.array(lengths), pa.array(likely + rows.column("rare").to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "trained", "seen", "logs", "n_tokens", "score"])

    scored = coded.mapInArrow(tidied(score), "doc_id long, fp long, trained boolean, seen long, logs double, n_tokens long, score double")
    # the rarer words' counts, by a join; a word that training has not seen finds none
    rare = rows_outside(docs, tokens_of, shared_known).join(counts.select("k1", "k2", F.col("n").alias("c")), ["k1", "k2"])
    rare = rare.groupBy("doc_id", "fp").agg(F.sum("n").cast("double").alias("more_seen"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    out = add_sums(durable(scored), rare)
    base = F.col("logs") + F.col("more_logs") - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))
    return out.select("doc_id", "fp", "trained", "n_tokens", (F.col("seen") + F.round("more_seen").cast("long")).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.col("more_logs")).alias("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
