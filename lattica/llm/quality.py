"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's evidence comes from what it is made of (shares of letters, capitals, digits, marks
and symbols, lengths, repeated lines and words) and from the same of the lines before and after it; the chain adds what follows
what. Marginals from forward-backward, weighted by the lines' lengths, give the document's share of good text, which a last
step turns into a probability. Labels are known for documents only, so in training all lines bear their document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_chunks, tidied, utf8

#: Kinds of bytes; a byte of no kind here is "other".
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "!?", ".,;:", "|", "#$%&*^~", "<>=+@_/\\", "()[]{}\"'`-")
OTHER, BEYOND = len(KINDS), len(KINDS) + 1
_KIND = np.full(256, OTHER, np.uint8)
for _k, _chars in enumerate(KINDS):
    _KIND[list(_chars.encode())] = _k
_KIND[128:] = BEYOND
N_KINDS = BEYOND + 1
RAW = N_KINDS + 4
STEPS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
N_FEATURES = 3 * RAW * len(STEPS) + 3
LINES = 20_000  # lines whose features are held at once
LONG = 5_000  # lines of a document that are more steps than a chain should take one by one


def lines_of(texts: list) -> tuple[list[bytes], np.ndarray]:
    """The lines of all texts (a null or empty text has one empty line), and how many each has."""
    own, counts = [], []
    for text in texts:
        parts = utf8(text).split(b"\n")
        own += parts
        counts.append(len(parts))
    return own, np.array(counts, np.int64)


def raw_blocks(own: list[bytes], counts: np.ndarray) -> Iterator[np.ndarray]:
    """RAW values from 0 to 1 for every line, some thousand lines at a time."""
    at, ends = 0, np.cumsum(counts).tolist()
    text, seen = 0, set()
    while at < len(own):
        block = own[at : at + LINES]
        if sum(map(len, block)) > 4 << 20 and len(block) > 64:
            block = block[: max(1, len(block) // 64)]
        extra = np.zeros((len(block), 4))
        for k, x in enumerate(block):
            if at + k == ends[text]:
                text, seen = text + 1, set()
            words = x.split()
            if words:
                extra[k, 0] = x in seen
                extra[k, 1] = 1 - len(set(words)) / len(words)
                extra[k, 2] = min(1.0, len(x) / len(words) / 20)
                seen.add(x)
        data = np.frombuffer(b"\n".join([*block, b""]), np.uint8)
        breaks = np.flatnonzero(data == 10)
        lengths = np.diff(np.concatenate([[-1], breaks])) - 1
        line = np.repeat(np.arange(len(block)), lengths + 1)
        kinds = np.bincount(line * (N_KINDS + 1) + np.where(data == 10, N_KINDS, _KIND[data]), minlength=len(block) * (N_KINDS + 1)).reshape(-1, N_KINDS + 1)[:, :N_KINDS]
        extra[:, 3] = np.minimum(1.0, np.log2(lengths + 1) / 14)
        yield np.concatenate([kinds / np.maximum(lengths, 1)[:, None], extra], axis=1).astype(np.float32)
        at += len(block)


def passed(raw: np.ndarray) -> np.ndarray:
    """Which steps each value of a line passes: the line's features, and those of its two neighbours."""
    return (raw[:, :, None] > STEPS).reshape(len(raw), -1).astype(np.float32)


def edges_of(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of n lines is its text's first, and its last."""
    ends = np.cumsum(counts)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[ends - counts] = True
    last[ends - 1] = True
    return first, last


def evidence(weights: np.ndarray, blocks: Iterator[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """For good over bad, of every line. blocks: what the lines have passed; weights are for a line's own, for its neighbours
    before and after, for a first line, a last line, and one for all. No block of features is copied for the neighbours."""
    tables = weights[:-3].reshape(3, -1).T.astype(np.float32)
    own, before, after = np.concatenate([np.zeros((0, 3), np.float32), *(x @ tables for x in blocks)]).T.astype(float)
    first, last = edges_of(counts, len(own))
    own[1:] += np.where(first[1:], 0, before[:-1])
    own[:-1] += np.where(last[:-1], 0, after[1:])
    return own + first * weights[-3] + last * weights[-2] + weights[-1]


@dataclass
class Crf:
    """weights: the evidence for good over bad; follow[a, b]: for label b after label a; a and b: from the share of good text to
    a probability."""

    weights: np.ndarray
    follow: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def chains(score: np.ndarray, lines: np.ndarray, follow: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Forward-backward over all documents at once, line by line: P(good) of each line, each document's log partition, and with
    `pairs` the expected counts of label pairs. Documents are sorted by length, so that a step touches only those that go on."""
    order = np.argsort(-lines, kind="stable")
    begins = (np.cumsum(lines) - lines)[order]
    n, steps = lines[order], int(lines.max(initial=0))
    live = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")  # documents with a line of this number
    at = np.concatenate([begins[: live[t]] + t for t in range(steps)]) if steps else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(live)])
    emit = np.stack([np.zeros(len(at)), score[at]], 1)
    alpha = np.empty_like(emit)
    for t in range(steps):
        a, b = offsets[t], offsets[t + 1]
        if t == 0:
            alpha[a:b] = emit[a:b]
        else:
            prev = alpha[offsets[t - 1] : offsets[t - 1] + live[t]]
            alpha[a:b] = emit[a:b] + np.logaddexp(prev[:, :1] + follow[0], prev[:, 1:] + follow[1])
    beta = np.zeros_like(emit)
    for t in range(steps - 2, -1, -1):
        a, m = offsets[t], live[t + 1]
        nxt = emit[offsets[t + 1] : offsets[t + 2]] + beta[offsets[t + 1] : offsets[t + 2]]
        beta[a : a + m] = np.logaddexp(nxt[:, :1] + follow[:, 0], nxt[:, 1:] + follow[:, 1])
    total = alpha + beta
    log_z = np.logaddexp(total[:, 0], total[:, 1])
    good = np.exp(total[:, 1] - log_z)
    out, z = np.empty(len(score)), np.empty(len(lines))
    out[at] = good
    z[order] = log_z[: len(order)]
    counts = None
    if pairs:
        counts = np.zeros((2, 2))
        for t in range(steps - 1):
            m = live[t + 1]
            x = alpha[offsets[t] : offsets[t] + m, :, None] + follow + (emit + beta)[offsets[t + 1] : offsets[t + 2], None, :]
            counts += np.exp(x - log_z[offsets[t] : offsets[t] + m, None, None]).sum(0)
    return out, z, counts


def long_chain(score: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """P(good) of each line of one long document, as chains gives it: the chain is cut into as many stretches as a stretch has
    lines, whose transfer matrices are made at once, then chained; so there are few steps, each over all stretches."""
    n = len(score)
    size = max(1, int(np.sqrt(n)))
    many = -(-n // size)
    step, weight = np.exp(follow - follow.max()), np.ones((many * size, 2))
    weight[:n, 1] = np.exp(np.clip(score, -300, 300))
    weight /= weight.max(1, keepdims=True)
    weight = weight.reshape(many, size, 2)

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.max(axis=tuple(range(1, x.ndim)), keepdims=True)

    if n:
        # what a stretch does to the states before its first line, then the states before each stretch
        whole = np.broadcast_to(np.eye(2), (many, 2, 2))
        for t in range(size):
            whole = scaled((whole @ step) * weight[:, t, None, :])
        before = np.ones((many, 2))
        now = weight[0, 0]  # no line comes before a document's first
        for t in range(1, size):
            now = (now @ step) * weight[0, t]
            now = now / now.max()
        for k in range(1, many):
            before[k] = now if k == 1 else before[k - 1] @ whole[k - 1]
            before[k] /= before[k].max()
        forward = np.empty((many, size))
        now = before
        for t in range(size):
            now = now @ step
            if t == 0:
                now[0] = 1
            now = np.maximum(scaled(now * weight[:, t]), 1e-300)
            forward[:, t] = np.log(now[:, 1]) - np.log(now[:, 0])
        # backwards: what follows a stretch's last line
        after = np.ones((many, 2))
        back = np.broadcast_to(np.eye(2), (many, 2, 2))
        live = np.arange(many * size).reshape(many, size) < n
        for t in range(size - 1, -1, -1):
            back = np.where(live[:, t, None, None], scaled((step * weight[:, t, None, :]) @ back), back)
        for k in range(many - 2, -1, -1):
            after[k] = back[k + 1] @ after[k + 1]
            after[k] /= after[k].max()
        out = np.empty((many, size))
        now = after
        for t in range(size - 1, -1, -1):
            odds = forward[:, t] + np.log(now[:, 1]) - np.log(now[:, 0])
            out[:, t] = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            now = np.maximum(np.where(live[:, t, None], scaled((now * weight[:, t]) @ step.T), now), 1e-300)
    return out.ravel()[:n]


def marginals(score: np.ndarray, lines: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """P(good) of each line; documents of very many lines are taken one by one."""
    long = lines > LONG
    if not long.any():
        return chains(score, lines, follow)[0]
    of = np.repeat(long, lines)
    out = np.empty(len(score))
    out[~of] = chains(score[~of], lines[~long], follow)[0]
    ends = np.cumsum(lines)
    for k in np.flatnonzero(long).tolist():
        out[ends[k] - lines[k] : ends[k]] = long_chain(score[ends[k] - lines[k] : ends[k]], follow)
    return out


def share_good(good: np.ndarray, lines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    begins = np.cumsum(lines) - lines
    weight = lengths + 1.0
    return np.add.reduceat(good * weight, begins) / np.add.reduceat(weight, begins)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


class Blocks:
    """Features of the training lines, kept where they are few and else made anew, some thousand lines at a time."""

    def __init__(self, raw: np.ndarray, lines: np.ndarray, kept: int = 100_000):
        self.parts = [raw[a : a + LINES] for a in range(0, len(raw), LINES)]
        self.cached = [passed(p) for p in self.parts] if len(raw) <= kept else None
        self.lines, (self.first, self.last) = lines, edges_of(lines, len(raw))

    def __iter__(self) -> Iterator[np.ndarray]:
        return iter(self.cached) if self.cached is not None else map(passed, self.parts)

    def evidence(self, weights: np.ndarray) -> np.ndarray:
        return evidence(weights, iter(self), self.lines)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """What the weights' gradient is for these values of the lines."""
        after, before = np.append(values[1:], 0), np.append(0, values)[: len(values)]
        three = np.stack([values, np.where(self.last, 0, after), np.where(self.first, 0, before)], 1).astype(np.float32)
        out, at = np.zeros((RAW * len(STEPS), 3)), 0
        for x in self:
            out += x.T @ three[at : at + len(x)]
            at += len(x)
        return np.concatenate([out.T.ravel(), [values[self.first].sum(), values[self.last].sum(), values.sum()]])


def fit(raw: np.ndarray, lines: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 80, penalty: float = 2.0) -> Crf:
    """Penalised maximum likelihood by adaptive gradient steps; always the same result for the same rows in the same order."""
    blocks = Blocks(raw, lines)
    y = np.repeat(labels, lines).astype(np.float32)
    inside = np.concatenate([np.full(max(0, n - 1), k) for k, n in zip(labels.tolist(), lines.tolist())]) if len(lines) else np.zeros(0)
    w, follow = np.zeros(N_FEATURES), np.zeros((2, 2))
    theta = np.concatenate([w, follow.ravel()])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.diag([np.count_nonzero(inside == 0), np.count_nonzero(inside == 1)]).astype(float)
    truth = blocks.summed(y)
    docs = max(1, len(lines))
    for t in range(1, rounds + 1):
        good, _, counts = chains(blocks.evidence(theta[:-4]), lines, theta[-4:].reshape(2, 2), pairs=True)
        gradient = np.concatenate([blocks.summed(good.astype(np.float32)) - truth, (counts - seen).ravel()]) / docs + penalty * theta / docs
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta = theta - 0.1 * (1 - t / (rounds + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    model = Crf(theta[:-4], theta[-4:].reshape(2, 2))
    good, _, _ = chains(blocks.evidence(model.weights), lines, model.follow)
    s = logit(share_good(good, lines, lengths)) if docs and len(lines) else np.zeros(0)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # logistic regression on one value, by Newton's method
        if not len(s):
            break
        p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -40, 40)))
        g, v = p - labels, p * (1 - p) + 1e-9
        h = np.array([[(v * s * s).sum() + 1, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * s).sum() + (slope - 1), g.sum()])
        slope, shift = slope - step[0], shift - step[1]
    model.slope, model.shift = max(1e-3, float(slope)), float(shift)
    return model


def score(model: Crf, texts: list) -> np.ndarray:
    own, lines = lines_of(texts)
    found = evidence(model.weights, map(passed, raw_blocks(own, lines)), lines)
    good = marginals(found, lines, model.follow)
    return 1 / (1 + np.exp(-np.clip(model.slope * logit(share_good(good, lines, np.fromiter(map(len, own), np.int64, len(own)))) + model.shift, -700, 700)))


def fold(ident: str, folds: int):
    """crc32 of an id's text, modulo folds."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, most_lines: int = 2000) -> Crf:
    """Fits the field on labelled documents: doc_id and quality 0 or 1 in labels, null ones left out. At most `most` labels are
    used, those with the smallest hashes of doc_id, and of their texts those of at most `most_lines` lines, so that what the
    driver gets is bounded by the two; with none, every score is one half."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(most)  # so it may be broadcast
    short = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) < most_lines
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").where(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            own, lines = lines_of(texts)
            raw = np.concatenate([np.zeros((0, RAW), np.float32), *raw_blocks(own, lines)])
            cut = np.cumsum(lines) - lines
            lengths = np.fromiter(map(len, own), "<i8", len(own))
            data = [x.astype("<f4").tobytes() for x in np.split(raw, cut[1:])]
            sizes = [x.tobytes() for x in np.split(lengths, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(data, pa.binary()), pa.array(sizes, pa.binary())], ["id", "label", "raw", "lengths"])

    got = rows.select("id", "label", "text").mapInArrow(tidied(run), "id long, label int, raw binary, lengths binary").orderBy("id", "label", "raw").toArrow()
    sizes = [np.frombuffer(x.as_py(), "<i8") for x in got.column("lengths")]
    raw = np.concatenate([np.frombuffer(x.as_py(), "<f4").reshape(-1, RAW) for x in got.column("raw")]) if sizes else np.zeros((0, RAW), np.float32)
    lines = np.array([len(x) for x in sizes], np.int64)
    if not len(lines):
        return Crf(np.zeros(N_FEATURES), np.zeros((2, 2)))
    return fit(raw, lines, np.concatenate(sizes), got.column("label").to_numpy().astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = 4000) -> DataFrame:
    """doc_id and score (0 to 1, higher: quality 1 likelier) for every row of docs, from whole texts and nothing else of the row.

    Null and empty texts are one empty line and have a score too. Repeated rows are scored each; other columns are left out. No
    documents: no rows. See train for the labels and the bound on how many are used.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(score(model, texts))], ["doc_id", "fp", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("fp"))
    return rows.mapInArrow(tidied(run), "doc_id long, fp long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = 4000) -> DataFrame:
    """The rows of docs, all columns, with a score of `least` or more; rows of any doc_id, null too. No shuffle."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, limit=1 << 20):
            yield batch.filter(pa.array(score(model, texts) >= least))

    return docs.mapInArrow(tidied(run), docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 5) == 0
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
