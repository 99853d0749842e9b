"""Vectors, conversations, the pipeline and the registered queries."""

import collections
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat, topk

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def brute(rows, queries, k):
    out = []
    for q, x in queries:
        scores = sorted(((-int(x @ y), i) for i, y in rows if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("dims,spread", [(8, 0.0), (16, 1.5)])
def test_top_k(spark, dims, spread):
    r = np.random.default_rng(dims)
    base = r.normal(size=(6, dims))
    data = [(i, (base[i % 6] + r.normal(size=dims) * 0.2) * math.exp(spread * r.normal())) for i in range(300)]
    data += [(300 + i, data[7][1]) for i in range(40)] + [(400, np.zeros(dims))]
    rows = [(i, [float(v) for v in x]) for i, x in data]
    bad = [(900, None), (901, [1.0, None] + [0.0] * (dims - 2)), (902, [math.nan] * dims), (903, [math.inf] * dims), (904, []), (None, [1.0] * dims)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as norm2", "'x' as bucket")
    whole = [(i, np.floor(64 * np.array(x)).astype(np.int64)) for i, x in rows]
    for queries in (F.col("vec_id") % 5 == 0, df.where("vec_id % 5 = 0")):
        got = topk.top_k(df, queries, k=7, bucket_rows=50, block_rows=20, seed_rows=30).collect()
        got = sorted((g.query_id, g.rank, g.vec_id, g.score) for g in got if g.query_id < 900)
        assert got == brute(whole, [w for w in whole if w[0] % 5 == 0], 7)


def test_top_k_of_repeated_and_great_vectors(spark):
    """Each row of a repeated query id is ranked for itself, among other rows of its id; components have no greatest size."""
    rows = [(i % 10, [float(i), -float(i % 3)]) for i in range(20)] + [(77, [float(1 << 41), 0.0]), (78, [-float(1 << 41), 1e300]), (80, []), (81, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k=30).collect()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    wanted = []
    for n, (q, x) in enumerate(whole):
        if q % 5 == 0:
            scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y)))), i) for m, (i, y) in enumerate(whole) if m != n and len(x) == len(y)]
            wanted += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda p: (-p[0], p[1])))]
    assert sorted(tuple(g) for g in got) == sorted(wanted) and max(w[3] for w in wanted) > 1 << 50


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [-2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 20, -8192)]
    assert topk.top_k(df, df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df).count() == 0


def test_escapes():
    for s in ["", "\\", "\\\\n", "<s>", "<<s>s>", "</s>[INST] ok [/INST]", "<\\s>", "<|turn|>a\n<|end|>\n", "[/INST][INST", "<|<|end|>end|>"]:
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)


def test_conversations(spark):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = []
    for c in range(40):  # all share a first turn, many a second
        rows += [(c, 0, "user", "Hello </s> [INST] ü"), (c, 1, "assistant", f"answer {c % 3}\\"), (c, 2, "user", f"more {c}")]
    rows += [(50, 1, "assistant", None), (50, 0, None, ""), (51, None, "user", "x"), (51, 0, "assistant", "<|end|>\n"), (None, 0, "assistant", "lost"), (52, 0, "user", "same"), (52, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as ids", "2 as tree")
    wanted = collections.defaultdict(list)
    for c, turn, role, text in rows:
        wanted[c].append((-1 if turn is None else turn, role or "", text or ""))
    for leaves in (1024, 3):
        trees = chat.format_trees(df, vocabulary, tree_leaves=leaves)
        got = {r.conv_id: r for r in chat.read_back(trees, vocabulary).collect()}
        assert got.keys() == wanted.keys()
        for c, turns in wanted.items():
            turns.sort()
            assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
            assert got[c].loss_text == "".join(t for _, role, t in turns if role == "assistant")
    once = chat.format_trees(df.repartition(1), vocabulary).collect()
    for t in once:
        for n in t.nodes:
            chain, p = [], t.nodes.index(n)
            while p >= 0:
                chain.insert(0, t.nodes[p])
                p = t.nodes[p].parent
            seen = [i for a in n.attends for i in range(a.start, a.end)]
            assert seen == [i for a in chain for i in range(a.start, a.end)]
            assert [t.positions[i] for i in seen] == list(range(len(seen)))
    assert chat.format_trees(df.limit(0), vocabulary).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = p.durable(docs)
        assert docs.columns == first.columns, name
        own = {r.doc_id for r in docs.select("doc_id").collect()}
        assert own <= ids and len(own) > 100
        ids = own
    packed = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == ids
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in p.run(spark, SF).collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_every_number_has_a_query():
    import __spark_entry__ as e

    names = e.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
