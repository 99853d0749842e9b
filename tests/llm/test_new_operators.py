"""Alignment of tokenizers, interactions of filters and certified quality rules, against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm import alignment, audit, quality_rules

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_by_hand(text):
    """Whole texts, tokens one at a time: [(end, id)] of both sides, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    names, free = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            names[chr(byte)] = byte
        else:
            names[chr(free)], free = byte, free + 1
    whole = (" " + text).encode()
    sides = []
    for ids, spell in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(names[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        if b"".join(map(spell, ids)) != whole:
            return None
        sides.append(list(zip(itertools.accumulate(len(spell(i)) for i in ids), ids)))
    return sides


def alignment_by_hand(texts):
    groups = []
    for text in texts:
        sides = tokens_by_hand(text) if text else None
        if sides is None:
            groups.append([])
            continue
        ends = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
        cut = [([], []) for _ in ends]
        for k in (0, 1):
            for e, i in sides[k]:
                cut[next(n for n, end in enumerate(ends) if e <= end)][k].append(i)
        groups.append(cut)
    links = [[(x, y) for a, b in cut for x in a for y in b] for cut in groups]
    counts = Counter(p for own in links for p in set(own))
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for cut, own in zip(groups, links):
        spelled = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in cut)
        out.append((sum(len(a) for a, _ in cut), sum(len(b) for _, b in cut), len(cut), len(own), sum(counts[p] == top[p[0]] for p in own), sum(counts[p] for p in own), hashlib.sha256(spelled.encode()).hexdigest() if cut else ""))
    return out


ODD = ["", None, " ", "  ", "a", " a  b ", "one▁two", "tab\tand\r\nline\n\n end ", "</s> <|endoftext|> <s>", "naïve café — “quoted” … 日本語 \U0001f600\U0001f468‍\U0001f469", "x" * 700, "ab" * 300 + " " * 40 + "z", "don't won't I'll 1234567 3.14 ((a)) //*--*//", "é   　 \u0000 \u0085 ﻿", "'S 'T 's't", "a   \n   b", "trailing   ", "\n", "ﬁ ① Å"]


def test_alignment(spark, odd_docs, no_docs, prose):
    texts = [*ODD, *[r.text for r in odd_docs.collect() if r.text is None or len(r.text) < 30_000], prose(300, 1), prose(80, 2), prose(80, 2)]
    docs = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, stripe int").repartition(3)
    wanted = sorted((i // 2, *row) for i, row in enumerate(alignment_by_hand(texts)))
    got = alignment.aligned(docs, A, B, stripes=5, spread=2, chunks=1)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == wanted
    assert alignment.aligned(no_docs, A, B).count() == 0


def test_units_of_texts_are_cut_where_tokenizers_allow_it():
    of = alignment.Both(A, B)
    assert of.units
    for text in ODD:
        if text and "▁" not in text:
            assert of.whole([" " + text]) == of.whole(alignment.UNIT.findall(" " + text)), text


def test_wide_and_narrow_numbers():
    import numpy as np

    for top in (0, 255, 256, 65_535, 65_536, 1 << 40):
        x = np.array([0, top])
        assert alignment.wide(alignment.narrow(x), 2).tolist() == x.tolist()


def audit_by_hand(docs, labels):
    good, toxic = {d for d, q, _ in labels if q}, {d for d, _, t in labels if t}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    failed = []
    for d, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {x for x, c in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > first[t]]) if c}
        failed.append((part or "", f, d in good, d in toxic))
    out, by_filter = {}, Counter()
    for part in {p for p, *_ in failed}:
        own = [x for x in failed if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order):
                gone = [f & set(order[:step]) for _, f, *_ in own]
                here = [y for y, g in zip(own, gone) if x in y[1] and not g]
                out[part, order, step + 1] = [sum(x not in f and not g for (_, f, *_), g in zip(own, gone)), len(here), sum(x in f and bool(g) for (_, f, *_), g in zip(own, gone)), sum(f == {x} for _, f, *_ in own), sum(y[2] for y in here), sum(y[3] for y in here)]
                by_filter[part, x] += len(here)
    return sorted((*k, *v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit(spark, odd_docs, no_docs, prose):
    rows = [(r.doc_id, r.text, r.fp) for r in odd_docs.collect()]
    rows += [(100 + i, prose(220, i % 3) + (" $" * (i % 2)) + " AB CD" * (9 * (i % 5)), "en" if i % 3 else None) for i in range(20)] + [(None, "", "en")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, words string, mask int")
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (104, 1, 1), (None, 1, 1), (100, None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    texts, failing = audit.text_measures(docs)
    got = audit.interactions(texts, failing, table, "lang", "E").collect()
    assert sorted(tuple(r) for r in got) == audit_by_hand(rows, [x for x in labels if x[0] is not None])
    texts, failing = audit.text_measures(no_docs.withColumnRenamed("fp", "lang"))
    assert audit.interactions(texts, failing, table, "lang", "E").count() == 0
    with pytest.raises(ValueError):
        audit.audited(audit.cells(audit.masked(docs, {}, "lang", None, table)), list("ABCDEFGHI"))


def test_audit_of_two_named_filters(spark):
    docs = spark.createDataFrame([(i, "t", "p", i % 2 == 0, i % 3 == 0) for i in range(12)], "doc_id long, text string, part string, even boolean, third boolean")
    none = docs.limit(0).selectExpr("doc_id", "even good", "even toxic")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.interactions(docs, {"even": F.col("even"), "third": F.col("third")}, none, "part").collect()}
    assert got == {("even,third", 1): (6, 6, 0, 4, 10), ("even,third", 2): (4, 2, 2, 2, 6), ("third,even", 1): (8, 4, 0, 2, 6), ("third,even", 2): (4, 4, 2, 4, 10)}


def measures_by_hand(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)


def test_measures_of_rules(spark, odd_docs, no_docs, prose):
    lines = "one line\nanother # line\none line\n \n\t\none line\n"
    more = [(200, lines, None, 1), (201, lines + prose(40, 1) + lines + prose(9, 1), "en", 1), (202, "a b c d e a b c d e a", "en", 1), (203, "a b c d", "en", 1), (204, " a\x0bb \U0001f600<|>\x85 é", "x", 1), (205, "a " * 300, "en", 1)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, fp string, run int"))
    rows = docs.select("doc_id", "text").collect()
    got = quality_rules.measured(docs, "fp").collect()
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((r.doc_id, *measures_by_hand(r.text)) for r in rows), key=key)
    assert quality_rules.measured(no_docs, None).count() == 0


def test_binomial_tails(spark):
    rows = [(n, k) for n in (1, 10, 300, 5000) for k in (0, 1, 2, 7, 20, 120) if k <= n]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", quality_rules.log_binomial_tail(F.col("n"), F.col("k"), 0.03).alias("p")).collect()
    for r in got:
        whole = sum(math.comb(r.n, j) * 0.03**j * 0.97 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == (0.0 if r.k >= 0.03 * r.n else pytest.approx(math.log(whole), rel=1e-9, abs=1e-9))


def test_certified_cutoffs_hold_on_documents_they_have_not_seen(spark):
    """Good documents have few symbols, bad ones many; cutoffs from one half lose little of the other half, and catch the bad."""
    import random

    r = random.Random(5)
    rows = []
    for i in range(3000):
        good = r.random() < 0.8
        marks = r.choice([0, 0, 1, 2]) if good else r.randrange(8, 30)
        rows.append((i, " ".join(f"w{r.randrange(10_000)}" for _ in range(40)) + " #" * marks, "few" if i < 60 else r.choice(["en", "de"]), good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean").withColumn("kept", F.lit("x"))
    got = quality_rules.judged(docs, docs.where("doc_id % 2 = 0").select("doc_id", "good"), alpha=0.1).collect()
    of = {r.doc_id: r.kept for r in got}
    for lang in ("en", "de"):
        unseen = [(of[i], good) for i, _, own, good in rows if i % 2 and own == lang]
        lost = sum(not kept for kept, good in unseen if good) / sum(good for _, good in unseen)
        caught = sum(not kept for kept, good in unseen if not good) / sum(not good for _, good in unseen)
        assert lost <= 0.1 and caught > 0.9
    assert all(of[r.doc_id] for r in got if r.doc_id < 60 and not r.base_failed)  # too few labels to prove anything
    assert all(r.kept for r in quality_rules.judged(docs, docs.limit(0).select("doc_id", "good")).collect() if not r.base_failed)
    kept = quality_rules.keep_passed(docs, docs.where("doc_id % 2 = 0").select("doc_id", "good"), alpha=0.1)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in of.items() if k}


def test_a_failing_cutoff_ends_its_sequence(spark):
    tested = spark.createDataFrame([("en", "symbols", k, 100 - k, 200, 10, g, b, k < 2) for k, (g, b) in enumerate([(0, 1), (0, 4), (50, 9), (0, 10)])], "stratum string, rule string, step int, cutoff int, n_good long, n_bad long, good_rejected long, bad_rejected long, certified boolean")
    assert [r.symbols for r in quality_rules.chosen_cutoffs(tested).collect()] == [99]
