"""Operators on texts against brute force, on awkward rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import components, decontaminate, hmm, jaccard, packing, quality, substring, suffix_index, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def removed(docs, units, length):
    """For each row the units that windows starting in a row of a smaller id cover."""
    first = {}
    for i, t in docs:
        u = units(t)
        for k in range(len(u) - length + 1) if i is not None else ():
            key = tuple(u[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - length + 1) if i is not None else ():
            if first[tuple(u[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, u, gone))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring_dedup(odd_docs, no_docs):
    wanted = sorted((i or -1, len(u), sum(g), " ".join(w for w, x in zip(u, g) if not x)) for i, u, g in removed(pairs_of(odd_docs), words, 50))
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(odd_docs).collect())
    assert got == wanted and sum(w[2] for w in wanted) > 500
    assert substring.substring_dedup(no_docs).count() == 0


SMALL_PARTS = {"shard_bytes": 4_000, "chunk_bytes": 3_000}


@pytest.mark.parametrize("options", [{"batches": 1}, {**SMALL_PARTS, "batches": 4}, {**SMALL_PARTS, "batches": 2, "frequent": 2}])
def test_suffix_dedup(odd_docs, no_docs, options):
    wanted = []
    for i, u, g in removed(pairs_of(odd_docs), lambda t: (t or "").encode(), 50):
        wanted.append((i or -1, len(u), sum(g), sum(1 for k, x in enumerate(g) if x and (not k or not g[k - 1])), bytes(b for b, x in zip(u, g) if not x)))
    got = [(r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_index.suffix_dedup(odd_docs, **options).collect()]
    assert sorted(got) == sorted(wanted)
    if options["batches"] == 1:
        assert suffix_index.suffix_dedup(no_docs).count() == 0


def test_levels_are_sorted_suffixes_that_the_scan_reads(odd_docs, monkeypatch):
    """Levels grow as a binary counter does, hold suffixes in lexicographic order, and nothing repeats between batches without them."""
    levels, sizes = [], []
    scan = suffix_index.SuffixIndex.scan

    def watched(self, suffixes, keep=True):
        out = scan(self, suffixes, keep)
        levels.append(sorted(self.levels))
        for level in self.levels.values():
            before: dict[int, bytes] = {}
            last = b""
            for r in level.orderBy("shard", "piece").collect():
                width = self.shape.width
                own = [bytes(r.suffixes[k : k + width]) for k in range(0, len(r.suffixes), width)]
                assert own == sorted(own) and own[0] >= before.get(r.shard, b"") and own[0][: self.shape.part] >= last[: self.shape.part]
                before[r.shard] = last = own[-1]
                sizes.append(len(own))
        return out

    monkeypatch.setattr(suffix_index.SuffixIndex, "scan", watched)
    whole = {(r.doc_id, r.fp, r.n_removed) for r in suffix_index.suffix_dedup(odd_docs, **SMALL_PARTS, batches=4).collect()}
    assert levels == [[0], [1], [0, 1], [0, 1]] and sum(sizes) > 100

    def forgetful(self, suffixes, keep=True):
        self.levels.clear()
        return scan(self, suffixes, keep)

    monkeypatch.setattr(suffix_index.SuffixIndex, "scan", forgetful)
    alone = {(r.doc_id, r.fp, r.n_removed) for r in suffix_index.suffix_dedup(odd_docs, **SMALL_PARTS, batches=4).collect()}
    assert sum(x[2] for x in alone) < sum(x[2] for x in whole)


def test_suffix_dedup_at_every_place_of_the_owner(spark, prose):
    p, line, other = prose(12, 31)[:65], prose(40, 32)[:100], prose(40, 33)[:100]
    again = f"{line}{p}{other}\n"
    rows = [(1, prose(30, 34) + p + prose(30, 35)), (2, prose(20, 36) + again * 2 + prose(5, 37) + again), (2, prose(25, 38) + again + prose(25, 39)), (2, prose(25, 38) + again + prose(25, 39)), (3, again)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted((i, len(u), sum(g), bytes(b for b, x in zip(u, g) if not x)) for i, u, g in removed(rows, lambda t: t.encode(), 50))
    for options in ({}, {**SMALL_PARTS, "batches": 3}):
        got = suffix_index.suffix_dedup(docs, **options).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == wanted
    assert sum(w[2] for w in wanted if w[0] == 2) >= 5 * len(p)


def test_cut_repeats_keeps_columns_and_characters(spark):
    shared = "ü" * 30 + "shared passage of some length, more than fifty bytes in all"
    docs = spark.createDataFrame([(1, f"a {shared} b", 9), (2, f"é{shared}é", 9), (None, None, 9)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in suffix_index.cut_repeats(docs).collect()}
    assert got[1].text == f"a {shared} b" and got[None].text is None
    assert got[2].n_chars == len(got[2].text) and got[2].text.startswith("é") and len(got[2].text) <= 4


def test_many_runs_of_one_anchor(spark, prose):
    """A passage in many documents, each time among other words: many suffixes of one anchor, and windows as suffixes where it counts as frequent."""
    passage = prose(40, 77)
    rows = [(i, f"{prose(20, 1000 + i)} {passage} {prose(20, 2000 + i)}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted((i, sum(g)) for i, u, g in removed(rows, lambda t: t.encode(), 50))
    for options in ({}, {**SMALL_PARTS, "frequent": 20}):
        assert sorted((r.doc_id, r.n_removed) for r in suffix_index.suffix_dedup(docs, **options).collect()) == wanted


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_near_duplicates(spark, odd_docs, no_docs, prose, percent):
    base = prose(300, 5).split()
    rows = [(100 + k, " ".join(base[: 40 * k] + ["new"] + base[40 * k :])) for k in range(6)]  # near copies of each other
    rows += [(120 + k, " ".join(base[8 * k :] + prose(8 * k, 50 + k).split())) for k in range(12)]  # a chain of drifting copies
    rows += [(140 + k, " ".join(base[: 300 - 45 * k])) for k in range(5)]  # far apart in size
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    data = pairs_of(docs)

    def shingles(t):
        w = (t or "").encode().translate(jaccard.SMALL).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in data]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    wanted = sorted((i or -1, len(x), top(i) or -1) for i, x in sets)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.near_duplicates(docs, percent=percent).collect()) == wanted
    assert len({w[2] for w in wanted}) < len(wanted) - (10 if percent < 95 else 2)
    if percent == 80:
        assert jaccard.near_duplicates(no_docs).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 9), (9, 8), (8, 7), (7, 10), (5, 5), (None, 4)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7, 10: 7, **{k: 100 for k in range(101, 141)}}


def test_contamination(spark, odd_docs, no_docs, prose):
    item = prose(30, 8)
    bench = spark.createDataFrame([(1, item), (2, "one TWO"), (3, None), (4, ""), (None, "one two"), (5, item), (60, "ä-Ö")], "item_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, f"{prose(9, 9)} {' '.join(item.upper().split()[3:20])} {prose(9, 10)}"), (51, prose(500, 11) + " " + " ".join(item.split()[:13])), (52, " ".join(item.split()[:12])), (53, "x ä!Ö y")], "doc_id long, text string"))
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for r in bench.where("item_id is not null").collect():
        w = split(r.text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(str(r.item_id))
    wanted = []
    for i, t in pairs_of(docs):
        w, hit, items = split(t), set(), set()
        for key, names in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    items |= names
        wanted.append((i or -1, len(w), len(hit), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    coded = [(str(r.item_id), split(r.text)) for r in bench.where("item_id is not null").collect()]
    for block_bytes in (1 << 20, 1):
        rows = decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()
        got = [(r.doc_id or -1, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in rows]
        assert sorted(got) == sorted(wanted)
        for r in rows:  # the longest matches, by brute force
            texts = {t for i, t in pairs_of(docs) if i == r.doc_id and len(split(t)) == r.n_words}
            if len(texts) != 1 or r.n_words > 1000:
                continue
            w = split(texts.pop())
            longest = []
            for d in range(len(w)):
                best = (0, "", 0)
                for name, x in coded:
                    for s in range(len(x)):
                        n = 0
                        while d + n < len(w) and s + n < len(x) and w[d + n] == x[s + n]:
                            n += 1
                        if n and n >= min(13, len(x)) and (-n, name) < (-best[0], best[1]):
                            best = (n, name, s)
                if best[0] and (not longest or d + best[0] > longest[-1][0] + longest[-1][1]):
                    longest.append((d, *best))
            assert [tuple(m) for m in r.matches] == longest
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.count() == sum(not w[-1] for w in wanted) and kept.columns == ["doc_id", "text"]
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_packing(odd_docs, no_docs):
    path = packing.vocabulary()
    tokenizer = packing.TokenIds(path).tokenizer
    rows = packing.pack_documents(odd_docs, path, with_ids=True).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all
    whole = collections.Counter()
    for i, t in pairs_of(odd_docs):
        whole[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    cover = collections.Counter()
    for (i, ids), times in whole.items():
        if times == 1 and sum(1 for j, _ in whole if j == i) == 1:
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            assert tuple(x for r in own for x in r.ids) == ids and {r.doc_tokens for r in own} == {len(ids)}
        cover[i] += times * len(ids)
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in cover} == cover
    assert packing.pack_documents(no_docs, path).count() == 0


def test_documents_that_fit_a_class_stay_whole():
    r = np.random.default_rng(4)
    lengths = [int(x) for x in np.minimum(r.lognormal(6, 1.2, 4000) + 1, 60_000)]
    bins = packing.Bins(0, 4096, 64, 256)
    pieces = [p for k, n in enumerate(lengths) for p in bins.document(k, n)]
    before_the_end = {p[4] for p in pieces}
    pieces += bins.last()
    of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p[0]].append(p)
        sequences[p[4]].append(p)
    for k, n in enumerate(lengths):
        own = sorted(of[k], key=lambda p: p[1])
        assert [p[1] for p in own] == [0, *np.cumsum([p[2] for p in own])[:-1]] and sum(p[2] for p in own) == n
        assert n > 4096 or len(own) == 1 or any(p[4] not in before_the_end for p in own)
    for key, own in sequences.items():
        total = sum(p[2] for p in own)
        whole = [p for p in own if p[3] <= 4096 and p[2] == p[3]]
        if key in before_the_end:
            kinds = {min(64, 4096 // p[2]) for p in whole}
            assert total == 4096 and len(kinds) <= 1 and (not kinds or kinds == {64} or len(whole) == kinds.pop())
        else:
            assert total & (total - 1) == 0 and total <= 4096


@pytest.mark.parametrize("name,how", [("word_bpe_49k.json", "pretoken"), ("other", "whole")])
def test_the_way_to_cut_texts_is_tried_out(name, how, tmp_path):
    if name == "other":  # a tokenizer whose tokens reach across white space
        from tokenizers import Tokenizer, models

        path = str(tmp_path / "t.json")
        Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, "a ": 3}, merges=[("a", " ")])).save(path)
    else:
        path = packing.vocabulary(name)
    ids = packing.TokenIds(path)
    assert ids.how == how and ids.text("a b a") == ids.encoded("a b a")


def test_special_strings_and_white_space_are_tokenized_as_whole_texts_are():
    ids = packing.TokenIds(packing.vocabulary())
    for text in ["a b  c\x0bd\x1ce é <|endoftext|> x<|startoftext|>y ΑΣ Σ.", "don 't x 'll 12ab!!", " ́a  's\r\n\tß", "Ünï 'Re DON'T ''ll 3½² ª§x İi ʼNn Ŀa·b\x7f\xa0c"]:
        assert np.frombuffer(ids.text(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_quality(spark, odd_docs, no_docs, prose):
    junk = lambda k: "\n".join(" ".join(w + "$$$" for w in prose(12, 7000 + 10 * k + j).split()) for j in range(4))
    good = lambda k: "\n".join(prose(12, 9000 + 10 * k + j).capitalize() + "." for j in range(4))
    docs = spark.createDataFrame([(k, good(k) if k % 2 else junk(k)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(121, None), (None, 1)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert all((scores[k] > 0.5) == bool(k % 2) for k in range(120, 200))
    kept = quality.keep_good(docs, labels)
    assert kept.count() == 100 and kept.columns == docs.columns
    odd = [r.score for r in quality.quality_scores(odd_docs, labels).collect()]
    assert len(odd) == odd_docs.count() and all(0 <= s <= 1 for s in odd)
    assert quality.quality_scores(no_docs, labels).count() == 0
    assert all(math.isclose(r.score, 0.5) for r in quality.quality_scores(docs, labels.limit(0)).collect())


def test_long_chains_and_features_by_differences():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 50, 1007):
        for follow in (np.zeros((2, 2)), r.normal(size=(2, 2)), np.array([[0, 1.0], [0, 1]])):
            x = r.normal(size=n) * 3
            assert np.allclose(quality.chains(x, np.array([n]), follow)[0], quality.long_chain(x, follow), atol=1e-9)
    own, lines = quality.lines_of(["a b\nc\nd e f\n\nA", "x", None, "1\n2"])
    blocks = quality.Blocks(np.concatenate(list(quality.raw_blocks(own, lines))), lines)
    values, weights = r.normal(size=len(own)), r.normal(size=quality.N_FEATURES)
    gradient, base = blocks.summed(values), (blocks.evidence(weights) * values).sum()
    for k in r.integers(0, quality.N_FEATURES, 40).tolist():
        weights[k] += 1
        assert (blocks.evidence(weights) * values).sum() - base == pytest.approx(gradient[k], abs=1e-3)
        weights[k] -= 1


def test_the_fit_is_where_the_penalised_likelihood_is_flat():
    """The likelihood by enumeration over all labellings of short texts; its differences at the fit are near nothing."""
    texts = ["good line here\nmore of it", "$$$ ###\n|||", "fine words", "@@@@\n%%%%\n!!!!", "plain text\n####"]
    labels = np.array([1.0, 0, 1, 0, 1])
    own, lines = quality.lines_of(texts)
    raw, lengths = np.concatenate(list(quality.raw_blocks(own, lines))), np.array(list(map(len, own)))
    model = quality.fit(raw, lines, lengths, labels, rounds=1500)
    passed = quality.passed(raw)

    def loss(weights, follow):
        total = 1.0 * ((weights**2).sum() + (follow**2).sum())
        ends = np.cumsum(lines)
        for k, n in enumerate(lines.tolist()):
            x = passed[ends[k] - n : ends[k]]
            zero = np.zeros_like(x[:1])
            whole = np.concatenate([x, np.concatenate([zero, x[:-1]]), np.concatenate([x[1:], zero]), np.stack([np.arange(n) == 0, np.arange(n) == n - 1, np.ones(n)], 1)], 1)
            e = whole @ weights
            scores = {y: sum(e[i] for i in range(n) if y[i]) + sum(follow[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
            total += math.log(sum(map(math.exp, scores.values()))) - scores[(int(labels[k]),) * n]
        return total

    r = np.random.default_rng(3)
    for _ in range(12):
        step_w, step_f = r.normal(size=quality.N_FEATURES), r.normal(size=(2, 2))
        slope = (loss(model.weights + 1e-5 * step_w, model.follow + 1e-5 * step_f) - loss(model.weights - 1e-5 * step_w, model.follow - 1e-5 * step_f)) / 2e-5
        assert abs(slope) < 0.05


def test_quality_of_a_very_long_text():
    """A text of a million short lines, in memory that doesn't follow its lines times the features."""
    import tracemalloc

    model = quality.Crf(np.zeros(quality.N_FEATURES), np.eye(2))
    text = "ab cd\n" * 400_000
    tracemalloc.start()
    assert 0 <= quality.score(model, [text])[0] <= 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_chains_against_enumeration():
    r = np.random.default_rng(3)
    lines = np.array([3, 1, 4])
    score, follow = r.normal(size=8), r.normal(size=(2, 2))
    good, z, pairs = quality.chains(score, lines, follow, pairs=True)
    at, total = 0, np.zeros((2, 2))
    for k, n in enumerate(lines):
        weights = {}
        for y in np.ndindex(*[2] * n):
            weights[y] = math.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(follow[a, b] for a, b in zip(y, y[1:])))
        norm = sum(weights.values())
        assert math.isclose(z[k], math.log(norm))
        for i in range(n):
            assert math.isclose(good[at + i], sum(w for y, w in weights.items() if y[i]) / norm)
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                total[a, b] += w / norm
        at += n
    assert np.allclose(pairs, total)


def test_hidden_markov_model():
    r = np.random.default_rng(4)
    norm = lambda x, axis=None: x / x.sum(axis, keepdims=True)
    m = hmm.Hmm(norm(r.random(3)), norm(r.random(3)), norm(r.random((3, 3)), 1), norm(r.random((5, 3)), 0))
    codes, lengths, start = r.integers(0, 5, 10).astype("<u2"), np.array([4, 1, 5]), np.array([True, False, True])
    likely = hmm.log_likelihood(m, codes, lengths)
    counts = [np.zeros(3), np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    at = 0
    for k, n in enumerate(lengths):
        seq, first = codes[at : at + n], (m.first if start[k] else m.later)
        paths = {}
        for s in np.ndindex(*[3] * n):
            p = first[s[0]] * np.prod([m.follow[a, b] for a, b in zip(s, s[1:])]) * np.prod([m.emit[c, a] for c, a in zip(seq, s)])
            paths[s] = p
        total = sum(paths.values())
        if start[k]:
            assert math.isclose(likely[k], math.log10(total))
        for s, p in paths.items():
            counts[0 if start[k] else 1][s[0]] += p / total
            for a, b in zip(s, s[1:]):
                counts[2][a, b] += p / total
            for c, a in zip(seq, s):
                counts[3][c, a] += p / total
        at += n
    for a, b in zip(hmm.expected(m, codes, lengths, start), counts):
        assert np.allclose(a, b, rtol=1e-4)


def test_every_round_of_training_sees_all_documents(spark):
    r = np.random.default_rng(8)
    texts = [r.integers(0, 6, 12).astype("<u2") if i % 2 else r.integers(3, 9, 12).astype("<u2") for i in range(400)]
    coded = spark.createDataFrame([(i, i, True, t.tobytes()) for i, t in enumerate(texts)], "doc_id long, fp long, trained boolean, codes binary")
    share = np.bincount(np.concatenate(texts), minlength=9) + 1.0
    share /= share.sum()
    emit = share[:, None] * np.random.default_rng(7).uniform(0.5, 1.5, (9, 3))
    model = hmm.Hmm(np.full(3, 1 / 3), np.full(3, 1 / 3), np.full((3, 3), 0.1 / 3) + 0.9 * np.eye(3), emit / emit.sum(0))
    cut, start = hmm.stretches(np.concatenate(texts), np.full(400, 12))
    for _ in range(14):
        model = hmm.maximised(hmm.expected(model, np.concatenate(texts), cut, start), share)
    got = hmm.train(coded, 9, share, 3, rounds=14)
    assert all(np.allclose(a, b, rtol=1e-2) for a, b in ((got.follow, model.follow), (got.emit, model.emit)))


def test_scores_of_texts(odd_docs, no_docs):
    train = F.col("doc_id") % 3 != 0
    rows = hmm.score_texts(odd_docs, train, own_classes=40, buckets=8, head_words=100).collect()
    data = pairs_of(odd_docs)
    count = collections.Counter(w for i, t in data if i is not None and i % 3 for w in hmm.tokens_of(t))
    n, v = sum(count.values()), len(count)
    wanted = []
    for i, t in data:
        w = hmm.tokens_of(t)
        wanted.append((i or -1, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)))
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert got == sorted(wanted) and all(r.score < 0 for r in rows)
    assert hmm.score_texts(no_docs, train).count() == 0
    nothing = hmm.score_texts(odd_docs, F.lit(False)).collect()
    assert {r.base_score for r in nothing} == {0.0} and {r.train_tokens for r in nothing} == {0}


def captured(monkeypatch):
    """What score_texts trains."""
    held = {}
    train = hmm.train

    def watched(coded, size, share, states, rounds):
        held["model"] = train(coded, size, share, states, rounds)
        return held["model"]

    monkeypatch.setattr(hmm, "train", watched)
    return held


def test_scores_by_enumeration_of_states(spark, monkeypatch):
    """A text's probability, summed over all sequences of states, times the shares of its words in their buckets."""
    held = captured(monkeypatch)
    rows = [(1, "a b c a B a zz"), (2, "a a y xx xx"), (3, "c b new"), (4, None), (5, "zz yet unseen words"), (6, "xx xx a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in hmm.score_texts(docs, F.col("doc_id") < 3, states=3, own_classes=3, buckets=2, head_words=4).collect()}
    count = collections.Counter(w for i, t in rows if i < 3 for w in hmm.tokens_of(t))
    common = [w for w, _ in sorted(count.items(), key=lambda p: (-p[1], p[0]))[:4]]
    own = [hmm.END, *(w for w in common[:3] if w != hmm.END)][:3]
    classes, m = hmm.Classes(own, 2), held["model"]
    inside = collections.defaultdict(list)
    for w, n in count.items():
        if w not in own:
            inside[classes[w]].append(n)
    for i, t in rows:
        words = hmm.tokens_of(t)
        codes = [classes[w] for w in words]
        total = sum(m.first[s[0]] * np.prod([m.follow[a, b] for a, b in zip(s, s[1:])]) * np.prod([m.emit[c, a] for c, a in zip(codes, s)]) for s in np.ndindex(*[3] * len(words)))
        shares = [(count[w] + 1) / (sum(inside[c]) + len(inside[c]) + 1) for w, c in zip(words, codes) if w not in own]
        assert got[i] == pytest.approx(math.log10(total) + sum(map(math.log10, shares)), abs=1e-6)


def test_probabilities_of_one_word_add_up(spark, monkeypatch):
    """Over all known words and one unknown: what the model gives to any word but the end, then the end."""
    held = captured(monkeypatch)
    words = ["a", "b", "c", "d"]
    rows = [(1, "a b c a b a d"), (2, "a a"), *((10 + k, w) for k, w in enumerate([*words, "unseen"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [10**r.score for r in hmm.score_texts(docs, F.col("doc_id") < 10, states=2, own_classes=2, buckets=1, head_words=2).collect() if r.doc_id >= 10]
    m = held["model"]
    first = m.first * (1 - m.emit[0])  # class 0 is the end
    assert sum(got) == pytest.approx(float(first @ m.follow @ m.emit[0]), rel=1e-6)


def test_token_counts(odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    of = token_counts.Pieces(path)

    def count(word):
        s, best = token_counts.SPACE + word, [(0.0, 0)]
        for end in range(1, len(s) + 1):
            n = len(s[end - 1].encode())
            ways = [(best[end - 1][0] + n * of.byte, best[end - 1][1] + n)]
            ways += [(best[a][0] + of.score[s[a:end]], best[a][1] + 1) for a in range(max(0, end - 40), end) if s[a:end] in of.score]
            most = max(x for x, _ in ways)
            best.append((most, min(k for x, k in ways if x == most)))
        return best[-1][1]

    memo = {w: count(w) for w in {w for _, t in pairs_of(odd_docs) for w in words(t)} if len(w) < 200}
    for r in token_counts.token_counts(odd_docs.where("doc_id is null or doc_id <> 10"), path, head_words=50).collect():
        texts = [t for i, t in pairs_of(odd_docs) if i == r.doc_id]
        assert (r.n_words, r.n_tokens) in {(len(words(t)), sum(memo[w] for w in words(t))) for t in texts}
    assert token_counts.token_counts(no_docs, path).count() == 0
    trie = token_counts.Trie(of)
    for w in sorted({"anchor", "ancient", "and", "andes", "ü"}):
        assert trie.terminal(token_counts.SPACE + w)[0] == count(w)
    assert trie.scored < sum(len(w) + 1 for w in ("anchor", "ancient", "and", "andes", "ü"))


CLASHING = ["fp", "fp_", "spans", "Spans_", "gone", "judged_id", "judged_fp", "span_doc_id", "span_fp", "id", "label", "doc", "n", "start", "anchor", "run", "chunk", "shard", "level", "batch", "block", "counts", "tokens", "first", "last", "class", "head", "component", "node", "_d", "_f", "_fp", "_gone", "_doc_id", "_id", "_label", "_key", "matches", "items", "score", "raw", "n_words"]


@pytest.mark.parametrize("stage", ["keep_good", "keep_first", "cut_repeats", "decontaminate", "pack"])
def test_stages_leave_other_columns_alone(spark, prose, stage):
    """Extra columns with names that operators use inside come out as they were, but for packing, which leaves them out."""
    copied = prose(80, 91)
    rows = [(1, copied), (2, copied), (3, prose(60, 92)), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING))
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").withColumn("label", F.lit(7))
    bench = spark.createDataFrame([(1, prose(60, 92))], "item_id long, text string")
    run = {
        "keep_good": lambda: quality.keep_good(docs, labels, least=0.0),
        "keep_first": lambda: jaccard.keep_first(docs),
        "cut_repeats": lambda: suffix_index.cut_repeats(docs),
        "decontaminate": lambda: decontaminate.decontaminate(docs, bench),
        "pack": lambda: packing.pack_documents(docs, packing.vocabulary()),
    }[stage]
    out = run()
    if stage == "pack":
        assert out.groupBy("doc_id").agg(F.sum("length")).count() == 5
        return
    assert out.schema.names == docs.schema.names
    for r in out.collect():
        assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for c in CLASHING)
    wanted = {"keep_good": {1, 2, 3, None, 5}, "keep_first": {1, 3, None, 5}, "cut_repeats": {1, 2, 3, None, 5}, "decontaminate": {1, 2, None, 5}}[stage]
    assert {r.doc_id for r in out.select("doc_id").collect()} == wanted


@pytest.mark.parametrize("percent,small", [(10, 40), (33, 99), (80, 400)])
def test_sets_at_the_exact_threshold_link(spark, percent, small):
    """One set inside another whose size is just what the threshold allows, and one beyond it."""
    large = small * 100 // percent
    words = [f"w{i}" for i in range(large + 5)]
    rows = [(1, " ".join(words[: small + 4])), (2, " ".join(words[: large + 4])), (3, " ".join(f"x{w}" for w in words[: small + 4])), (4, " ".join(f"x{w}" for w in words[: large + 5]))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)
    wanted = [(1, 1), (2, 1), (3, 3), (4, 3 if 100 * small >= percent * (large + 1) else 4)]
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == wanted
