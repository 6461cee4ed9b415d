"""Importance resampling, quality votes and spelling variants against brute force, on odd rows and the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import DOCS, odd_rows, pairs_of, same, tup

from rolomill.llm import importance, language_id, quality, variants, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", params=["odd", "sf", "empty"])
def docs(request, spark, sf):
    if request.param == "sf":
        return spark.read.parquet(f"{sf}/documents.parquet")
    return spark.createDataFrame(odd_rows() if request.param == "odd" else [], DOCS)


def test_runs_block_by_block():
    text = " ab,cd  efgh" * 50 + "x" * 100
    for block in (1, 3, 7, 64, 10_000):
        assert [w for b in words.runs(text, re.compile("[a-z]+"), re.compile("[^a-z]"), block) for w in b] == re.findall("[a-z]+", text)
    assert list(words.runs("", re.compile("[a-z]+"), re.compile("[^a-z]"))) == []


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
    return w, [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w)]


def brute_resample(rows, target, longest, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for k, text in rows:
        w, f = features(text, longest)
        gains = [math.floor(1000 * math.log((t[bucket(x)] + 1) * (big_s + buckets) / ((s[bucket(x)] + 1) * (big_t + buckets)))) for x in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = i
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("longest", [1, 3])
def test_importance(spark, sf, docs, longest, monkeypatch):
    monkeypatch.setattr(importance, "NODES", 150)
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    for least, percent, buckets in ((20, 10, 10_000), (1, 50, 97)):
        got = tup(importance.resample(docs, target, longest, buckets, least, percent, "s"), "doc_id", "n_features", "weight", "score", "rank")
        want = brute_resample(pairs_of(docs), [r.text or "" for r in target.collect()], longest, buckets, least, percent, "s")
        # repeated rows tie: which of them has a rank is open
        same(got, want)


def test_trie_across_blocks(monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 10)
    monkeypatch.setattr(importance, "runs", lambda t, run, gap: words.runs(t, run, gap, 10))
    text = "One two three four five six SEVEN eight eight nine ten été eleven " * 9
    for longest in (1, 2, 4):
        trie = importance.Trie(longest, 101)
        trie.add(text)
        want = np.bincount([zlib.crc32(f.encode()) % 101 for f in features(text, longest)[1]], minlength=101)
        assert list(trie.totals()) == list(want) and list(trie.totals()) == list(want)
        assert importance.Trie(longest, 101, list(range(101))).sum_gains(text) == (len(features(text, 1)[0]), int(want.sum()), int((want * range(101)).sum()))


def test_importance_prefers_the_target(spark):
    rnd = random.Random(5)
    kinds = {0: [f"a{i}" for i in range(40)], 1: [f"b{i}" for i in range(40)]}
    rows = [(i, " ".join(rnd.choice(kinds[i % 10 == 0]) for _ in range(60))) for i in range(1000)]
    target = spark.createDataFrame([(" ".join(kinds[1]) * 1,)] * 30, "text string")
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(got) == 100 and sorted(r["rank"] for r in got) == list(range(1, 101)) and sum(r.doc_id % 10 == 0 for r in got) > 60
    none = spark.createDataFrame([], "text string")
    assert importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), none).where("rank is not null").count() == 100


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_variants(counts, times=2):
    form, out = {}, []
    found = {w: [x for x in counts if near(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(found[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(found[w]), counts[form[w]] if form[w] else None))
    return out


def brute_words(rows, every):
    n = Counter()
    for k, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


COLS = "word", "form", "root", "n", "n_near", "form_n"


@pytest.mark.parametrize("every", [0, 3, 97])
def test_variants(docs, every):
    got = tup(variants.spelling_groups(docs, every), *COLS)
    want = brute_words(pairs_of(docs), every)
    same(got, brute_variants(want))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_variants_of_close_words(spark, monkeypatch, hot):
    """Small alphabets, runs of a letter, words of all lengths from one on; groups dealt again down to two open code points; several shards."""
    monkeypatch.setattr(variants, "HOT", hot)
    monkeypatch.setattr(variants, "SHARD", 3000)
    rnd = random.Random(hot)
    counts = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9))): rnd.choice([3, 3, 5, 9, 40, 80]) for _ in range(400)}
    counts |= {"a" * k: 3 ** (k % 4 + 1) for k in range(1, 30)} | {"ab" * k: 7 * k for k in range(1, 12)} | {"stem" + "x" * 4 + c: 4 for c in "abcdefghij"}
    got = tup(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")), *COLS)
    same(got, brute_variants(counts))


def test_automaton():
    rnd = random.Random(2)
    for _ in range(60):
        words_ = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 7))) for _ in range(rnd.randrange(1, 80))})
        a = variants.Automaton(words_)
        assert [a.exact(w)[1] for w in words_] == list(range(len(words_))) and all(a.final[a.exact(w)[0]] for w in words_)
        # minimal: no two states have the same words behind them
        behind = {}
        for s in {0} | {t for e in a.edges for t, _ in e.values()}:
            behind[s] = frozenset((a.final[s], *((c, t) for c, (t, _) in a.edges[s].items())))
        assert len(set(behind.values())) == len(behind)
        for w in words_[:20]:
            for half in range(len(w) + 1):
                assert a.near(w, half) == {k for k, x in enumerate(words_) if x[:half] == w[:half] and near(w[half:], x[half:])}


def test_long_words(spark):
    """A word of 50,000 letters and its neighbours take time linear in their length."""
    w = "ab" * 25_000
    counts = {w: 100, w[:-1]: 3, w[:30_000] + "x" + w[30_001:]: 4, "a" * 50_000: 9, "a" * 50_001: 3}
    got = {r.word: (r.form, r.n_near) for r in variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: (None, 2), w[:-1]: (w, 1), w[:30_000] + "x" + w[30_001:]: (w, 1), "a" * 50_000: (None, 1), "a" * 50_001: ("a" * 50_000, 1)}


def brute_terms(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    return len(tokens), len(set(tokens)), sum(a == b for a, b in zip(tokens, tokens[1:])), len(lines) - len(set(lines))


def test_quality_terms(docs, monkeypatch):
    """Whole texts: terms don't depend on how texts are batched, and the figures of form are right."""
    texts = [t for _, t in pairs_of(docs)][:80]
    if not texts:
        return
    doc, term, count = quality.terms_of(texts)
    for i, t in enumerate(texts):
        own = quality.terms_of([t])
        assert list(term[doc == i]) == list(own[1]) and list(count[doc == i]) == list(own[2])
        n, distinct, again, lines = brute_terms(t)
        form = [x - quality.WORDS - quality.SHAPES for x in own[1] if x >= quality.WORDS + quality.SHAPES]
        assert len(form) == quality.FIGURES and form[0] == min(15, int(math.log2(1 + n)))
        assert form[1] - 16 == (math.ceil(15 * (n - distinct) / n) if n else 0) and form[2] - 32 == (math.ceil(15 * again / n) if n else 0)
        assert form[6] - 96 == math.ceil(15 * lines / len(t.split("\n"))) and own[2][own[1] < quality.WORDS].sum() == n
    before = quality.terms_of(texts)
    monkeypatch.setattr(quality, "BLOCK", 100)
    after = quality.terms_of(texts)
    words_ = lambda x: sorted((d, t, c) for d, t, c in zip(*x, strict=True) if t < quality.WORDS)
    short = {i for i, t in enumerate(texts) if all(len(w) < 30 for w in t.split())}  # a word longer than a block is cut
    assert [x for x in words_(before) if x[0] in short] == [x for x in words_(after) if x[0] in short]


def test_quality_votes():
    """Scores are those of a plain loop over all vectors."""
    rnd = np.random.default_rng(1)
    texts = ["the cat sat", "THE CAT!! SAT!!", "a a a a a", "", "x\nx\nx", "the dog sat on the mat"]
    model = quality.Voters(np.ones(quality.TERMS, np.float32), rnd.normal(size=(quality.TERMS, 8)).astype(np.float32), rnd.normal(size=(60, 8)).astype(np.float32), (rnd.random(60) < 0.5).astype(float))
    model.vectors /= np.linalg.norm(model.vectors, axis=1, keepdims=True)
    got = model.score(texts)
    for t, s in zip(texts, got, strict=True):
        doc, term, count = quality.terms_of([t])
        w = quality.weights(doc, term, count, model.idf)
        assert abs(sum(x * x for x in w) - len({quality._PART[x] for x in term})) < 1e-3
        p = sum(x * model.latent[k] for x, k in zip(w, term, strict=True))
        p = p / np.linalg.norm(p)
        sims = [(float(v @ p), y) for v, y in zip(model.vectors, model.labels, strict=True)]
        near_ = sorted(sims, reverse=True)[: quality.NEIGHBOURS]
        assert abs(s - sum(max(c, 0) * y for c, y in near_) / sum(max(c, 0) for c, _ in near_)) < 1e-3


def test_quality_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = language_id.held_out()
    model = quality.train(docs.where(~held), labels, docs)
    got = quality.classify(docs, model).where(held).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert len(bad) > 5 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    # held-out labels are not read
    flipped = labels.withColumn("quality", quality.F.when(held, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    again = quality.train(docs.where(~held), flipped, docs)
    assert np.array_equal(model.labels, again.labels) and np.array_equal(model.vectors, again.vectors)


def test_quality_on_odd_rows(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(3, 0, None), (4, None, 0), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, lang int")
    n = docs.count()
    for own in (labels, labels.where("quality = 1"), labels.limit(0)):
        got = quality.classify(docs, quality.train(docs, own, docs)).collect()
        assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    model = quality.train(docs, labels, docs, each=3)
    assert len(model.labels) <= 6 and np.array_equal(quality.train(docs.repartition(3), labels, docs, each=3).labels, model.labels)
    same = quality.classify(spark.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "a")], "doc_id long, text string"), model).collect()
    by = {r.doc_id: r.score for r in same}
    assert by[1] == by[2] and by[None] == by[3]
