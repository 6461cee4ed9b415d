"""Each operator against a brute-force version, on the smallest tables and on a fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from rolomill.llm import bpe, exact_dedup, fingerprints, graph, language_id, licenses, minhash_dedup, packing, queries, secret_scan, suffix_dedup, url_filter

TOKENIZER = queries._tokenizer()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component long, h string"
P = "the quick brown fox jumps over the lazy dog while seventeen wise owls look on from the old oak tree by the quiet river "


def odd_rows():
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "théta", "iota", "kappa"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = prose(120).split()
    texts = [None, "", " \n\t ", "one", "one", "a b c d", "a b c d e", "²", "12 34", "日本語 テキスト", P * 3, "X" + P * 3 + "y", P + "zz", "a" * 30_000, "ab" * 450, " ".join(base), " ".join(base[:60] + ["changed"] + base[60:]), " ".join(base[:-3]), prose(9000), prose(300)]
    texts += ['x password = "hunter22" token: short token:abcdefgh', "AKIA" + "Z9" * 10 + " é " + "0af3" * 8, "K" + "deadbeef" * 3 + "g", "Licensed under CC BY-NC 4.0, GNU General Public License! All rights reserved cc by", "<|endoftext|> x<|endoftext|>", "x\x1cy\x85z Ⅷ 'll 're"]
    rows = [(i, t, None if i % 5 == 0 else "en", None, None, 7, "h") for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, "one", None, None, None, None, None), (None, None, None, None, None, None, None), (500, P * 2, "en", "s", -1, 1, "")]


@pytest.fixture(scope="module", params=["odd", "sf", "empty"])
def docs(request, spark, sf):
    if request.param == "sf":
        return spark.read.parquet(f"{sf}/documents.parquet")
    return spark.createDataFrame(odd_rows() if request.param == "odd" else [], DOCS)


def pairs_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def tup(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


def test_exact(docs):
    rows = pairs_of(docs)
    groups = defaultdict(list)
    for k, t in rows:
        groups[t].append(k)
    want = []
    for k, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((k, keep, len(groups[t]), k == keep, hashlib.sha256(t.encode()).hexdigest()))
    same(tup(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256"), want)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def reach(nodes, links):
    least = {n: n for n in nodes}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


def test_near(docs):
    rows = pairs_of(docs)
    sets = [shingle_set(t) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                links.append((rows[i][0], rows[j][0]))
    least = reach([k for k, _ in rows if k is not None], links)
    same(tup(minhash_dedup.near_groups(docs), "doc_id", "n_shingles", "component_id", "kept"), [(k, len(s), least.get(k), k == least.get(k)) for (k, _), s in zip(rows, sets, strict=True)])


def test_near_band_groups(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = base[:]
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(len(w))] = f"n{rnd.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingle_set(t) for _, t in rows]
    least = reach(range(300), [(i, j) for i in range(300) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    same(tup(minhash_dedup.near_groups(df), "doc_id", "component_id"), least.items())


def test_components(spark):
    rnd = random.Random(2)
    for n, m in ((1, 0), (60, 50), (60, 25)):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 140)]
        want = reach({x for e in links for x in e}, links)
        touched = {x for a, b in links if a != b for x in (a, b)}
        same(tup(graph.components(spark.createDataFrame(links + [(None, 3)], "a long, b long")), "node", "component"), [(k, v) for k, v in want.items() if k in touched])


def test_suffix(docs):
    rows = pairs_of(docs)
    data = [t.encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    want = []
    for (k, _), t in zip(rows, data, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        rest = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want.append((k, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    same(tup(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), want)


def test_suffix_arrays():
    """Many strings side by side, of runs, of few and of many symbols, and their common prefixes."""
    import numpy as np

    rnd = random.Random(0)
    for _ in range(150):
        strings = [[rnd.randint(1, rnd.choice([1, 2, 4, 250])) for _ in range(rnd.choice([0, 3, 60]))] + [0] for _ in range(rnd.randint(1, 9))]
        size = np.array([len(x) for x in strings])
        starts = np.cumsum(size) - size
        flat = np.array([c + 251 * k for k, x in enumerate(strings) for c in x])
        sa = suffix_dedup.suffix_arrays(flat, starts, size)
        for x, at in zip(strings, starts.tolist()):
            assert (sa[at : at + len(x)] - at).tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        before = np.full(len(flat), -1)
        before[sa[1:]] = sa[:-1]
        before[sa[starts]] = -1
        room = np.repeat(starts + size - 1, size) - np.arange(len(flat))
        raw = np.array([c for x in strings for c in x])
        for most in (5, 200):
            got = suffix_dedup.common_prefixes(raw, before, room, most)
            for i, j in enumerate(before.tolist()):
                want = 0
                while j >= 0 and want < min(room[i], room[j], most) and raw[i + want] == raw[j + want]:
                    want += 1
                assert got[i] == want


def test_suffix_hot_keys(spark, monkeypatch):
    """A passage before and after which thousands of texts differ, or agree for a while, split over tasks and within one."""
    rnd = random.Random(12)
    passage = "".join(rnd.choices("abcdefgh ", k=150))
    rows = [(k, "".join(rnd.choices("xy", k=rnd.randrange(3))) + str(k % 7) * (k % 90) + passage[rnd.randrange(2) :] + str(k % 5) * (k % 70) + "".join(rnd.choices("xy", k=rnd.randrange(90)))) for k in range(400)]
    data = [t.encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    want = []
    for (k, _), t in zip(rows, data, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want.append((k, sum(gone)))
    assert sum(n > 0 for _, n in want) > 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, most in ((1024, 48), (20, 4), (2, 2)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "MOST", most)
        same(tup(suffix_dedup.remove_repeats(df), "doc_id", "n_removed"), want)


def test_bpe(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for k, text in pairs_of(docs):
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(tup(bpe.digests(docs, TOKENIZER), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_bpe_streams():
    from tokenizers import Tokenizer

    t, rnd = Tokenizer.from_file(TOKENIZER), random.Random(1)
    parts = ["a", "th", "ing", " ", "  ", "\n", "'s", "é", "日", "١", "²", "_", "!!", "\x1c", "<|endoftext|>", "😀", "q" * 70, "12", "́"]
    for _ in range(400):
        s = "".join(rnd.choices(parts, k=rnd.randint(0, 25)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert bpe.encode_ids(TOKENIZER, s) == ids
        assert bpe.decode_ids(TOKENIZER, ids) == t.decode(ids, skip_special_tokens=False)
    for s in ("ab" * 40_000, " " * 70_001 + "x", "".join(rnd.choices("etaoinshr", k=60_000)), "-" * 70_000 + " x"):
        assert bpe.encode_ids(TOKENIZER, s) == t.encode(s, add_special_tokens=False).ids
    for ids in ([220, 255, 254, 3], [rnd.randrange(50257) for _ in range(3000)]):
        assert bpe.decode_ids(TOKENIZER, ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_transducer_takes_all(spark):
    """Every pre-token's ids come from the transducer's steps; long ones are emitted before they end, and neither window nor table grows with them."""
    from tokenizers import Tokenizer

    t, rnd = Tokenizer.from_file(TOKENIZER), random.Random(9)
    e = bpe.Encoder(bpe.encoder(TOKENIZER, tuple).v)
    text = P * 40 + "".join(rnd.choices("etaoinshr", k=200_000)) + " " + "é" * 9000
    assert [i for part in e.encode(text) for ids in part for i in ids] == t.encode(text, add_special_tokens=False).ids
    m = e.transducer
    distinct = len(set(P.split())) + 1  # the first word also stands without a space
    assert distinct <= len(m.known) <= distinct + 2 and m.steps > distinct + 218_000 // m.window
    assert m.early > 10_000 and m.most <= 2 * m.window and m.rest == b""
    many = " ".join(f"w{i}" for i in range(bpe.REMEMBER * 2))
    assert [i for part in e.encode(many) for ids in part for i in ids] == t.encode(many, add_special_tokens=False).ids
    assert len(m.known) + len(m.known.older) <= bpe.REMEMBER + 1


def test_lookahead_is_sufficient():
    """Boundaries further than the lookahead from the end don't depend on what follows, on a small merge list with long chains."""
    v = object.__new__(bpe.Vocabulary)
    merges = [("c", "d"), ("b", "c"), ("a", "b"), ("cd", "e"), ("d", "e"), ("b", "cd"), ("a", "bc")]
    made = [a + b for a, b in merges]
    v.ids = {x.encode(): i for i, x in enumerate([*"abcde", *made])}
    v.rank = {(a.encode(), b.encode()): k for k, (a, b) in enumerate(merges)}
    far = v.lookahead

    def encode(s):
        p = list(s)
        while True:
            k = min((merges.index(x) for x in zip(p, p[1:]) if x in merges), default=None)
            if k is None:
                return p
            i = next(i for i in range(len(p)) if tuple(p[i : i + 2]) == merges[k])
            p[i : i + 2] = [p[i] + p[i + 1]]

    def ends(p):
        out, at = set(), 0
        for x in p:
            at += len(x)
            out.add(at)
        return out

    rnd = random.Random(4)
    for _ in range(2000):
        s, more = ("".join(rnd.choices("abcde", k=n)) for n in (20, 8))
        sure = {x for x in range(len(s) - far + 1)}
        assert ends(encode(s)) & sure == ends(encode(s + more)) & sure


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for k, text in pairs_of(docs):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for i, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at : first if not i else at + 2048]
            want.append((k, i, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    got = packing.pack(docs, TOKENIZER).cache()
    same(tup(got, "doc_id", "piece", "start", "length", "ids_crc32"), want)
    seqs = defaultdict(list)
    for s, o, n in tup(got, "sequence_id", "offset", "length"):
        seqs[s].append((o, n))
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    bins = []  # plain best-fit decreasing
    for n in sorted((w[3] for w in want), reverse=True):
        fit = min((b for b in bins if b[0] >= n), default=None)
        if fit is None:
            bins.append([2048 - n])
        else:
            fit[0] -= n
    assert len(seqs) == len(bins)


def test_sweep():
    """A gap takes the longest pieces that fit, pieces of lower rank first; what is left over stays."""
    runs = [(packing.PIECE, 10, 0, 3, 0, 0, 0), (packing.PIECE, 4, 0, 9, 0, 0, 0), (packing.PIECE, 40, 7, 1, 0, 0, 0), (packing.GAP, 12, 5, 2, 0, 0, 0), (packing.GAP, 9, 1, 1, 0, 0, 0)]
    assert sorted(packing.sweep(runs, 50)) == [
        (packing.PIECE, 4, 2, 7, 0, 0, 0), (packing.PIECE, 10, 2, 1, 0, 0, 0), (packing.PIECE, 40, 7, 1, 0, 0, 0), (packing.GAP, 1, 1, 1, 0, 0, 0), (packing.GAP, 2, 5, 2, 0, 0, 0),
        (packing.MATCH, 4, 0, 1, 1, 2, 41), (packing.MATCH, 10, 0, 2, 5, 1, 38),
    ]


def test_best_fit_supersteps(spark):
    """Every rank is placed once, no sequence overflows, and there are hardly more sequences than by plain best-fit decreasing."""
    rnd = random.Random(5)
    for size, most, top in ((30, 30, 40), (200, 9, 400), (64, 64, 1)):
        counts = {rnd.randint(1, most): rnd.randint(1, top) for _ in range(rnd.randint(8, 20))}
        bins = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((b for b in bins if b[0] >= n), default=None)
            if fit is None:
                bins.append([size - n])
            else:
                fit[0] -= n
        runs = spark.createDataFrame([(packing.PIECE, x, 0, n, 0, 0, 0) for x, n in counts.items()], packing.RUNS)
        matches, opened = packing.best_fit(runs, counts, size)
        assert len(matches) > 1
        places, ranks = Counter(), Counter()
        for m in matches:
            for _, x, r, n, s, each, off in map(tuple, m.collect()):
                for q in range(n * each):
                    ranks[x, r + q] += 1
                    at = off + q % each * x
                    places.update((s + q // each, k) for k in range(at, at + x))
        assert max(places.values()) == 1 and max(k for _, k in places) < size and {s for s, _ in places} == set(range(opened))
        assert set(ranks) == {(x, r) for x, n in counts.items() for r in range(n)} and max(ranks.values()) == 1
        assert len(bins) - 1 <= opened <= 1.02 * len(bins) + 1


def brute_secrets(text):
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(docs):
    want = []
    for k, t in pairs_of(docs):
        s = brute_secrets(t)
        want.append((k, *(sum(x[1] == i for x in s) for i in range(3)), hashlib.sha256(",".join(f"{secret_scan.KINDS[i]}:{a}:{e}" for a, i, e in s).encode()).hexdigest()))
    same(tup(secret_scan.scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), want)


def test_secrets_random():
    rnd = random.Random(6)
    parts = ["token", "TOKEN", "secretpassword", "api_key", "apikey", "=", ":", " ", '"', "é", "AKIA", "AKIAAKIA", "A9" * 9, "0af", "deadbeef" * 3, "g", "abc", "İ", "K"]
    for _ in range(3000):
        s = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        assert [(a, k, e) for a, e, k in secret_scan.find(s) if k < 3] == brute_secrets(s), s


def test_secrets_checksums_and_redaction(spark):
    good = "ghp_" + "aB3" * 10
    good += secret_scan.checksum(good[4:])
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert [s[2] for s in secret_scan.find(f"é {good}.")] == [3] and not secret_scan.find(bad) and not secret_scan.find("x" + good)
    npm = "npm_" + "Zz9" * 10
    npm += secret_scan.checksum(npm[4:])
    assert secret_scan.find(f"é\n{npm}-{good}") == [(2, 42, 4), (43, 83, 3)] and not secret_scan.find(npm[:-1] + "-") and not secret_scan.find(npm + "a")
    # the checksum by plain arithmetic: CRC-32 of the 30 characters in base 62, six digits
    n, digits = zlib.crc32(npm[4:34].encode()), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    assert npm[34:] == "".join(digits[n // 62**k % 62] for k in range(5, -1, -1))
    df = spark.createDataFrame([(1, f"a {good} b", None, 5), (2, None, "x", 9), (3, "clean", "x", 5)], "doc_id long, text string, source string, n_chars long")
    same(tup(secret_scan.redact(df), "doc_id", "text", "source", "n_chars"), [(1, "a [github] b", None, 12), (2, None, "x", 9), (3, "clean", "x", 5)])


def test_licenses_base(docs):
    want = []
    for k, t in pairs_of(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hit = [(i, label) for label, p in licenses.BASE for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        want.append((k, len(w), len(hit), min((i for i, _ in hit), default=None), max((i for i, _ in hit), default=None), ",".join(sorted({x for _, x in hit}))))
    got = licenses.scan(docs)
    same(tup(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), want)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.collect())


def test_licenses_templates(spark):
    bsd = next(p for label, p in licenses.TEMPLATES if label == "bsd").split()
    texts = ["Intro. " + " ".join(bsd), "Intro " + " ".join(bsd[:8] + ["extra", "words"] + bsd[8:16] + bsd[17:]), " ".join(bsd[:9]), "Released under the MIT License.", "released under a mit license", " ".join(reversed(bsd))]
    got = dict(tup(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "labels"))
    assert got == {0: "bsd", 1: "bsd", 2: "", 3: "mit", 4: "", 5: ""}


def test_oracle_sql(spark, sf):
    """The SQL of the queries that SQL can express, in DuckDB."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, sf), con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        same(tup(got, *cols), con.sql(f"select {', '.join(cols)} from want").fetchall())


def brute_licenses(text):
    """(labels, score, spans) by plain loops: votes of all grams, chains of diagonals, each template gram counted once."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    labels, score, spans = set(), 0.0, []
    for label, p in licenses.BASE:
        q = p.split()
        if any(w[i : i + len(q)] == q for i in range(len(w))):
            labels.add(label)
            score = 1.0
    for label, p in licenses.TEMPLATES:
        q = p.split()
        m = len(q) - 1
        votes = sorted((i - j, i, j) for i in range(len(w) - 1) for j in range(m) if w[i : i + 2] == q[j : j + 2])
        while votes:
            part = [votes.pop(0)]
            while votes and votes[0][0] - part[-1][0] <= licenses.SHIFT:
                part.append(votes.pop(0))
            share = len({j for _, _, j in part}) / m
            lo, hi = min(i for _, i, _ in part), max(i for _, i, _ in part) + 1
            if share >= (1 if m < 4 else licenses.SHARE) and hi - lo + 1 <= licenses.STRETCH * (m + 1):
                labels.add(label)
                score = max(score, share)
                spans.append(f"{label}:{lo}:{hi - lo + 1}")
    return ",".join(sorted(labels)), score, ",".join(sorted(spans))


def test_licenses_method(spark):
    """The method's labels, scores and spans: templates with words exchanged, put in, left out and said twice."""
    rnd = random.Random(8)
    texts = ["the mit the mit license", "under the mit the mit license", None, ""]
    for label, p in licenses.TEMPLATES:
        for _ in range(6):
            w = p.split()
            for _ in range(rnd.randrange(len(w) // 5 + 2)):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randrange(2)] = rnd.choices([*w, "word"], k=rnd.randrange(3))
            texts.append(" ".join(rnd.choices(["of", "the", "license", "x"], k=rnd.randrange(9)) + w + p.split()[: rnd.randrange(9)]))
    want = [(i, *brute_licenses(t or "")) for i, t in enumerate(texts)]
    assert want[0][1:] == ("", 0.0, "") and want[1][1:3] == ("mit", 0.75) and len({x[2] for x in want}) > 20
    same(tup(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "labels", "score", "spans"), want)


def test_fingerprints(docs):
    rows = pairs_of(docs)
    got = {}
    for r in fingerprints.fingerprints(docs).collect():
        got.setdefault((r.doc_id, r.n_chars), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    keyed = [r for r in rows if r[0] is not None]
    if len({k for k, _ in keyed}) == len(rows):  # keys are unique
        order = sorted(rows, key=lambda r: -r[0])
        for (k, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
            r = got[k, len(t)][0]
            half = len(t) // 2
            e = t[: len(t) - half] + n[:half]
            assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            s, se, sn = map(shingle_set, (t, e, n))
            j = lambda a, b: (len(a & b) / len(a | b) if a and b else float(not a and not b))
            assert abs(r.near_edited - j(s, se)) < 0.25 and abs(r.near_next - j(s, sn)) < 0.25
    by_text = defaultdict(set)
    for k, t in rows:
        by_text[t] |= {r.fingerprint for r in got[k, len(t)] if [len(x) for x in [t]] == [r.n_chars]} if sum(1 for x in rows if (x[0], len(x[1])) == (k, len(t))) == 1 else set()
    assert all(len(x) <= 1 for x in by_text.values())


def test_fingerprint_links(docs):
    """The query's groups are those of near_documents, and these those of all pairs."""
    got = fingerprints.fingerprints(docs)
    same(tup(got, "doc_id", "group_id", "n_links"), tup(fingerprints.near_documents(docs), "doc_id", "group_id", "n_links"))
    rows = pairs_of(docs)
    sets = [shingle_set(t) for _, t in rows]
    keyed = [i for i, (k, _) in enumerate(rows) if k is not None and sets[i]]
    links = [(rows[i][0], rows[j][0]) for i in keyed for j in keyed if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    least = reach([k for k, _ in rows if k is not None], links)
    same(tup(got, "doc_id", "group_id"), [(k, least.get(k)) for k, _ in rows])


def test_fingerprint_bits(docs):
    """The bits are those of plain minima over the shingles' hashes."""
    import numpy as np

    from rolomill.llm import shingles

    mh = shingles.MinHash(fingerprints.PERMUTATIONS)
    a, b = (list(map(int, x)) for x in (mh.a, mh.b))
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    rows = pairs_of(docs)
    for k, t in random.Random(4).sample(rows, min(12, len(rows))):
        if k is None or sum(x[0] == k for x in rows) > 1 or len(t) > 20_000:
            continue
        h = [int(x) for x in np.unique(shingles.shingles([t])[0])]
        assert len(h) == len(shingle_set(t))
        want = [min(((x * m + c) % 2**64 >> 32 for x in h), default=2**32 - 1) for m, c in zip(a, b)]
        assert got[k] == "".join(f"{w % 2**16:04x}" for w in want)


def test_fingerprint_groups(docs):
    rows = pairs_of(docs)
    got = tup(fingerprints.near_documents(docs), "doc_id", "group_id")
    assert len(got) == len(rows)
    text = {k: t for k, t in rows}
    for k, g in got:
        if k is not None and k != g:
            assert g < k and shingle_set(text[k])
    eq = defaultdict(set)
    for k, g in got:
        if k is not None and shingle_set(text[k]):
            eq[shingle_set(text[k])].add(g)
    assert all(len(x) == 1 for x in eq.values())


def test_language(docs):
    model = language_id.train(docs.where(~language_id.held_out()))
    got = language_id.identify(docs, model)
    rows = pairs_of(docs)
    res = tup(got, "doc_id", "lang_pred", "score")
    assert len(res) == len(rows) and all(0 <= s <= 1 for _, _, s in res)
    text = {k: t for k, t in rows if k is not None}
    for k, p, _ in res:
        if k is not None:
            assert (p == "und") == (not re.search(r"[^\W\d_]", text[k]) or text[k] == "²" or not model.labels)


def test_language_accuracy_and_switching(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(df.where(~language_id.held_out()))
    test = df.where(language_id.held_out()).select("text", "lang").collect()
    got = model.predict([r.text for r in test])
    assert sum(g[0] == r.lang for g, r in zip(got, test, strict=True)) >= 0.97 * len(test)
    one = {r.lang: language_id.words_of(r.text)[:30] for r in test if len(language_id.words_of(r.text)) >= 30}
    a, b = sorted(one)[:2]
    (words, post), = model.label([" ".join(one[a] + one[b])])
    picked = [model.labels[i] for i in post.argmax(axis=1)]
    assert sum(p == (a if i < 30 else b) for i, p in enumerate(picked)) >= 54


def test_training_sample(spark, monkeypatch):
    """The sample has the lowest hashes of each label, whole texts, also if most rows share ids; rare labels are all there."""
    rows = [(k, f"word{k} letters" + " more" * k, "en" if k % 2 else "de") for k in range(400)]
    rows += [(7, "again and again", "en")] * 3000 + [(9000, "solo", "xx"), (9001, None, "yy"), (9002, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9)
    h = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id, 3) as h").distinct().collect()}
    for most in (3, 40, 5000):
        seen = []
        monkeypatch.setattr(language_id.Crf, "fit", lambda self, texts, langs, seed=5: seen.extend(zip(langs, texts, strict=True)) or self)
        model = language_id.train(df, most)
        assert model.labels == ["de", "en", "xx"]
        for label in model.labels:
            want = sorted((h[k], k, t) for k, t, lang in rows if lang == label and t is not None)[:most]
            assert [t for _, _, t in want] == [t for lang, t in seen if lang == label]


def test_language_without_labels(spark):
    assert language_id.Crf([]).predict(["hello world", "", "12"]) == [("und", 0.0)] * 3
    df = spark.createDataFrame([(1, "hello world", None), (2, None, None)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    same(tup(language_id.identify(df, model), "doc_id", "lang_pred", "score"), [(1, "und", 0.0), (2, "und", 0.0)])
    assert language_id.keep_identified(df, model, 0.5).count() == 0
    assert language_id.train(spark.createDataFrame([(1, "12", "en")], df.schema)).predict(["hello"]) == [("en", 1.0)]


def test_lexicon():
    """Words of no telling letters are told apart by the lexicon only; a word of one document is not in it."""
    m = language_id.Crf(["a", "b"]).fit(["zon zin zon"] * 4 + ["nuz niz nuz"] * 4 + ["once"], ["a"] * 4 + ["b"] * 4 + ["a"])
    assert set(m.lexicon) == {"zon", "zin", "nuz", "niz"} and m.lexicon["zon"] // len(language_id.LEVELS) == 0 and m.lexicon["niz"] // len(language_id.LEVELS) == 1
    assert m.l[m.lexicon["zon"]].argmax() == 0 and m.l[m.lexicon["niz"]].argmax() == 1


def test_lexicon_speaks_for_its_label(spark):
    """In whatever order documents come, a sure lexicon class has its own label's largest weight, and clean documents get large shares."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(df.where(~language_id.held_out()))
    for y in range(len(model.labels)):
        assert model.l[y * len(language_id.LEVELS) + len(language_id.LEVELS) - 1].argmax() == y
    test = df.where(language_id.held_out()).select("text", "lang").collect()
    got = model.predict([r.text for r in test])
    clean = [g for g, r in zip(got, test, strict=True) if r.text and len(language_id.words_of(r.text)) >= 50]
    assert sum(s >= 0.8 for _, s in clean) >= 0.97 * len(clean)


def test_forward_backward():
    import numpy as np

    rng = np.random.default_rng(0)
    s, t, starts = rng.normal(size=(2600, 3)), rng.normal(size=(3, 3)), [0, 1, 30, 2590]
    got, _, _ = language_id.forward_backward(s, t, np.array(starts))
    for a, b in zip(starts, [*starts[1:], len(s)]):
        f, g = np.exp(s[a:b]), np.ones((b - a, 3))
        for i in range(1, b - a):
            f[i] = (f[i - 1] @ np.exp(t)) * f[i]
            f[i] /= f[i].sum()
        for i in range(b - a - 2, -1, -1):
            g[i] = np.exp(t) @ (np.exp(s[a + i + 1]) * g[i + 1])
            g[i] /= g[i].sum()
        p = f * g
        assert np.allclose(got[a:b], p / p.sum(axis=1, keepdims=True))


def test_urls(spark):
    link = '<html><LINK href="{}" rel="canonical"></html>'
    pages = [
        (1, "http://Example.com/en/1", None, 1),
        (2, "http://www.example.com/en/1", "<p>", 1),
        (3, "https://a.example.net/fr/x?y#z", None, 1),
        (4, "http://plain.org/a", link.format("https://b.example.net/es/q"), 1),
        (5, "http://allowed.com/a", link.format("https://b.example.net/es/q"), 1),
        (6, "http://plain.org/b", '<meta http-equiv="refresh" content="0; url=/a">', 1),
        (7, None, None, None),
        (8, "no host", link.format("/x"), 1),
        (9, "://HOST", "", 1),
        (9, "://HOST", "", 1),
        (10, "http://net/es/", None, 1),
        (11, "http://xnet/es/", None, 1),
    ]
    got = tup(url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string, component long")), "page_id", "host", "path", "rule", "verdict")
    same(got, [
        (1, "example.com", "/en/1", "example.com/en/", "block"), (2, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (3, "a.example.net", "/fr/x", "net/fr/", "block"),
        (4, "plain.org", "/a", None, "block"), (5, "allowed.com", "/a", "com/", "allow"), (6, "plain.org", "/b", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "host", "", None, "allow"), (9, "host", "", None, "allow"), (10, "net", "/es/", "net/es/", "block"), (11, "xnet", "/es/", None, "allow"),
    ])
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    one = corpus_pipeline.by_language(spark, docs, sf).cache()
    assert one.columns == docs.columns and one.count() >= 0.97 * docs.count()
    two = corpus_pipeline.exact_copies(spark, one, sf)
    texts = defaultdict(list)
    for k, t in pairs_of(one):
        texts[t].append(k)
    same([k for k, _ in pairs_of(two)], [max(v) for v in texts.values()])
    three = corpus_pipeline.near_copies(spark, two, sf)
    # the stage links at 0.8; of each group the smallest id stays
    rows = pairs_of(two)
    sets = [shingle_set(t) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i, x in enumerate(sets) for j in range(i) if x and 5 * len(x & sets[j]) >= 4 * len(x | sets[j])]
    kept = set(reach([k for k, _ in rows], links).values())
    assert {k for k, _ in pairs_of(three)} == kept
    four = corpus_pipeline.secrets_out(spark, three, sf)
    assert four.columns == docs.columns and four.count() == len(kept) and not any(brute_secrets(t) for _, t in pairs_of(four) if "[" not in t)
    assert corpus_pipeline.run(spark, sf).where("piece = 0").count() == len(kept)
