"""What operators once left out: each test here failed before its operator did the whole job."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from rolomill.llm import fingerprints, minhash_dedup, queries, url_filter

from test_operators import pairs_of, reach, same, shingle_set, tup


def test_fingerprints_of_very_long_texts():
    rnd = random.Random(11)
    a, b = (" ".join(f"{side}{rnd.randrange(10**6)}" for _ in range(250_000)) for side in "ab")
    words = a.split()
    c = " ".join(words[:225_000] + [f"c{i}" for i in range(25_000)])  # shares 224,996 of 275,000 shingles with a
    sig = fingerprints.signatures([a, b, c])
    near = fingerprints.likeness(sig[[0, 0]], sig[[1, 2]])
    assert near[0] <= 0.02 and abs(near[1] - 0.82) < 0.15
    assert len({x.tobytes() for x in fingerprints.short(sig)}) == 3


def family(n, most, seed=1):
    """n variants of one text with up to most words exchanged."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = base[:]
        for _ in range(rnd.randrange(most + 1)):
            w[rnd.randrange(len(w))] = f"n{rnd.random()}"
        rows.append((i, " ".join(w)))
    return rows


def brute_groups(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return reach({k for k, _ in rows}, links)


def test_pipeline_near_copies_at_80(spark, sf):
    rows = family(120, 9)
    for k in range(20):  # pairs at 0.81 to 0.84 (three or so exchanged words of 150), each alone
        w = [f"p{k}_{i}" for i in range(104)]
        rows += [(1000 + 2 * k, " ".join(w)), (1001 + 2 * k, " ".join(["x", *w[1:50], "y", *w[51:100], "z", *w[101:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    low, high = brute_groups(rows, 80), brute_groups(rows, 85)
    assert len(set(low.values())) < len(set(high.values())) - 15
    same([k for k, _ in pairs_of(corpus_pipeline.near_copies(spark, df, sf))], set(low.values()))
    same(tup(minhash_dedup.near_groups(df), "doc_id", "component_id"), high.items())
    same(tup(minhash_dedup.near_groups(df, percent=80), "doc_id", "component_id"), low.items())


def test_near_shapes():
    for percent in (30, 50, 70, 80, 85, 95, 100):
        n, rows = minhash_dedup.shape(percent)
        assert (1 - (percent / 100) ** rows) ** n < 1e-6
    assert minhash_dedup.shape(85) == (26, 5) and minhash_dedup.least_equal(85, 130) == 89


def test_pipeline_drops_by_row(spark, sf):
    """Repeated rows, null ids and ids that several texts share: one row stays of each group, and no clean text goes."""
    long = [f"w{i}" for i in range(400)]
    text, near = " ".join(long), " ".join([*long[:-1], "end"])
    rows = [(1, "same"), (1, "same"), (1, "same"), (None, "same"), (2, "none"), (None, "none"), (None, "lost"), (None, "lost"), (3, "copy"), (4, "copy"), (3, "clean"), (None, None), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.exact_copies(spark, df, sf)
    assert got.columns == df.columns
    same([(k, t or "") for k, t in tup(got, "doc_id", "text")], [(1, "same"), (2, "none"), (None, "lost"), (4, "copy"), (3, "clean"), (6, "")])
    rows = [(1, text), (1, text), (None, near), (None, near), (1, "another text that nothing else is like"), (None, "alone"), (7, near), (None, ""), (None, None), (8, "x y"), (8, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(tup(corpus_pipeline.near_copies(spark, df, sf), "doc_id", "text"), [(1, text), (1, rows[4][1]), (None, "alone"), (None, ""), (None, None), (8, "x y")])
    df = spark.createDataFrame([(None, text), (None, near), (None, near)], "doc_id long, text string")
    assert corpus_pipeline.near_copies(spark, df, sf).count() == 1


def test_near_documents_led_by_strangers(spark):
    """All share a passage. Those with long own parts are strangers to all and have the smallest ids; the others are alike."""
    passage = [f"p{i}" for i in range(200)]
    own = lambda k, n: [f"o{k}_{i}" for i in range(n)]
    rows = [(k, " ".join(passage + own(k, 100))) for k in range(60)] + [(k, " ".join(passage + own(k, 15))) for k in range(100, 110)]
    want = brute_groups(rows, 80)
    assert {want[k] for k in range(100, 110)} == {100} and all(want[k] == k for k in range(60))
    got = queries.fingerprints.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    same(tup(got, "doc_id", "group_id"), want.items())
    links = dict(tup(got, "doc_id", "n_links"))
    assert all((links[k] > 0) == (k >= 100) for k in links) and sum(links.values()) >= 2 * 9
    # op10's query has the same groups
    same(tup(queries.fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "group_id"), want.items())
    assert [n for n in queries.QUERIES if n.startswith("op10_")] == ["op10_fingerprints"]


def test_url_aliases_are_resolved(spark):
    link, meta = '<link rel="canonical" href="{}">'.format, '<meta http-equiv="refresh" content="0; url={}">'.format
    blocked = link("https://b.example.net/es/q")
    cases = [  # url of a blocked page, url of its alias, what the alias declares
        ("http://a.org/d/c.html", "http://a.org/d/a.html", link("c.html")),
        ("http://b.org/x", "http://b.org/d/a.html?q=/z/", link("../x")),
        ("http://c.org/d/a?p=2", "http://c.org/d/a?p=1", link("?p=2")),
        ("http://d.org/?a=1&b=2", "http://d.org/d", link("/?a=1&amp;b=2")),
        ("http://e.org/?a=1&b=<é>&lt;", "http://e.org/d", meta("/?a=1&#38;b&#x3D;&lt;&#233;&gt;&amp;lt;")),
        ("http://F.org/T", "http://f.org/d", link("HTTP://f.ORG/T")),
        ("http://g.org/t", "http://g.org/d", link("http://g.org/other") + "<p>" + link("/t")),
        ("http://h.org/t", "http://h.org/d", meta("/other") + meta("t")),
        ("http://i.org/d/", "http://i.org/d/e/f", link("./../../d/./e/..")),
        ("http://j.org/", "http://J.org/d", link("//j.org")),
        ("http://k.org/d/go?u=http://z.org/", "http://k.org/d/a", link("go?u=http://z.org/#top")),
    ]
    pages = [(2 * i + k, url, html) for i, (to, url, tags) in enumerate(cases) for k, (url, html) in enumerate([(to, blocked), (url, tags)])]
    free = [("http://a.org/c.html", None), ("http://b.org/d/x", None), ("http://c.org/?p=2", None), ("http://z.org/", None), ("http://l.org/d/e", link("mailto:x@a.org") + link("#a") + meta("e"))]
    pages += [(1000 + i, *x) for i, x in enumerate(free)]
    got = tup(url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "verdict")
    same(got, [(k, "block" if k < 1000 else "allow") for k, _, _ in pages])


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in all columns, empty and long texts, repeated rows and ids, an empty table, and a table without labels go through all stages."""
    from test_operators import odd_rows

    cols = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [r[:5] for r in odd_rows()] + [(3, "Ein anderer Text mit derselben Nummer und vielen Worten.", "de", None, 1), (None, "noch ein Text ohne Nummer", "de", None, None)] * 2
    rows += [(600 + i, f"the {w} fox and the {w} dog went on and on", "en", "s", 9) for i, w in enumerate(("red", "blue", "red"))]
    for name, table in (("odd", rows), ("empty", []), ("unlabelled", [(*r[:2], None, *r[3:]) for r in rows])):
        df = spark.createDataFrame(table, cols)
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        docs, kept = df, None
        for stage_name, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, str(tmp_path / name)).cache()
            assert docs.dtypes == df.dtypes, stage_name
            now = {(r.doc_id, r.text) for r in docs.collect()}
            if stage_name == "exact_dedup":
                assert len({t for _, t in now}) == docs.count()
            if stage_name in ("exact_dedup", "near_dedup"):
                assert now <= kept
            kept = now
        assert (name == "odd") == bool(kept)
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.where("piece = 0").count() == docs.count()
        if name == "odd":
            assert {600, 601, 602} & {k for k, _ in kept} == {601, 602}


def test_url_hubs_and_long_urls(spark):
    """Very many aliases of one blocked page, chains, long URLs, empty and repeated tags."""
    link = '<link rel="canonical" href="{}">'.format
    far = "http://long.org/" + "x/" * 50_000
    pages = [(0, "http://hub.net/es/", ""), (1, far + "a", link(far + "b")), (2, far + "b", link("http://hub.net/es/")), (3, far + "c", ""), (4, "http://free.org/", link("") + link(" ") + "<link rel=canonical>")]
    pages += [(10 + i, f"http://s{i}.org/p", link("http://hub.net/es/") * (1 + i % 3)) for i in range(400)]
    pages += [(1000 + i, f"http://chain.org/{i}", link(f"http://chain.org/{i + 1}" if i < 30 else "http://s7.org/p")) for i in range(31)]
    pages += [(5000 + i, f"http://ok.com/{i}", link("http://hub.net/es/")) for i in range(3)]  # their own rule allows them
    got = dict(tup(url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "verdict"))
    assert got == {k: "allow" if k in (3, 4) or k >= 5000 else "block" for k, _, _ in pages}
