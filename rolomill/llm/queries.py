"""The thin queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, importance, language_id, licenses, minhash_dedup, packing, quality, secret_scan, suffix_dedup, url_filter, variants

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    model = language_id.train(docs.where(~language_id.held_out()))
    got = language_id.identify(docs, model)
    return got.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir), _tokenizer())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir), _tokenizer())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(_read(spark, sf_dir), percent=85)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir)).drop("kept")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_read(spark, sf_dir))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir), _read(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    model = quality.train(docs.where(~language_id.held_out()), _read(spark, sf_dir, "labels"), statistics=docs)
    return quality.classify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_groups(_read(spark, sf_dir), every=97)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_license_scan, op4_packing, op5_secret_scan, op6_minhash_dedup, op7_exact_dedup, op8_suffix_dedup, op9_url_filter, op10_fingerprints, op11_importance, op12_quality, op13_variants, pipeline)}


def _licenses_sql() -> str:
    """op3's contract and method in plain SQL: bigram matches, diagonals, chains of diagonals, distinct grams of a chain."""
    rows = ", ".join(f"({t}, '{label}', '{phrase}', {base})" for t, (label, phrase, base) in enumerate([(x, y, True) for x, y in licenses.BASE] + [(x, y, False) for x, y in licenses.TEMPLATES]))
    return f"""
        with w as (
            select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
            from documents),
        t(t, label, phrase, base) as (values {rows}),
        q as (select t, label, base, string_split(phrase, ' ') as q from t),
        g as (select t, label, base, len(q) - 1 as m, j, q[j + 1] as w1, q[j + 2] as w2 from (select *, unnest(range(len(q) - 1)) as j from q)),
        p as (select r, i, w[i + 1] as v1, w[i + 2] as v2 from (select *, unnest(range(greatest(len(w) - 1, 0))) as i from w)),
        hit as (select r, t, label, base, m, i, j, i - j as diag from p join g on v1 = w1 and v2 = w2),
        diag as (select r, t, diag, count(*) as votes from hit group by all),
        chain as (select *, sum(fresh) over (partition by r, t order by diag) as part from (select *, case when diag - lag(diag) over (partition by r, t order by diag) <= {licenses.SHIFT} then 0 else 1 end as fresh from diag)),
        span as (
            select r, t, label, base, m, part, count(distinct j) / m::double as share, min(i) as lo, max(i) + 1 as hi,
                count(distinct case when base and votes = m then diag end) as places, min(case when base and votes = m then diag end) as first, max(case when base and votes = m then diag end) as last
            from hit join chain using (r, t, diag) group by r, t, label, base, m, part),
        judged as (select *, places > 0 as found, not base and share >= (case when m < 4 then 1.0 else {licenses.SHARE} end) and hi - lo + 1 <= {licenses.STRETCH} * (m + 1) as good from span)
        select doc_id, len(any_value(w))::bigint as n_words, coalesce(sum(places), 0)::bigint as n_base, min(first)::bigint as first_word, max(last)::bigint as last_word,
            coalesce(array_to_string(list_sort(list(distinct label) filter (found)), ','), '') as base_labels, coalesce(array_to_string(list_sort(list(distinct label) filter (found or good)), ','), '') as labels,
            coalesce(max(case when found then 1.0::double when good then share end), 0.0::double) as score,
            coalesce(array_to_string(list_sort(list(label || ':' || lo || ':' || (hi - lo + 1)) filter (good)), ','), '') as spans
        from w left join judged on judged.r = w.r group by w.r, doc_id
    """


#: Of a recursive WITH: the table of crc32, one list in one row.
_CRC_TABLE = """
        step(i, k, c) as (select i, 0, i from range(256) r(i) union all select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
        crc(t) as (select list(c order by i) from step where k = 8)"""


def _crc(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, where crc is joined."""
    octets = f"list_transform(range(0, length(hex(encode({text}))), 2), lambda i: ('0x' || substr(hex(encode({text})), i + 1, 2))::bigint)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::bigint), 4294967295)"


def _importance_sql() -> str:
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
        with recursive {_CRC_TABLE},
        d as (select row_number() over () as r, doc_id, {words} as w from documents),
        f as (select r, unnest(w) as w from d),
        g as (select unnest({words}) as w from benchmark),
        vocabulary as (select w from f union select w from g),
        bucket as (select w, {_crc("w")} % {importance.BUCKETS} as b from vocabulary, crc),
        s as (select b, count(*) as s from f join bucket using (w) group by b),
        t as (select b, count(*) as t from g join bucket using (w) group by b),
        sums as (select (select count(*) from f)::double as sum_s, (select count(*) from g)::double as sum_t),
        gain as (select b, floor(1000 * ln((coalesce(t, 0) + 1) * (sum_s + {importance.BUCKETS}) / ((coalesce(s, 0) + 1) * (sum_t + {importance.BUCKETS}))))::bigint as gain
            from s full join t using (b), sums),
        weight as (select r, floor(sum(gain) / count(*)::double)::bigint as weight from f join bucket using (w) join gain using (b) group by r),
        scored as (
            select r, doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
                coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
            from d left join weight using (r)),
        ranked as (select r, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from scored where n_features >= {importance.LEAST_WORDS})
        select doc_id, n_features, weight, score, case when rank <= {importance.PERCENT} * n // 100 then rank end as rank
        from scored left join ranked using (r)
    """


def _variants_sql() -> str:
    return f"""
        with recursive {_CRC_TABLE},
        runs as (select coalesce(doc_id::varchar, '') as k, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
        counted as (select k, w, count(*) as n from runs group by all),
        hashed as (select w, n, {_crc("k || ':' || w")} as h from counted, crc),
        told as (select case when h % 97 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from hashed),
        words as (select word, sum(n)::bigint as n from told where length(word) >= {variants.LEAST_LENGTH} group by word having sum(n) >= {variants.LEAST_COUNT}),
        less as (select word, i, left(word, i) || substr(word, i + 2) as d from (select word, unnest(range(length(word))) as i from words)),
        near as (
            select a.word, b.word as near from less a join less b on a.i = b.i and a.d = b.d and a.word <> b.word
            union select less.word, words.word from less join words on words.word = d
            union select words.word, less.word from less join words on words.word = d),
        ranked as (select near.word, near, n, row_number() over (partition by near.word order by n desc, near) as nth, count(*) over (partition by near.word) as n_near from near join words on words.word = near),
        formed as (
            select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when r.n >= {variants.TIMES} * w.n then near end as form, case when r.n >= {variants.TIMES} * w.n then r.n end as form_n
            from words w left join ranked r on r.word = w.word and nth = 1),
        chain(word, top) as (select word, word from formed union all select chain.word, form from chain join formed on formed.word = top where form is not null)
        select f.word, f.form, top as root, f.n, f.n_near, f.form_n
        from formed f join chain c on c.word = f.word join formed l on l.word = top where l.form is null
    """


ORACLE_SQL = {
    "op3_license_scan": _licenses_sql(),
    "op11_importance": _importance_sql(),
    "op13_variants": _variants_sql(),
    "op7_exact_dedup": """
        with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
        from d window w as (partition by text_sha256)
    """,
    "op6_minhash_dedup": """
        with recursive w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
            from documents),
        s as (
            select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
            from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        pairs as (select x.doc_id as a, y.doc_id as b, count(*) as n_both from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
        links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * n_both >= 85 * (na.n + nb.n - n_both)),
        reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b),
        c as (select a, min(b) as component_id from reach group by a)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
        from documents d join c on c.a = d.doc_id left join n on n.doc_id = d.doc_id
    """,
    "op9_url_filter": r"""
        with recursive p as (
            select page_id, url, coalesce(html, '') as html, regexp_replace(url, '(?s)#.*$', '') as bare,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages),
        t as (
            select url, unnest([
                regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) as t
            from p where contains(url, '://')),
        e as (
            select regexp_replace(url, '(?s)#.*$', '') as a, regexp_replace(case when contains(t, '://') then t
                when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || t
                when starts_with(t, '/') then regexp_extract(url, '(?s)^.*?://[^/?#]*') || t
                else regexp_extract(url, '(?s)^.*?://[^/?#]*') || '/' || t end, '(?s)#.*$', '') as b
            from t where t <> ''),
        links as (select a, b from e where a <> b union select b, a from e where a <> b),
        reach(a, b) as (select a, a from links union select r.a, l.b from reach r join links l on l.a = r.b),
        rules(v, h, f) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        nodes as (
            select a, min(b) as component,
                translate(coalesce(regexp_extract(a, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                coalesce(regexp_extract(a, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from reach group by a),
        judged as (
            select a, component, (select max_by(v, length(h || f)) from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, f)) as v
            from nodes),
        spread as (select component, bool_or(v = 'block') as blocked from judged group by component)
        select p.page_id, p.host, p.path, r.rule, coalesce(r.v, case when s.blocked then 'block' end, 'allow') as verdict, j.component
        from p left join (
            select page_id, max_by(h || f, length(h || f)) as rule, max_by(v, length(h || f)) as v
            from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, f) group by page_id) r on r.page_id = p.page_id
        left join judged j on j.a = p.bare left join spread s on s.component = j.component
    """,
}
