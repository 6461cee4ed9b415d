"""Queries over the test tables, one or more for each operator, with SQL for DuckDB that does the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import emails, pages, people
from .operators import cache, columns, consolidate, dedup, enrich, export, quality, search
from .operators.enrich import SKIPPED_URLS
from .plans.staging import shared_dir, stage
from .schema import APOLLO, FIELDS, HEADERS, HUBSPOT, QUALITY, VALUABLE
from .sources import files, manifest, workbooks
from .sources.contacts import contacts_raw, contacts_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate.valuable(consolidate.clean(contacts_raw(spark, sf)))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _has(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(w)})" for w in words) + ")"


_COLS = ", ".join(FIELDS)
_CLEANED = ", ".join(f"CASE WHEN trim(coalesce({f}, '')) IN ('nan', 'None', 'null', '') THEN '' ELSE trim({f}) END AS {f}" for f in FIELDS)
_FULL = " + ".join(f"({f} <> '')::INT" for f in FIELDS)
_WITH = f"WITH RECURSIVE contacts_raw AS ({contacts_sql()}), c0 AS (SELECT row_id, {_CLEANED}, source_file FROM contacts_raw), contacts AS (SELECT * FROM c0 WHERE {' OR '.join(f + chr(60) + chr(62) + chr(39) * 2 for f in VALUABLE)})"
_ROWS = _WITH + " SELECT "


# consolidation


@_query(_ROWS + f"row_id, {_COLS}, source_file FROM contacts")
def contacts_clean(spark, sf):
    return _contacts(spark, sf)


@_query(_ROWS + f"row_id, (({_FULL}) * 100 / 8.0)::DOUBLE AS completeness FROM contacts")
def contacts_completeness(spark, sf):
    return _contacts(spark, sf).select("row_id", consolidate.completeness().alias("completeness"))


@_query(_ROWS + f"source_file, count(*) AS row_count, avg(({_FULL}) * 100 / 8.0) AS avg_completeness FROM contacts GROUP BY source_file")
def contacts_source_stats(spark, sf):
    return consolidate.source_stats(_contacts(spark, sf))


@_query(_ROWS + "count(*) AS total_rows, " + ", ".join(f"count(*) FILTER ({c}) AS with_{n}" for n, c in (("names", "first_name <> '' OR last_name <> ''"), ("emails", "email <> ''"), ("companies", "current_company <> ''"), ("titles", "role <> ''"), ("linkedin", "linkedin <> ''"), ("phones", "phone <> ''"))) + " FROM contacts")
def contacts_preservation_stats(spark, sf):
    return consolidate.preservation(_contacts(spark, sf))


@_query(
    f"WITH contacts_raw AS ({contacts_sql()}), u AS (SELECT first_name, last_name, current_company, role, linkedin, email, phone, '' AS geo, 'customers.csv' AS source_file FROM contacts_raw "
    "UNION ALL SELECT '', '', s_name, '', '', '', '', n_name, 'suppliers.csv' FROM supplier JOIN nation ON s_nationkey = n_nationkey) "
    f"SELECT *, 'column_mapper' AS source_agent, '2025-08-03 10:00:00' AS consolidation_date, 2 AS total_source_files, 'data_consolidator' AS consolidation_agent, (({' + '.join(f"(trim(coalesce({f}, '')) <> '')::INT" for f in FIELDS)}) * 100 / 8.0)::DOUBLE AS data_completeness_percentage FROM u"
)
def union_aligned(spark, sf):
    s = _table(spark, sf, "supplier").join(F.broadcast(_table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_name").alias("current_company"), F.col("n_name").alias("geo"))
    u = consolidate.union_aligned([("customers.csv", contacts_raw(spark, sf).drop("geo")), ("suppliers.csv", s)])
    return consolidate.with_metadata(u, 2, at=F.lit("2025-08-03 10:00:00"))


# emails

_STD = _q(emails.STANDARD)
_LOW = "lower(trim(coalesce(email, '')))"
_VALID = f"({_LOW} NOT IN {_in(emails.INVALID)} AND regexp_matches({_LOW}, {_q('^(?:' + emails.STANDARD + ')')}) AND NOT regexp_matches(coalesce(string_split({_LOW}, '@')[2], ''), {_q(emails.PLACEHOLDERS)}))"


@_query(f"WITH contacts_raw AS ({contacts_sql()}) SELECT row_id, NOT {_VALID} AS needs FROM contacts_raw")
def email_needs_enrichment(spark, sf):
    return contacts_raw(spark, sf).select("row_id", emails.needs_enrichment(F.col("email")).alias("needs"))


@_query(f"WITH contacts_raw AS ({contacts_sql()}) SELECT row_id, {_VALID} AS valid FROM contacts_raw")
def email_valid(spark, sf):
    return contacts_raw(spark, sf).select("row_id", emails.is_valid_email(F.col("email")).alias("valid"))


_ODD_EMAIL = "CASE row_id % 5 WHEN 0 THEN 'Email: ' || email WHEN 1 THEN '(' || email || ')' WHEN 2 THEN 'contact:' || email WHEN 3 THEN '\"' || trim(email) || '\"' ELSE email END"


@_query(
    f"WITH contacts_raw AS ({contacts_sql()}), o AS (SELECT row_id, regexp_replace(regexp_replace(lower(trim(coalesce({_ODD_EMAIL}, ''))), '^(?:email:|e-mail:|contact:)\\s*', ''), {_q(chr(94) + chr(91) + chr(34) + chr(39) + '()' + chr(92) + '[' + chr(92) + ']{}]+|[' + chr(34) + chr(39) + '()' + chr(92) + '[' + chr(92) + ']{}]+$')}, '', 'g') AS t FROM contacts_raw) "
    f"SELECT row_id, CASE WHEN t NOT IN {_in(emails.REJECTED)} AND regexp_matches(t, {_q('^(?:' + emails.STANDARD + ')')}) THEN t END AS cleaned FROM o"
)
def email_clean(spark, sf):
    return contacts_raw(spark, sf).select("row_id", emails.clean_email(F.expr(_ODD_EMAIL)).alias("cleaned"))


_MASKED = "CASE row_id % 6 WHEN 0 THEN 'ann' || row_id || ' at acme dot io' WHEN 1 THEN 'ann' || row_id || '(at)acme(dot)io' WHEN 2 THEN 'ann' || row_id || '[at]acme[dot]io' WHEN 3 THEN 'matt' || row_id || ' AT acme.io' WHEN 4 THEN 'nothing here' ELSE 'ann' || row_id || '@acme.io' END"


def _masked_sql(steps: list[tuple[str, str]]) -> str:
    d = "trim(t)"
    for p, r in steps:
        d = f"regexp_replace({d}, {_q(p)}, {_q(r)}, 'gi')"
    return f"WITH contacts_raw AS ({contacts_sql()}), m AS (SELECT row_id, {_MASKED} AS t FROM contacts_raw), d AS (SELECT row_id, t, regexp_replace({d}, '\\s+', '', 'g') AS d FROM m) SELECT row_id, t AS masked, CASE WHEN contains(t, '@') THEN t WHEN regexp_matches(d, {_q('^(?:' + emails.STANDARD + ')')}) THEN d ELSE t END AS decoded FROM d"


@_query(_masked_sql([(r"\s*\[?\s*at\s*\]?\s*", "@"), (r"\s*\[?\s*dot\s*\]?\s*", "."), (r"\(\s*at\s*\)", "@"), (r"\(\s*dot\s*\)", ".")]))
def masked_email_decode(spark, sf):
    return contacts_raw(spark, sf).select("row_id", F.expr(_MASKED).alias("masked")).withColumn("decoded", emails.decode_masked(F.col("masked")))


@_query(_masked_sql([(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+", "@"), (r"\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+", ".")]))
def masked_email_decode_strict(spark, sf):
    return contacts_raw(spark, sf).select("row_id", F.expr(_MASKED).alias("masked")).withColumn("decoded", emails.decode_masked(F.col("masked"), strict=True))


_OBFUSCATED = "'Write to ann' || row_id || ' at acme.io or bob' || row_id || ' @ acme . io or eve@acme[dot]io or kim [@] acme [.] io or lee [at] acme [dot] io or pat at acme dot org, or matthew.com, id ' || row_id"


def _found(col: str, pattern: str, fix: str, to: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_extract_all({col}, {_q(pattern)}), lambda m: regexp_replace(m, {_q(fix)}, {_q(to)}, 'g')), lambda e: regexp_matches(e, {_q('^(?:' + emails.STANDARD + ')')})), ',')"


@_query(
    f"WITH contacts_raw AS ({contacts_sql()}), t AS (SELECT row_id, {_OBFUSCATED} AS t FROM contacts_raw) SELECT row_id, "
    + _found("t", emails.AT_WORD, r"\s*(?:at|AT)\s*", "@") + " AS at_word, " + _found("t", emails.AT_WORD_STRICT, r"\s*[\[(]?\s*(?:at|AT)\s*[\])]?\s*", "@") + " AS at_word_strict, "
    + _found("t", emails.AT_DOT, r"^([A-Za-z0-9._%+-]+)(?:\s*\[?\s*at\s*\]?\s*)([A-Za-z0-9.-]+)(?:\s*\[?\s*dot\s*\]?\s*)([A-Z|a-z]{2,})$", r"\1@\2.\3") + " AS at_dot, "
    + _found("t", emails.DOT_WORD, r"(?i)\[dot\]|\(dot\)", ".") + " AS dot_word, " + _found("t", emails.SPACED, r"\s+", "") + " AS spaced, " + _found("t", emails.BRACKETS, r"[\s\[\]]+", "") + " AS brackets FROM t"
)
def obfuscated_email_extract(spark, sf):
    t = contacts_raw(spark, sf).select("row_id", F.expr(_OBFUSCATED).alias("t"))
    c = F.col("t")
    say = lambda x, n: F.array_join(x, ",").alias(n)
    return t.select("row_id", say(emails.extract_at_word(c), "at_word"), say(emails.extract_at_word(c, strict=True), "at_word_strict"), say(emails.extract_at_dot(c), "at_dot"), say(emails.extract_dot_word(c), "dot_word"), say(emails.extract_spaced(c), "spaced"), say(emails.extract_brackets(c), "brackets"))


@_query(f"SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), {_STD}), ',') AS emails FROM documents")
def doc_email_extract(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.array_join(emails.extract_emails(F.col("text")), ",").alias("emails"))


@_query(_ROWS + f"row_id, CASE WHEN regexp_matches(email, {_STD}) THEN email END AS decoded FROM contacts WHERE email <> ''")
def cloudflare_decode(spark, sf):
    d = _contacts(spark, sf).where("email <> ''").withColumn("k", (F.col("row_id") % 200 + 1).cast("int"))
    two = lambda n: F.lower(F.lpad(F.hex(n), 2, "0"))
    code = F.concat(two(F.col("k")), F.array_join(F.transform(F.sequence(F.lit(1), F.length("email")), lambda i: two(F.ascii(F.substring(F.col("email"), i, F.lit(1))).bitwiseXOR(F.col("k")))), ""))
    return d.select("row_id", emails.decode_cloudflare(code).alias("decoded"))


# pages


#: The pages' characters outside ASCII in references, as the test tables have them.
_REFERENCES = [("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")]


def _page_sql() -> str:
    """The main text of pages with one main element that holds no other of its kind, by regular expressions."""
    h = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '<!>', 'g')"
    for t in pages.DROPPED:
        h = f"regexp_replace({h}, '(?is)<{t}\\b[^>]*>.*?</{t}>', '<!>', 'g')"

    def plain(x: str) -> str:
        x = f"regexp_replace(regexp_replace({x}, '\\s*<[^>]*>\\s*', '', 'g'), '\\s+', ' ', 'g')"
        for ref, char in _REFERENCES:
            x = f"regexp_replace({x}, {_q(ref)}, {_q(char)}, 'g')"
        return f"trim({x})"

    return (
        f"WITH h AS (SELECT page_id, url, {h} AS h FROM pages), b AS (SELECT *, regexp_extract(h, '(?is)<main\\b[^>]*>(.*?)</main>', 1) AS m, regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS a, regexp_extract(h, '(?is)<body\\b[^>]*>(.*)', 1) AS y FROM h), "
        f"p AS (SELECT page_id, url, {plain('CASE WHEN m <> ' + _q('') + ' THEN m WHEN a <> ' + _q('') + ' THEN a ELSE y END')} AS text, {plain('regexp_extract(h, ' + _q('(?is)<title[^>]*>(.*?)</title>') + ', 1)')} AS title FROM b) "
    )


@_query(_page_sql() + "SELECT page_id, url, title, substr(text, 1, 5000) AS text FROM p")
def page_text(spark, sf):
    return enrich.pages(_table(spark, sf, "pages")).drop("emails")


def _addresses_sql() -> str:
    """A page's addresses. \\b is spelt out by classes of characters, as the dialect's knows ASCII only: before an address, and behind its last letter, stands no letter, digit or _. Characters that no
    address has are doubled first, so that two neighbours needn't share one."""
    local, host = "[A-Za-z0-9_][A-Za-z0-9._%+-]*", "[A-Za-z0-9.-]"
    cores = [
        ("@", f"{local}@{host}+[.][A-Z|a-z]+[A-Za-z]", None),
        (".", f"{local}\\s*(?:at|AT)\\s*{host}+[.][a-zA-Z]{{2,}}", ("\\s*(?:at|AT)\\s*", "@")),
        ("@", f"(?i:{local}@{host}*(?:\\[dot\\]|\\(dot\\)|[.]){host}*[a-zA-Z]{{2,}})", ("(?i)\\[dot\\]|\\(dot\\)", ".")),
        ("@", f"{local}\\s*@\\s*{host}+\\s*[.]\\s*[a-zA-Z]{{2,}}", ("\\s+", "")),
    ]
    lists = []
    for needs, core, fix in cores:
        found = f"regexp_extract_all(d, '(?:\\A|[^\\p{{L}}\\p{{N}}_])({core})(?:\\z|[^\\p{{L}}\\p{{N}}_])', 1)"
        if fix:
            found = f"list_filter(list_transform({found}, lambda e: regexp_replace(e, {_q(fix[0])}, {_q(fix[1])}, 'g')), lambda e: regexp_matches(e, '^(?:' || {_q(emails.STANDARD)} || ')'))"
        lists.append(f"CASE WHEN contains(d, {_q(needs)}) THEN {found} ELSE [] END")
    doubled = "regexp_replace(text, '([^A-Za-z0-9._%+@|()\\[\\]-])', '\\1\\1', 'g')"
    return _page_sql().replace("FROM b) ", "FROM b), ", 1) + f"d AS (SELECT page_id, {doubled} AS d FROM p) SELECT page_id, array_to_string(list_sort(list_distinct(list_concat({', '.join(lists)}))), ',') AS emails FROM d"


@_query(_addresses_sql())
def page_emails(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.array_join(enrich.page_emails(F.col("html")), ",").alias("emails"))


_URLS = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN url || '.pdf' WHEN 1 THEN 'mailto:x' || page_id WHEN 2 THEN 'https://www.Facebook.com/' || page_id WHEN 3 THEN 'HTTP://site.org/' || page_id WHEN 4 THEN 'https://same.org/' || (page_id % 3) ELSE url END AS url FROM {pages}"
_URL_OK = f"(NOT {_has('lower(url)', SKIPPED_URLS)} AND (starts_with(url, 'http://') OR starts_with(url, 'https://')))"


@_query(f"WITH u AS ({_URLS.format(pages='pages')}) SELECT page_id, url, {_URL_OK} AS accepted FROM u")
def page_url_filter(spark, sf):
    return spark.sql(_URLS, pages=_table(spark, sf, "pages")).withColumn("accepted", enrich.url_ok(F.col("url")))


@_query(f"WITH u AS ({_URLS.format(pages='pages')}) SELECT url, min(page_id) AS page_id FROM u WHERE {_URL_OK} GROUP BY url")
def page_url_dedup(spark, sf):
    return enrich.distinct_urls(spark.sql(_URLS, pages=_table(spark, sf, "pages")))


_NAME = "trim(first_name || ' ' || last_name)"
_SEARCH = f"concat_ws(' ', nullif({_NAME}, ''), nullif(current_company, ''), 'email')"


@_query(_ROWS + f"row_id, CASE WHEN length({_SEARCH}) BETWEEN 3 AND 100 THEN {_SEARCH} WHEN {_NAME} <> '' THEN {_NAME} || ' email' ELSE 'email address' END AS query FROM contacts")
def search_query_build(spark, sf):
    return _contacts(spark, sf).select("row_id", enrich.search_term(F.col("first_name"), F.col("last_name"), F.col("current_company")).alias("query"))


_PROPOSED = "CASE row_id % 5 WHEN 0 THEN '\"' || first_name || ' at ' || current_company || ' mail\" -' WHEN 1 THEN 'Find the address of ' || first_name WHEN 2 THEN 'a b c d e f g h i j k l ' || last_name WHEN 3 THEN 'x' || repeat('y', 100) END"
_CLEAN_PROPOSED = f"regexp_replace(coalesce({_PROPOSED}, ''), '^[\"''\\-\\s]+|[\"''\\-\\s]+$', '', 'g')"


@_query(
    _WITH + f", p AS (SELECT *, {_CLEAN_PROPOSED} AS p FROM contacts), q AS (SELECT *, CASE WHEN p = '' OR len(string_split_regex(p, '\\s+')) > 12 OR {_has('lower(p)', enrich.INSTRUCTIONS)} THEN {_SEARCH} ELSE p END AS q FROM p) "
    f"SELECT row_id, CASE WHEN length(q) BETWEEN 3 AND 100 THEN q WHEN {_NAME} <> '' THEN {_NAME} || ' email' ELSE 'email address' END AS query FROM q"
)
def search_query_proposed(spark, sf):
    return _contacts(spark, sf).select("row_id", enrich.search_term(F.col("first_name"), F.col("last_name"), F.col("current_company"), F.expr(_PROPOSED)).alias("query"))


_PAGE_OF = "'<body><p>Team: info@acme.io, ' || lower(first_name) || '.' || lower(last_name) || '@acme.io or zz' || row_id || '@acme.io</p></body>'"


@_query(
    _ROWS + f"row_id, CASE WHEN {_VALID} THEN email WHEN row_id % 2 = 0 AND first_name <> '' AND last_name <> '' THEN lower(first_name) || '.' || lower(last_name) || '@acme.io' "
    "WHEN row_id % 2 = 0 THEN 'zz' || row_id || '@acme.io' ELSE email END AS email FROM contacts"
)
def enrich_coalesce(spark, sf):
    d = _contacts(spark, sf)
    told = d.where("row_id % 2 = 0").withColumn("html", F.expr(_PAGE_OF))
    found = told.select("row_id", enrich.best_email(enrich.page_emails(F.col("html")), F.col("first_name"), F.col("last_name")).alias("new_email"))
    return enrich.update_emails(d, found).select("row_id", "email")


def _combined_sql(content: str) -> str:
    return (
        _page_sql().replace("FROM b) ", "FROM b), ", 1) + "g AS (SELECT *, floor(page_id / 5)::BIGINT AS grp, row_number() OVER (PARTITION BY floor(page_id / 5) ORDER BY page_id) AS rn FROM p), "
        "t AS (SELECT grp, array_to_string(list(chr(10) || 'PAGE ' || rn || ':' || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || 'TITLE: ' || title || chr(10) || 'CONTENT: ' || substr(text, 1, 5000) || CASE WHEN page_id % 2 = 0 THEN ' [EMAILS_FOUND: info@' || regexp_extract(url, '://([^/?#]*)', 1) || ', sales@' || page_id || '.org]' ELSE '' END || chr(10) || '---' || chr(10) ORDER BY page_id), chr(10)) AS content FROM g GROUP BY grp) "
        f"SELECT grp, {content} AS content FROM t"
    )


def _combined(spark, sf, limit=None) -> DataFrame:
    # addresses made of the page's host, on every second page
    mails = F.expr("CASE WHEN page_id % 2 = 0 THEN array('info@' || regexp_extract(url, '://([^/?#]*)', 1), 'sales@' || page_id || '.org') ELSE array() END")
    p = enrich.pages(_table(spark, sf, "pages")).withColumn("emails", mails).withColumn("grp", F.floor(F.col("page_id") / 5))
    return enrich.combined(p, "grp", limit)


@_query(_combined_sql("content"))
def page_combine(spark, sf):
    return _combined(spark, sf)


@_query(_combined_sql(f"substr(content, 1, {enrich.CONTENT_LIMIT})"))
def page_combine_limited(spark, sf):
    return _combined(spark, sf, enrich.CONTENT_LIMIT)


_TOLD = "'<body><article>News of ' || lower(first_name) || '  ' || upper(last_name) || ', <b>' || current_company || '</b></article></body>'"


@_query(
    _WITH + ", n AS (SELECT row_id, lower(first_name) || ' ' || lower(last_name) AS name FROM contacts WHERE first_name <> '' AND last_name <> ''), t AS (SELECT row_id % 700 AS page_id, min(name) AS name FROM n GROUP BY row_id % 700), "
    "f AS (SELECT name, page_id, row_number() OVER (PARTITION BY name ORDER BY page_id) AS nth FROM t) SELECT row_id, page_id FROM n JOIN f ON f.name = n.name WHERE nth <= 5"
)
def page_link(spark, sf):
    c = _contacts(spark, sf)
    told = c.where("first_name <> '' and last_name <> ''").withColumn("name", F.expr("lower(first_name) || ' ' || lower(last_name)"))
    told = told.groupBy(F.expr("row_id % 700").alias("page_id")).agg(F.min_by(F.expr(_TOLD), "name").alias("html")).withColumn("url", F.lit("http://a.org/"))
    return enrich.linked_pages(c, enrich.pages(told, limit=None))


_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@_query(
    _page_sql().replace("FROM b) ", "FROM b), ", 1) + f"d AS (SELECT doc_id AS row_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), "
    "asked AS (SELECT row_id, list_distinct(list_filter([w[1], w[2], w[5], w[6], w[1] || ' ' || w[2]], lambda x: x IS NOT NULL)) AS terms FROM d), terms AS (SELECT row_id, unnest(terms) AS term FROM asked), "
    f"t AS (SELECT page_id, {_WORDS.format(chr(39).join(['title || ', ' ', ' || text']))} AS w FROM p), postings AS (SELECT DISTINCT page_id, term FROM (SELECT page_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t) WHERE term IN (SELECT term FROM terms)), "
    f"df AS (SELECT term, count(*) > {search.MOST_PAGES} AS hub, floor(1000 * ln((SELECT count(*) FROM pages)::DOUBLE / count(*)))::BIGINT AS gain FROM postings GROUP BY term), "
    "found AS (SELECT DISTINCT row_id, page_id FROM terms JOIN df ON df.term = terms.term AND NOT hub JOIN postings ON postings.term = terms.term), "
    "scored AS (SELECT f.row_id, f.page_id, sum(gain)::BIGINT AS score FROM found f JOIN terms ON terms.row_id = f.row_id JOIN postings q ON q.page_id = f.page_id AND q.term = terms.term JOIN df ON df.term = q.term GROUP BY ALL) "
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, page_id)::INT AS nth FROM scored) WHERE nth <= {search.TOP}"
)
def page_search(spark, sf):
    at = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    asked = _table(spark, sf, "documents").select("doc_id", search.words(F.col("text"), 6).alias("w")).select(F.col("doc_id").alias("row_id"), at(0).alias("first_name"), at(1).alias("last_name"), F.concat_ws(" ", at(4), at(5)).alias("current_company"))
    return search.search(asked, enrich.pages(_table(spark, sf, "pages"), limit=None))


@_query(_page_sql() + "SELECT url, title, substr(text, 1, 5000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS nth FROM p) WHERE nth = 1")
def url_cache_two_runs(spark, sf):
    """All URLs through a cache that a first run over half of the pages has filled."""
    every = _table(spark, sf, "pages")
    first = every.groupBy("url").agg(F.min("page_id").alias("page_id"))
    own = every.join(first, ["url", "page_id"])
    fetch = lambda urls: enrich.pages(own.join(urls, "url")).select("url", "title", "text")
    known = cache.UrlCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", "title string, text string")
    known.through(every.where("page_id % 2 = 0").select("url"), fetch)
    return known.through(every.select("url"), fetch)


# what was written, read again


@_query(
    _WITH + ", e AS (SELECT row_id, email, 1::BIGINT AS expected, CASE row_id % 100 WHEN 7 THEN 0 WHEN 8 THEN 0 ELSE 2 END::BIGINT AS found FROM contacts WHERE row_id % 100 IN (7, 8, 9)) "
    "SELECT * FROM e UNION ALL SELECT row_id, 'x' || email, 0, 1 FROM contacts WHERE row_id % 100 = 7"
)
def export_differences(spark, sf):
    """A copy of an export with changed, missing and repeated rows, compared with the manifest of what was written."""
    at = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    c = stage(_contacts(spark, sf).select(F.col("row_id").cast("string").alias("row_id"), *FIELDS))  # made once; written, digested and compared
    files.write_csv(c, f"{at}/good")
    n = 64
    kept = stage(manifest.manifest(c, n))
    good, turn = files.read_csv(spark, f"{at}/good"), F.col("row_id").cast("long") % 100
    spoilt = good.where(turn != 8).withColumn("email", F.when(turn == 7, F.concat(F.lit("x"), F.coalesce("email", F.lit("")))).otherwise(F.col("email")))
    twice = spoilt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(turn == 9, 2).otherwise(1))))
    files.write_csv(twice.drop("copy"), f"{at}/spoilt")
    same = manifest.differing(kept, manifest.manifest(good, n))  # no bucket differs
    found = manifest.differences(c, files.read_csv(spark, f"{at}/spoilt"), n, kept).select(F.col("row_id").cast("long").alias("row_id"), "email", "expected", "found")
    return found.unionAll(same.select(F.lit(-1).cast("long"), F.lit("bucket"), "expected", "found"))


# names


@_query(
    _WITH + ", n AS (SELECT row_id, '  ' || first_name || '   ' || last_name || ' Jr ' AS t FROM contacts), s AS (SELECT row_id, string_split_regex(trim(t), '\\s+') AS a FROM n) SELECT row_id, a[1] AS first, array_to_string(a[2:], ' ') AS last FROM s"
)
def name_split(spark, sf):
    f, l = people.split_name(F.concat(F.lit("  "), "first_name", F.lit("   "), "last_name", F.lit(" Jr ")))
    return _contacts(spark, sf).select("row_id", f.alias("first"), l.alias("last"))


def _person(v: str) -> str:
    w = f"string_split_regex(trim(coalesce({v}, '')), '\\s+')"
    a = f"list_filter(list_transform({w}, lambda x: regexp_replace(x, '[.,]', '', 'g')), lambda x: regexp_matches(x, '^\\p{{L}}{{2,}}$'))"
    return f"(length(trim(coalesce({v}, ''))) >= 3 AND NOT regexp_matches(lower(coalesce({v}, '')), '@|\\.com|http|www|{'|'.join(people.BUSINESS_IN_NAME)}') AND len({w}) >= 2 AND len({a}) >= 2 AND len(list_filter({a}, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 2)"


@_query(_WITH + f", v AS (SELECT 'c' || row_id AS id, CASE row_id % 4 WHEN 0 THEN first_name || ' ' || last_name WHEN 1 THEN current_company WHEN 2 THEN first_name || ' van ' || last_name || ', Jr.' ELSE email END AS v FROM contacts UNION ALL SELECT 'p' || p_partkey, p_name FROM part) SELECT id, {_person('v')} AS person FROM v")
def person_name_like(spark, sf):
    c = _contacts(spark, sf).select(F.expr("'c' || row_id").alias("id"), F.expr("CASE row_id % 4 WHEN 0 THEN first_name || ' ' || last_name WHEN 1 THEN current_company WHEN 2 THEN first_name || ' van ' || last_name || ', Jr.' ELSE email END").alias("v"))
    p = _table(spark, sf, "part").select(F.expr("'p' || p_partkey").alias("id"), F.col("p_name").alias("v"))
    return c.unionAll(p).select("id", people.person_like(F.col("v")).alias("person"))


# columns

_MESSY = [("Contact Person", "full_name"), ("E-Mail Address", "email"), ("Work Email", "email2"), ("LinkedIn", "linkedin"), ("Organization", "current_company"), ("Job Title", "role"), ("Mobile Phone", "phone"), ("Street Address", "street"), ("City", "geo"), ("Empty", "nothing")]
_MESSY_COLS = {
    "full_name": "first_name || ' ' || last_name", "email": "email", "email2": "CASE WHEN row_id % 2 = 0 THEN email END", "linkedin": "linkedin", "current_company": "current_company", "role": "role", "phone": "phone",
    "street": "'Road ' || (row_id % 90 + 1000)", "geo": "geo", "nothing": "CAST(NULL AS VARCHAR(9))",
}
_CELLS = _WITH.replace("WITH RECURSIVE", "WITH", 1) + ", cells AS (" + " UNION ALL ".join(f"SELECT row_id, {i} AS pos, {_q(h)} AS col_name, {_MESSY_COLS[c]} AS value FROM contacts_raw" for i, (h, c) in enumerate(_MESSY)) + ")"


def _messy(spark, sf) -> DataFrame:
    return contacts_raw(spark, sf).select("row_id", *(F.expr(_MESSY_COLS[c]).alias(h) for h, c in _MESSY))


def _cells(spark, sf) -> DataFrame:
    return columns.unpivot(_messy(spark, sf), [h for h, _ in _MESSY])


@_query(
    _CELLS + ", r AS (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY row_id) AS nth FROM cells WHERE value IS NOT NULL), f AS (SELECT col_name, array_to_string(list(value ORDER BY nth) FILTER (nth <= 3), '|') AS s, bool_or(regexp_matches(value, '@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS e, bool_or(regexp_matches(value, '(?i)https?://')) AS u, bool_or(regexp_matches(value, '[0-9]{3,}')) AS p FROM r WHERE nth <= 10 GROUP BY col_name) "
    "SELECT c.col_name, count(value) AS non_null_count, (count(*) - count(value)) * 100 / count(*)::DOUBLE AS null_percentage, count(DISTINCT value) AS unique_count, coalesce(any_value(s), '') AS sample_values, coalesce(any_value(e), false) AS has_email, coalesce(any_value(u), false) AS has_url, coalesce(any_value(p), false) AS has_phone FROM cells c LEFT JOIN f ON f.col_name = c.col_name GROUP BY c.col_name"
)
def column_profile(spark, sf):
    return columns.profile(_cells(spark, sf))


def _rules_sql() -> str:
    n = "lower(col_name)"
    return (
        f", s AS (SELECT col_name, coalesce(value, 'nan') AS v FROM cells WHERE row_id < 5 AND trim(coalesce(value, 'nan')) <> ''), a AS (SELECT col_name, avg({_person('v')}::INT) AS people, bool_or(contains(v, '@')) AS has_at, bool_or(contains(lower(v), 'linkedin.com')) AS link, bool_or(regexp_matches(v, '[0-9]') AND length(v) > 6) AS digits FROM s GROUP BY col_name), "
        f"mapping AS (SELECT * FROM (SELECT col_name, CASE WHEN {_has(n, columns.FULL_NAME_WORDS)} AND people >= 0.4 THEN 'FULL_NAME_TO_SPLIT' WHEN has_at OR contains({n}, 'email') THEN 'email' WHEN link OR contains({n}, 'linkedin') THEN 'linkedin' WHEN contains({n}, 'first') AND contains({n}, 'name') THEN 'first_name' WHEN contains({n}, 'last') AND contains({n}, 'name') THEN 'last_name' "
        f"WHEN {_has(n, ['company', 'organization', 'account name'])} THEN 'current_company' WHEN {_has(n, ['title', 'role', 'position', 'designation'])} THEN 'role' WHEN digits THEN CASE WHEN {_has(n, ['phone', 'mobile'])} THEN 'phone' END WHEN {_has(n, ['city', 'location', 'address', 'geo'])} THEN 'geo' END AS target FROM a) WHERE target IS NOT NULL)"
    )


_QUALITY_SQL = (
    f", q AS (SELECT c.col_name, target, (2 * count(*) + sum(CASE target WHEN 'email' THEN 10 * contains(value, '@')::INT WHEN 'linkedin' THEN 10 * contains(lower(value), 'linkedin.com')::INT WHEN 'phone' THEN 8 * regexp_matches(value, '[0-9]{{3}}')::INT WHEN 'current_company' THEN 3 * {_has('lower(value)', columns.BUSINESS)}::INT WHEN 'first_name' THEN 5 * {_person('value')}::INT WHEN 'last_name' THEN 5 * {_person('value')}::INT ELSE 0 END) + floor(20.0 * count(DISTINCT value) / count(*)))::BIGINT AS score FROM cells c JOIN mapping m ON m.col_name = c.col_name WHERE value IS NOT NULL GROUP BY ALL), "
    "quality AS (SELECT DISTINCT c.col_name, m.target, c.pos, coalesce(q.score, 0) AS score FROM cells c JOIN mapping m ON m.col_name = c.col_name LEFT JOIN q ON q.col_name = c.col_name)"
)


@_query(_CELLS + _rules_sql() + " SELECT col_name, target FROM mapping")
def column_mapping(spark, sf):
    return columns.map_columns(_cells(spark, sf))


@_query(_CELLS + _rules_sql() + _QUALITY_SQL + " SELECT * FROM quality")
def column_quality(spark, sf):
    c = _cells(spark, sf)
    return columns.column_quality(c, columns.valid_mapping(columns.map_columns(c)))


@_query(_CELLS + _rules_sql() + _QUALITY_SQL + " SELECT target, col_name, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, pos) AS r FROM quality) WHERE r = 1")
def best_column(spark, sf):
    return columns.best_columns(column_quality(spark, sf))


_S = "SELECT row_id, split_part(trim(fn), ' ', 1) AS first_name, trim(substr(trim(fn), length(split_part(trim(fn), ' ', 1)) + 1)) AS last_name, coalesce(current_company, '') AS current_company, coalesce(role, '') AS role, coalesce(linkedin, '') AS linkedin, coalesce(email, '') AS email, coalesce(phone, '') AS phone, coalesce(geo, '') AS geo"


@_query(f"WITH contacts_raw AS ({contacts_sql()}), n AS (SELECT *, coalesce(first_name || ' ' || last_name, '') AS fn FROM contacts_raw) {_S} FROM n")
def standardize(spark, sf):
    m = {"Contact Person": "FULL_NAME_TO_SPLIT", "E-Mail Address": "email", "LinkedIn": "linkedin", "Organization": "current_company", "Job Title": "role", "Mobile Phone": "phone", "City": "geo"}
    return columns.standardize(_messy(spark, sf), m, ("row_id",))


_GRID = [
    ("a", 0, ["Event link: https://x.org", None, None, None]), ("a", 1, ["First Name", "Last Name", "Email", "Company"]), ("a", 2, ["Ann", "Lee", "ann@acme.io", "Acme"]),
    ("b", 0, ["Name", "Phone number", "Profile URL", "Job title"]), ("b", 1, ["Contact name", "Phone", "LinkedIn profile", "Role"]), ("b", 7, ["First name", "last name", "email", "company"]),
    ("c", 0, ["x", None, None, None]), ("c", 1, [" ", "y", None, None]), ("d", 0, ["Unnamed: 0", "account", "requests", "Location"]), ("d", 1, ["id", "no", "#", "address " + "z" * 120 + "email"]),
]


_TITLE = ["Export of the list"] + [None] * (len(_MESSY) - 1)


def _grid_sql() -> str:
    rows = ", ".join("(" + f"{_q(s)}, {i}, [" + ", ".join("NULL" if c is None else _q(c) for c in cells) + "])" for s, i, cells in _GRID)
    text = "array_to_string(list_transform(filled, lambda c: lower(substr(c, 1, 100))), ' ')"
    score = " + ".join(f"3 * contains(text, {_q(w)})::INT" for w in columns.HEADER_WORDS) + f" + 2 * {_has('text', ['id', 'number', 'no', '#'])}::INT + 2 * {_has('text', ['profile', 'url', 'link'])}::INT + (len(list_filter(filled, lambda c: length(trim(c)) < 20)) >= 3)::INT - " + " - ".join(f"5 * contains(text, {_q(w)})::INT" for w in columns.METADATA)
    own = ", ".join(f"({_MESSY_COLS[c]})::VARCHAR" for _, c in _MESSY)
    line = lambda cells: "[" + ", ".join("NULL" if c is None else _q(c) for c in cells) + "]"
    heads = f"SELECT DISTINCT source_file, 0, {line(_TITLE)} FROM contacts_raw UNION ALL SELECT DISTINCT source_file, 1, {line([h for h, _ in _MESSY])} FROM contacts_raw"
    return f"WITH contacts_raw AS ({contacts_sql()}), g(sheet, row_idx, cells) AS (VALUES {rows} UNION ALL SELECT source_file, 2 + row_id // 3, [{own}] FROM contacts_raw UNION ALL {heads}), s AS (SELECT sheet, row_idx::BIGINT AS row_idx, list_filter(cells, lambda c: c IS NOT NULL) AS filled FROM g WHERE row_idx < 6), t AS (SELECT *, {text} AS text FROM s), scores AS (SELECT sheet, row_idx, ({score} - 10 * (len(list_filter(filled, lambda c: trim(c) <> '')) < 3)::INT)::INT AS score FROM t) "


def _grid(spark, sf) -> DataFrame:
    """Hand-made sheets, and a sheet of each contact source with a title and a header above its rows."""
    made = spark.createDataFrame(_GRID, "sheet string, row_idx long, cells array<string>")
    raw = contacts_raw(spark, sf)
    rows = raw.select(F.col("source_file").alias("sheet"), F.expr("2 + row_id div 3").alias("row_idx"), F.array(*(F.expr(_MESSY_COLS[c]).cast("string") for _, c in _MESSY)).alias("cells"))
    line = lambda i, cells: raw.select("source_file").distinct().select("source_file", F.lit(i).cast("long"), F.array(*(F.lit(c).cast("string") for c in cells)))
    return made.unionAll(rows).unionAll(line(0, _TITLE)).unionAll(line(1, [h for h, _ in _MESSY]))


@_query(_grid_sql() + "SELECT * FROM scores")
def header_scores(spark, sf):
    return columns.header_scores(_grid(spark, sf))


@_query(_grid_sql() + "SELECT sheet, CASE WHEN max(score) > 0 THEN arg_max(row_idx, score * 100 - row_idx) END AS header_row FROM scores GROUP BY sheet")
def header_pick(spark, sf):
    return columns.header_pick(_grid(spark, sf))


# workbooks: the contacts in books of up to 20,000 rows, a sheet for each source, read again sheet by sheet

_BOOK = 20_000


def _write_books(spark, sf, folder: str) -> None:
    def write(part):
        out, at = workbooks.opened(folder)
        out.create_dir(at)
        sheets = {f"s{k}": [["id", "name", None, "email"], *([str(r.row_id), r.name, None, r.email] for r in rows.itertuples())] for k, rows in part.sort_values("row_id").groupby("sheet")}
        with out.open_output_stream(f"{at}/book{part['book'].iloc[0]}.xlsx") as f:
            f.write(workbooks.workbook(sheets))
        return part[["book"]].head(1)

    c = contacts_raw(spark, sf).selectExpr("row_id", "first_name || ' & ' || last_name AS name", "email", "row_id % 3 AS sheet", f"row_id div {_BOOK} AS book")
    c.groupBy("book").applyInPandas(lambda x: write(x.astype(object).where(x.notna(), None)), "book long").count()


@_query(
    f"WITH c AS (SELECT row_id, first_name || ' & ' || last_name AS name, email, row_id % 3 AS s, row_id // {_BOOK} AS book FROM ({contacts_sql()})), "
    "r AS (SELECT book, 's' || s AS sheet, row_number() OVER (PARTITION BY book, s ORDER BY row_id) AS row_idx, row_id::VARCHAR AS id, name, email FROM c UNION ALL SELECT DISTINCT book, 's' || s, 0, 'id', 'name', 'email' FROM c) SELECT * FROM r"
)
def workbook_cells(spark, sf):
    folder = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    _write_books(spark, sf, folder)
    spark.dataSource.register(workbooks.WorkbookSource)
    cell = lambda i: F.get("cells", F.lit(i))
    return spark.read.format("workbook").load(folder).select(F.regexp_extract("file", r"book(\d+)\.xlsx$", 1).cast("long").alias("book"), "sheet", "row_idx", cell(0).alias("id"), cell(1).alias("name"), cell(3).alias("email"))


# files: the contacts, written as one CSV file for each source with a line above the header, and read again


def _files(spark, sf) -> tuple[DataFrame, DataFrame]:
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    d = contacts_raw(spark, sf)
    top = [h for h, _ in _MESSY]
    text = [F.col(f"`{h}`").cast("string").alias(f"c{i}") for i, h in enumerate(top)]
    body = d.select("source_file", F.lit(2).alias("part"), "row_id", *(F.expr(_MESSY_COLS[c]).alias(h) for h, c in _MESSY)).select("source_file", "part", "row_id", *text)
    names = d.select("source_file").distinct()
    # a title above the header, as exports have it
    title = names.select("source_file", F.lit(0).alias("part"), F.lit(0).cast("long").alias("row_id"), *(F.lit("Export of the list" if i == 0 else None).cast("string").alias(f"c{i}") for i in range(len(top))))
    head = names.select("source_file", F.lit(1).alias("part"), F.lit(0).cast("long").alias("row_id"), *(F.lit(h).alias(f"c{i}") for i, h in enumerate(top)))
    rows = title.unionAll(head).unionAll(body).repartition("source_file").sortWithinPartitions("source_file", "part", "row_id")
    options = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    rows.drop("part", "row_id").write.partitionBy("source_file").options(**options).csv(folder)
    cells, failed = files.load(spark, folder)
    named = F.regexp_extract("file", "source_file=([^/]*)/", 1)
    return cells.withColumn("file", named), failed.withColumn("file", named)


_TOLD_MAP = {"Contact Person": "FULL_NAME_TO_SPLIT", "Work Email": "email", "Organization": "current_company", "Empty": "no such field"}


def told_mapping(names: list[str], rows: list[list[str | None]]) -> dict:
    """A stand-in for a mapping model: looks names up, and answers for whole sheets only."""
    return {"field_mappings": {n: _TOLD_MAP[n] for n in names if n in _TOLD_MAP}, "quality_score": 100 if len(rows) == columns.SAMPLES else 0}


@_query(f"SELECT file, c AS col_name, t AS target, 100.0::DOUBLE AS score FROM (SELECT DISTINCT source_file AS file FROM ({contacts_sql()})), (VALUES " + ", ".join(f"({_q(c)}, {_q(t)})" for c, t in _TOLD_MAP.items()) + ") v(c, t)")
def hook_mapping(spark, sf):
    """What a mapping hook says of each file's columns; files of equal headers are asked for once."""
    from .plans.pipeline import _hooked

    cells, _ = _files(spark, sf)
    grid = cells.select(F.col("file").alias("sheet"), "row_idx", "cells")
    heads = columns.headers(grid)
    told, scores = _hooked(heads, columns.table_cells(grid, heads, 3), told_mapping)
    return told.join(scores, "sheet").select(F.col("sheet").alias("file"), "col_name", "target", "score")


_LISTS = f"WITH contacts_raw AS ({contacts_sql()})"


@_query(_LISTS + " SELECT source_file AS file, true AS readable, 1::BIGINT AS n_sheets, count(*) + 2 AS n_rows, NULL::VARCHAR AS error FROM contacts_raw GROUP BY source_file")
def files_verify(spark, sf):
    return files.verify(*_files(spark, sf))


@_query(_LISTS + f" SELECT DISTINCT source_file AS file, 1::BIGINT AS header_row, {_q('|'.join(h for h, _ in _MESSY))} AS names FROM contacts_raw")
def files_headers(spark, sf):
    heads = columns.headers(_files(spark, sf)[0].withColumn("sheet", F.col("file")))
    return heads.select(F.col("sheet").alias("file"), "header_row", F.array_join("names", "|").alias("names"))


@_query(
    _LISTS + ", n AS (SELECT *, coalesce(first_name || ' ' || last_name, '') AS fn FROM contacts_raw) " + _S.replace("SELECT row_id,", "SELECT source_file AS file, row_number() OVER (PARTITION BY source_file ORDER BY row_id) - 1 AS row_id,").replace("coalesce(geo, '') AS geo", "'' AS geo") + " FROM n"
)  # the nations' names have digits, so the rules map City to nothing
def files_standardized(spark, sf):
    grid = _files(spark, sf)[0].withColumn("sheet", F.col("file"))
    heads = columns.headers(grid)
    n = heads.count()
    cells, by = columns.table_cells(grid, heads, n), ("sheet",)
    chosen = columns.best_columns(columns.column_quality(cells, columns.valid_mapping(columns.map_columns(cells, by)), by), by)
    return columns.standardize_sheets(grid, heads, chosen, n).withColumnRenamed("sheet", "file")


# deduplication

_DIGITS = "regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')"
_RATIO = (
    "CASE WHEN length(a) + length(b) = 0 THEN 100.0 ELSE 200.0 * (length(a) - bit_count(list_reduce(list_prepend((1::BIGINT << length(a)) - 1, list_transform(string_split(b, ''), lambda ch: "
    "list_sum(list_transform(range(0, length(a)), lambda i: CASE WHEN a[i + 1] = ch THEN 1::BIGINT << i ELSE 0 END))::BIGINT)), lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(a)) - 1)))) / (length(a) + length(b)) END"
)


def _pairs_sql(nan: bool = False) -> str:
    part = (lambda c: f"coalesce(nullif({c}, ''), 'nan')") if nan else (lambda c: c)
    mail = "coalesce(nullif(lower(trim(email)), ''), 'nan')" if nan else "lower(trim(email))"
    return (
        f", e AS (SELECT row_id, {mail} AS k FROM contacts), ep AS (SELECT x.row_id AS i, y.row_id AS j, 95.0::DOUBLE AS score, 'email_match' AS reason FROM e x JOIN e y ON x.k = y.k AND x.row_id < y.row_id WHERE x.k <> ''), "
        f"h AS (SELECT row_id, {_DIGITS} AS k FROM contacts), pp AS (SELECT x.row_id AS i, y.row_id AS j, 90.0::DOUBLE AS score, 'phone_match' AS reason FROM h x JOIN h y ON x.k = y.k AND x.row_id < y.row_id WHERE length(x.k) >= 10), "
        f"nm AS (SELECT row_id, lower(trim({part('first_name')} || ' ' || {part('last_name')})) AS k FROM contacts), dn AS (SELECT DISTINCT k FROM nm WHERE k <> ''), "
        "close AS MATERIALIZED (SELECT x.k AS a, y.k AS b FROM dn x JOIN dn y ON x.k < y.k AND abs(length(x.k) - length(y.k)) <= 0.25 * (length(x.k) + length(y.k)) AND levenshtein(x.k, y.k) <= 0.25 * (length(x.k) + length(y.k))), "
        f"sim AS (SELECT a, b, ({_RATIO})::DOUBLE AS score FROM close UNION ALL SELECT k, k, 100.0 FROM dn), "
        "np AS (SELECT least(x.row_id, y.row_id) AS i, greatest(x.row_id, y.row_id) AS j, score, 'name_match' AS reason FROM sim JOIN nm x ON x.k = a JOIN nm y ON y.k = b WHERE score >= 75 AND (a <> b OR x.row_id < y.row_id)), "
        "cand AS MATERIALIZED (SELECT i, j, arg_min(score, r) AS score, arg_min(reason, r) AS reason FROM (SELECT *, 0 AS r FROM ep UNION ALL SELECT *, 1 FROM pp UNION ALL SELECT *, 2 FROM np) GROUP BY i, j)"
    )


_MIS = (
    ", ok AS MATERIALIZED (SELECT * FROM {cand} WHERE score >= 90), nb AS (SELECT row_number() OVER (ORDER BY v) AS k, v, lows FROM (SELECT j AS v, list(i) AS lows FROM ok GROUP BY j)), "
    "f(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT f.k + 1, CASE WHEN len(list_filter(nb.lows, lambda u: NOT list_contains(f.gone, u))) > 0 THEN list_append(f.gone, nb.v) ELSE f.gone END FROM f JOIN nb ON nb.k = f.k + 1), "
    "gone AS MATERIALIZED (SELECT unnest(gone) AS v FROM (SELECT gone FROM f ORDER BY k DESC LIMIT 1)), removed AS MATERIALIZED (SELECT j AS row_id, min(i) AS parent FROM ok WHERE j IN (SELECT v FROM gone) AND i NOT IN (SELECT v FROM gone) GROUP BY j)"
)


@_query(_WITH + _pairs_sql() + " SELECT * FROM ep")
def dedup_email_pairs(spark, sf):
    return dedup.email_pairs(_contacts(spark, sf))


@_query(_WITH + _pairs_sql() + " SELECT * FROM pp")
def dedup_phone_pairs(spark, sf):
    return dedup.phone_pairs(_contacts(spark, sf))


@_query(_WITH + _pairs_sql() + " SELECT * FROM np")
def dedup_name_pairs(spark, sf):
    return dedup.name_pairs(_contacts(spark, sf))


@_query(_WITH + _pairs_sql() + " SELECT * FROM cand")
def dedup_candidates(spark, sf):
    return dedup.candidates(_contacts(spark, sf))


@_query(_WITH + _pairs_sql(nan=True) + " SELECT * FROM cand ORDER BY i, j LIMIT 10000")
def dedup_compat_nan(spark, sf):
    return dedup.candidates(_contacts(spark, sf), compat_nan=True, cap=10_000)


@_query(_WITH + _pairs_sql() + _MIS.format(cand="cand") + " SELECT * FROM removed")
def dedup_removed(spark, sf):
    return dedup.removed(_contacts(spark, sf))


@_query(_WITH + _pairs_sql() + _MIS.format(cand="cand") + " SELECT row_id FROM contacts ANTI JOIN gone ON row_id = v")
def dedup_survivors(spark, sf):
    df = _contacts(spark, sf)
    return df.select("row_id").join(dedup.removed(df).select("row_id"), "row_id", "left_anti")


@_query(_WITH + _pairs_sql() + _MIS.format(cand="cand") + ", o AS (SELECT c.*, coalesce(parent, c.row_id) AS owner FROM contacts c LEFT JOIN removed r ON r.row_id = c.row_id) SELECT owner AS row_id, " + ", ".join(f"arg_max({f}, length({f}) * 10000000000 - row_id) FILTER ({f} <> '') AS {f}" for f in [*FIELDS, "source_file"]) + " FROM o GROUP BY owner")
def dedup_merged(spark, sf):
    df = _contacts(spark, sf)
    return dedup.merged(df, dedup.removed(df))


@_query(_WITH + _pairs_sql() + _MIS.format(cand="cand") + " SELECT (SELECT count(*) FROM contacts) AS initial_count, (SELECT count(*) FROM cand) AS duplicate_candidates, (SELECT count(*) FROM ok) AS confirmed_duplicates, (SELECT count(*) FROM contacts) - (SELECT count(*) FROM gone) AS final_count")
def dedup_stats(spark, sf):
    return dedup.stats(_contacts(spark, sf))


def _groups_sql(table: str, score: float, reason: str, least: int = 1) -> str:
    return f"SELECT '{reason}' AS reason, {score}::DOUBLE AS score, k AS value, min(row_id) AS representative, count(*) AS members, (count(*) * (count(*) - 1) // 2)::BIGINT AS links FROM {table} WHERE length(k) >= {least} GROUP BY k HAVING count(*) > 1"


@_query(_WITH + _pairs_sql() + " " + " UNION ALL ".join(_groups_sql(*x) for x in (("e", 95.0, "email_match"), ("h", 90.0, "phone_match", 10), ("nm", 100.0, "name_match"))))
def dedup_value_groups(spark, sf):
    return dedup.value_groups(_contacts(spark, sf))


@_query(_WITH + _pairs_sql() + ", c AS (SELECT k, min(row_id) AS r, count(*) AS n FROM nm GROUP BY k) SELECT a, b, score, x.r AS representative_a, y.r AS representative_b, x.n * y.n AS links FROM sim JOIN c x ON x.k = a JOIN c y ON y.k = b WHERE a < b AND score >= 75")
def dedup_name_links(spark, sf):
    return dedup.name_links(_contacts(spark, sf))


# export and quality


def _renamed(names: list[str], cols: dict[str, str]) -> str:
    return ", ".join(f'{cols.get(f, f)} AS "{h}"' for f, h in zip(FIELDS, names, strict=True))


_EXPORTS = {
    "standard": f"SELECT {_renamed(list(HEADERS.values()), {})} FROM contacts",
    "apollo": f"SELECT {_renamed(APOLLO, {'phone': 'trim(phone)'})} FROM contacts WHERE email <> '' OR current_company <> '' OR linkedin <> ''",
    "hubspot": f"SELECT {_renamed(HUBSPOT, {'linkedin': chr(40) + 'CASE WHEN regexp_matches(linkedin, ' + _q('(?i)linkedin.com') + ') THEN trim(linkedin) ELSE ' + _q('') + ' END)'})} FROM contacts WHERE first_name <> '' OR last_name <> '' OR email <> ''",
}


@_query(_WITH + " " + _EXPORTS["standard"])
def export_standard(spark, sf):
    return export.standard(_contacts(spark, sf))


@_query(_WITH + " " + _EXPORTS["apollo"])
def export_apollo(spark, sf):
    return export.apollo(_contacts(spark, sf))


@_query(_WITH + " " + _EXPORTS["hubspot"])
def export_hubspot(spark, sf):
    return export.hubspot(_contacts(spark, sf))


@_query(_ROWS + " UNION ALL SELECT ".join(f"'{k}' AS export, (SELECT count(*) FROM ({s})) AS n" for k, s in _EXPORTS.items()))
def export_report(spark, sf):
    return export.report(_contacts(spark, sf))


_PHONE_OK = "(" + " OR ".join(f"regexp_matches(trim(coalesce(phone, '')), {_q(p)})" for p in people.PHONES) + ")"
_LINK_OK = f"regexp_matches(lower(coalesce(linkedin, '')), {_q('|'.join(people.PROFILES))})"


@_query(_ROWS + f"row_id, {_PHONE_OK} AS valid, regexp_matches({_DIGITS}, '^[0-9]{{10,15}}$') AS digits_valid FROM contacts")
def phone_valid(spark, sf):
    return _contacts(spark, sf).select("row_id", people.phone_valid(F.col("phone")).alias("valid"), people.norm_phone(F.col("phone")).rlike("^[0-9]{10,15}$").alias("digits_valid"))


@_query(_ROWS + f"row_id, {_LINK_OK} AS valid FROM contacts")
def linkedin_valid(spark, sf):
    return _contacts(spark, sf).select("row_id", people.profile_valid(F.col("linkedin")).alias("valid"))


@_query(
    _WITH + ", m AS (" + " UNION ALL ".join(
        f"SELECT '{k}' AS metric, coalesce(({v})::DOUBLE, 0.0) AS value, {QUALITY[k]}::DOUBLE AS threshold FROM contacts"
        for k, v in (
            ("name_coverage", "count(*) FILTER (first_name <> '' OR last_name <> '') / count(*)::DOUBLE"),
            ("email_validity", f"count(*) FILTER (email <> '' AND {_VALID}) / nullif(count(*) FILTER (email <> ''), 0)::DOUBLE"),
            ("linkedin_validity", f"count(*) FILTER (linkedin <> '' AND {_LINK_OK}) / nullif(count(*) FILTER (linkedin <> ''), 0)::DOUBLE"),
            ("phone_validity", f"count(*) FILTER (phone <> '' AND {_PHONE_OK}) / nullif(count(*) FILTER (phone <> ''), 0)::DOUBLE"),
            ("completeness", f"avg(({_FULL}) * 100 / 8.0) / 100"),
        )
    ) + ") SELECT *, value >= threshold AS passed FROM m"
)
def quality_gate(spark, sf):
    return quality.gate(_contacts(spark, sf))
