"""Enrichment: page texts and their addresses, URL filters, search terms and the update of contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emails
from ..functions.pages import page_parts
from ..functions.text import collapse, trim_all
from .search import words

#: Parts of URLs that are left out; addresses of nobody in particular; what a search term doesn't say; longest text of a page, and of the pages of a contact; pages of a contact.
SKIPPED_URLS = ["javascript:", "mailto:", "tel:", "ftp:", "youtube.com", "facebook.com", "twitter.com", "instagram.com", "pinterest.com", "tiktok.com", "reddit.com", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".tar", ".gz"]
GENERIC = ["info", "support", "hello", "contact", "admin", "sales"]
INSTRUCTIONS = ["create", "generate", "find", "search for", "looking for"]
TEXT_LIMIT, CONTENT_LIMIT, PAGES_LIMIT = 5000, 6000, 5


def page_text(html: Column, limit: int | None = None) -> Column:
    """Main text of a page, see functions.pages.parse."""
    t = page_parts(html)["text"]
    return t if limit is None else F.substring(t, 1, limit)


def page_emails(html: Column) -> Column:
    """Sorted distinct addresses of a page: plain, encoded and obfuscated; taken from the whole main text."""
    return page_parts(html)["emails"]


def pages(df: DataFrame, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """page_id, url, title, text (its first limit characters, or all), emails; each page is parsed once."""
    p = df.select("page_id", "url", page_parts(F.col("html")).alias("p"))
    return p.select("page_id", "url", "p.title", (F.col("p.text") if limit is None else F.substring("p.text", 1, limit)).alias("text"), "p.emails")


def linked_pages(contacts: DataFrame, parsed: DataFrame, most: int = PAGES_LIMIT) -> DataFrame:
    """(row_id, page_id): for each contact the first most pages, by page_id, whose main text has the contact's first and last name as neighbouring words. parsed: page_id, text, as pages() gives them.

    Word pairs of all pages meet the names that contacts have; a name keeps its first pages before they meet its contacts, so a common name multiplies nothing. Names of more than two words
    count with their first and last word; contacts without both names are linked with nothing.
    """
    f, l = words(F.col("first_name")), words(F.col("last_name"))
    key = F.concat_ws(" ", F.get(f, F.lit(0)), F.try_element_at(l, F.lit(-1)))
    named = contacts.select("row_id", F.when((F.size(f) > 0) & (F.size(l) > 0), key).alias("name")).where("name is not null")
    w = F.col("w")
    beside = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = parsed.select("page_id", words(F.col("text")).alias("w")).select("page_id", F.explode(F.array_distinct(beside)).alias("name"))
    met = pairs.join(named.select("name").distinct(), "name", "left_semi")
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("page_id"))).where(F.col("nth") <= most).select("name", "page_id")
    return named.join(first, "name").select("row_id", "page_id")


def url_ok(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    bad = F.lit(False)
    for p in SKIPPED_URLS:
        bad = bad | low.contains(p)
    return ~bad & F.coalesce(c.startswith("http://") | c.startswith("https://"), F.lit(False))


def distinct_urls(df: DataFrame) -> DataFrame:
    """The first page of each accepted URL."""
    return df.where(url_ok(F.col("url"))).groupBy("url").agg(F.min("page_id").alias("page_id"))


def search_term(first: Column, last: Column, company: Column, proposed: Column | None = None) -> Column:
    """A model's proposal without quotes around it, if it is short and no instruction; else name company email. Unfit lengths fall back to name email."""
    name = collapse(F.concat_ws(" ", first, last))
    q = F.concat_ws(" ", F.when(name != "", name), F.when(F.coalesce(company, F.lit("")) != "", company), F.lit("email"))
    if proposed is not None:
        p = F.regexp_replace(F.coalesce(proposed, F.lit("")), r"^[\"'\-\s]+|[\"'\-\s]+$", "")
        told = F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) > 12
        for phrase in INSTRUCTIONS:
            told = told | F.lower(p).contains(phrase)
        q = F.when((p == "") | told, q).otherwise(p)
    return F.when(F.length(q).between(3, 100), q).when(name != "", F.concat(name, F.lit(" email"))).otherwise("email address")


def combined(pages_: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """One text for each value of by, its pages numbered in order of page_id; limit keeps its first characters. A group's pages are gathered: by must have few pages to a value, as linked_pages gives them."""
    n = lambda c: F.coalesce(c, F.lit(""))
    mails = lambda p: F.when(F.size(p["emails"]) > 0, F.concat(F.lit(" [EMAILS_FOUND: "), F.array_join(p["emails"], ", "), F.lit("]"))).otherwise("")
    head = lambda p, i: F.concat(F.lit("\nPAGE "), (i + 1).cast("string"), F.lit(":\nURL: "), n(p["url"]), F.lit("\nTITLE: "), n(p["title"]), F.lit("\nCONTENT: "), n(p["text"]), mails(p), F.lit("\n---\n"))
    rows = F.array_sort(F.collect_list(F.struct("page_id", "url", "title", "text", "emails")))
    content = F.array_join(F.transform(rows, head), "\n")
    return pages_.groupBy(by).agg((content if limit is None else F.substring(content, 1, limit)).alias("content"))


def best_email(found: Column, first: Column, last: Column) -> Column:
    """Of several addresses the one whose local part holds the first or last name, then any that isn't generic, then the smallest."""
    f, l = (F.lower(trim_all(F.coalesce(c, F.lit("")))) for c in (first, last))
    local = lambda e: F.substring_index(F.lower(e), "@", 1)
    own = lambda e: ((f != "") & local(e).contains(f)) | ((l != "") & local(e).contains(l))
    rank = lambda e: F.when(own(e), 0).when(local(e).isin(GENERIC), 2).otherwise(1)
    good = F.filter(F.transform(found, emails.clean_email), lambda e: e.isNotNull())
    return F.get(F.transform(F.array_sort(F.transform(good, lambda e: F.struct(rank(e).alias("r"), e.alias("e")))), lambda x: x["e"]), F.lit(0))


def update_emails(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with email replaced where it needs to be and found (row_id, new_email) has one, the smallest of several; rows stay."""
    one = found.groupBy("row_id").agg(F.min("new_email").alias("new_email"))
    d = df.join(one, "row_id", "left")
    return d.withColumn("email", F.when(emails.needs_enrichment(F.col("email")), F.coalesce("new_email", "email")).otherwise(F.col("email"))).drop("new_email")
