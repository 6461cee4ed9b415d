"""Email expressions: validity, cleaning, extraction and the undoing of obfuscation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_all

#: Patterns and token lists.
STANDARD = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
AT_WORD = r"\b[a-zA-Z0-9._%+-]+\s*(?:at|AT)\s*[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
AT_WORD_STRICT = r"\b[a-zA-Z0-9._%+-]+(?:\s+(?:at|AT)\s+|\s*[\[(]\s*(?:at|AT)\s*[\])]\s*)[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
DOT_WORD = r"(?i)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]*(?:\[dot\]|\(dot\)|\.)[a-zA-Z0-9.-]*[a-zA-Z]{2,}\b"
SPACED = r"\b[a-zA-Z0-9._%+-]+\s*@\s*[a-zA-Z0-9.-]+\s*\.\s*[a-zA-Z]{2,}\b"
BRACKETS = r"\b[A-Za-z0-9._%+-]+\s*\[\s*@\s*\]\s*[A-Za-z0-9.-]+\s*\[\s*\.\s*\]\s*[A-Z|a-z]{2,}\b"
AT_DOT = r"\b[A-Za-z0-9._%+-]+(?:\s*\[?\s*at\s*\]?\s*)[A-Za-z0-9.-]+(?:\s*\[?\s*dot\s*\]?\s*)[A-Z|a-z]{2,}\b"
PREFIXES = r"^(?:email:|e-mail:|contact:)\s*"
INVALID = ["nan", "null", "none", "", "n/a", "not available", "no email", "unknown", "tbd", "to be determined", "missing", "email not found", "no data", "not found", "na", "nil"]
PLACEHOLDERS = "example|test|dummy|placeholder"
REJECTED = ["", "empty string", "not found", "n/a", "none", "null"]


def norm_email(c: Column) -> Column:
    return F.lower(trim_all(c))


def _standard_at_start(c: Column) -> Column:
    return c.rlike("^(?:" + STANDARD + ")")


def _domain(c: Column) -> Column:
    return F.coalesce(F.get(F.split(c, "@"), F.lit(1)), F.lit(""))


def is_valid_email(c: Column) -> Column:
    """A standard address at the start whose domain holds no placeholder word; null counts as invalid."""
    t = norm_email(F.coalesce(c, F.lit("")))
    return ~t.isin(INVALID) & _standard_at_start(t) & ~_domain(t).rlike(PLACEHOLDERS)


def needs_enrichment(c: Column) -> Column:
    t = norm_email(F.coalesce(c, F.lit("")))
    return ~(is_valid_email(c) & t.contains("@") & t.contains("."))


def clean_email(c: Column) -> Column:
    """Lower-cased, without prefix and quotes; null unless a standard address stands at the start."""
    t = F.regexp_replace(norm_email(F.coalesce(c, F.lit(""))), PREFIXES, "")
    t = F.regexp_replace(t, r"^[\"'()\[\]{}]+|[\"'()\[\]{}]+$", "")
    return F.when(~t.isin(REJECTED) & _standard_at_start(t), t)


def extract_emails(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(STANDARD), F.lit(0))


def _matches(c: Column, pattern: str, rewrite) -> Column:
    """Rewritten matches that are standard addresses."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)), rewrite), _standard_at_start)


def extract_at_word(c: Column, strict: bool = False) -> Column:
    """name at domain.tld; not strict, no delimiter is needed, so matthew.com gives m@thew.com."""
    fix = r"\s*[\[(]?(?:at|AT)[\])]?\s*" if strict else r"\s*(?:at|AT)\s*"
    return _matches(c, AT_WORD_STRICT if strict else AT_WORD, lambda m: F.regexp_replace(m, fix, "@"))


def extract_dot_word(c: Column) -> Column:
    return _matches(c, DOT_WORD, lambda m: F.regexp_replace(m, r"(?i)\[dot\]|\(dot\)", "."))


def extract_spaced(c: Column) -> Column:
    return _matches(c, SPACED, lambda m: F.regexp_replace(m, r"\s+", ""))


def extract_brackets(c: Column) -> Column:
    return _matches(c, BRACKETS, lambda m: F.regexp_replace(m, r"[\s\[\]]+", ""))


def extract_at_dot(c: Column) -> Column:
    """name at domain dot tld, the words with or without square brackets."""
    return _matches(c, AT_DOT, lambda m: F.regexp_replace(m, r"^([A-Za-z0-9._%+-]+)(?:\s*\[?\s*at\s*\]?\s*)([A-Za-z0-9.-]+)(?:\s*\[?\s*dot\s*\]?\s*)([A-Z|a-z]{2,})$", "$1@$2.$3"))


def decode_masked(c: Column, strict: bool = False) -> Column:
    """A masked address in the clear if that makes a standard one, else the text itself.

    By default the bare words go first, so that name(at)co(dot)io stays as it is; strict takes bracketed forms first and bare words only between spaces.
    """
    t = trim_all(c)
    if strict:
        d = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+", "@"), r"(?i)\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+", ".")
    else:
        d = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*\[?\s*at\s*\]?\s*", "@"), r"(?i)\s*\[?\s*dot\s*\]?\s*", ".")
        d = F.regexp_replace(F.regexp_replace(d, r"(?i)\(\s*at\s*\)", "@"), r"(?i)\(\s*dot\s*\)", ".")
    d = F.regexp_replace(d, r"\s+", "")
    return F.when(t.contains("@"), t).when(_standard_at_start(d), d).otherwise(t)


def decode_cloudflare(c: Column) -> Column:
    """The address behind a data-cfemail value: hex bytes, the first of which is the XOR key; null unless a standard address results."""
    ok = F.when(c.rlike("^(?:[0-9a-fA-F]{2}){2,}$"), c)
    # the code is made once for all its bytes: a column in a lambda would be made again for each
    raw = F.transform(F.array(ok), lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(x, i, F.lit(2)), 16, 10).cast("int")))
    plain = F.transform(raw, lambda b: F.array_join(F.transform(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), lambda v: F.char(v.bitwiseXOR(F.get(b, F.lit(0))))), ""))
    return F.get(F.filter(plain, lambda p: p.rlike(STANDARD)), F.lit(0))
