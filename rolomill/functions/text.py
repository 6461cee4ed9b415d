"""Column expressions on text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLANK_TOKENS, NA_TOKENS

#: White space of any script: the class (?U)\s of Java's patterns.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_all(c: Column) -> Column:
    """Without white space of any script at both ends (Spark's trim only drops U+0020); bytes that aren't UTF-8 become U+FFFD (each of an encoded surrogate's three)."""
    return F.trim(F.make_valid_utf8(c), F.lit(WHITE))


def na_to_null(c: Column) -> Column:
    return F.when(c.isin(NA_TOKENS), None).otherwise(c)


def clean_text(c: Column) -> Column:
    """Trimmed; null and the blank tokens become empty."""
    t = trim_all(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(t.isin(BLANK_TOKENS), "").otherwise(t)


def filled(c: Column) -> Column:
    return F.coalesce(trim_all(c), F.lit("")) != ""


def collapse(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"(?U)\s+", " "))
