"""CRM exports: projection to the standard fields and to two import formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, trim_all
from ..schema import APOLLO, FIELDS, HEADERS, HUBSPOT


def _text(f: str, df: DataFrame):
    return F.coalesce(F.col(f).cast("string"), F.lit("")) if f in df.columns else F.lit("")


def standard(df: DataFrame, headers: bool = True) -> DataFrame:
    """The eight fields in order, missing ones empty; others go."""
    return df.select(*(_text(f, df).alias(HEADERS[f] if headers else f) for f in FIELDS))


def apollo(df: DataFrame) -> DataFrame:
    """Rows with an email, company or profile; phones trimmed."""
    keep = df.where(filled(F.col("email")) | filled(F.col("current_company")) | filled(F.col("linkedin")))
    return keep.select(*((trim_all(_text(f, df)) if f == "phone" else _text(f, df)).alias(h) for f, h in zip(FIELDS, APOLLO, strict=True)))


def hubspot(df: DataFrame) -> DataFrame:
    """Rows with a first name, last name or email; profile links that aren't linkedin.com go."""
    keep = df.where(filled(F.col("first_name")) | filled(F.col("last_name")) | filled(F.col("email")))
    link = trim_all(_text("linkedin", df))
    link = F.when(link.rlike("(?i)linkedin.com"), link).otherwise("")
    return keep.select(*((link if f == "linkedin" else _text(f, df)).alias(h) for f, h in zip(FIELDS, HUBSPOT, strict=True)))


def report(df: DataFrame) -> DataFrame:
    n = lambda x: x.agg(F.count("*").alias("n"))
    parts = [n(x).select(F.lit(k).alias("export"), "n") for k, x in (("standard", standard(df)), ("apollo", apollo(df)), ("hubspot", hubspot(df)))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
