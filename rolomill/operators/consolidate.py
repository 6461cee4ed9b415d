"""Consolidation: union of aligned tables, cleaning, filter of valuable rows, completeness and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, filled
from ..schema import FIELDS, VALUABLE


def align(df: DataFrame, source_file: str | Column, agent: str = "column_mapper", keep: tuple[str, ...] = ()) -> DataFrame:
    """The eight fields (missing ones empty) with the source file and the agent; other columns go but for those in keep."""
    src = F.lit(source_file) if isinstance(source_file, str) else source_file
    return df.select(*keep, *((F.col(f).cast("string") if f in df.columns else F.lit("")).alias(f) for f in FIELDS), src.alias("source_file"), F.lit(agent).alias("source_agent"))


def union_aligned(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [align(df, name) for name, df in tables])


def clean(df: DataFrame) -> DataFrame:
    return df.withColumns({f: clean_text(F.col(f)) for f in FIELDS})


def valuable(df: DataFrame) -> DataFrame:
    """Rows with something in one of the seven fields other than geo."""
    return df.where(reduce(lambda a, b: a | b, (filled(F.col(f)) for f in VALUABLE)))


def completeness() -> Column:
    """Per cent of the eight fields that are filled."""
    return (sum((filled(F.col(f)).cast("int") for f in FIELDS), F.lit(0)) * 100 / len(FIELDS)).cast("double")


def with_metadata(df: DataFrame, files: int, agent: str = "data_consolidator", at: Column | None = None) -> DataFrame:
    return df.withColumns({"consolidation_date": at if at is not None else F.current_timestamp(), "total_source_files": F.lit(files), "consolidation_agent": F.lit(agent), "data_completeness_percentage": completeness()})


def preservation(df: DataFrame) -> DataFrame:
    """One row: how many rows have names, emails, companies, titles, profiles and phones."""
    has = lambda *f: F.count_if(reduce(lambda a, b: a | b, (filled(F.col(x)) for x in f)))
    return df.agg(F.count("*").alias("total_rows"), has("first_name", "last_name").alias("with_names"), has("email").alias("with_emails"), has("current_company").alias("with_companies"), has("role").alias("with_titles"), has("linkedin").alias("with_linkedin"), has("phone").alias("with_phones"))


def source_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("source_file").agg(F.count("*").alias("row_count"), F.avg(completeness()).alias("avg_completeness"))
