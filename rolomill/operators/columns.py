"""Header detection, column profiles and the mapping of columns to the contact fields.

Cells are (row_id, pos, col_name, value); functions on them take by, further columns that tell tables apart, so that any number of tables is worked on at once.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.people import person_like, split_name
from ..functions.text import trim_all
from ..schema import FIELDS, FULL_NAME

#: Words that speak for and against a header row; names of full-name columns; business words.
HEADER_WORDS = ["name", "first", "last", "email", "linkedin", "company", "designation", "role", "title", "phone", "location", "profile", "organization", "contact", "address", "position", "job", "work", "business"]
METADATA = ["event link", "https://", "http://", "www.", ".com", ".org", "unnamed:", "highlight", "contact directly", "account", "requests"]
FULL_NAME_WORDS = ["speaker", "name", "full name", "contact name", "primary contact", "person", "attendee", "participant", "lead", "contact", "user", "member", "guest", "presenter", "client", "customer"]
BUSINESS = ["inc", "llc", "corp", "ltd", "company", "corporation", "incorporated", "technologies", "solutions", "services", "systems", "group", "holdings", "university", "hospital", "government", "agency", "department"]
HEADER_ROWS, SAMPLES = 6, 5
#: Sheets up to which their headers and places of fields are broadcast, so that cells are not shuffled by sheet.
FEW_SHEETS = 20_000


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def header_score(cells: Column) -> Column:
    """Score of a row of cells (array of strings, null for an empty cell) as a header."""
    some = F.filter(cells, lambda c: c.isNotNull())
    text = F.array_join(F.transform(some, lambda c: F.lower(F.substring(c, 1, 100))), " ")
    score = sum((3 * text.contains(w).cast("int") for w in HEADER_WORDS), F.lit(0))
    score = score + 2 * _any(text, ["id", "number", "no", "#"]).cast("int") + 2 * _any(text, ["profile", "url", "link"]).cast("int")
    score = score + (F.size(F.filter(some, lambda c: F.length(trim_all(c)) < 20)) >= 3).cast("int")
    score = score - sum((5 * text.contains(w).cast("int") for w in METADATA), F.lit(0))
    return score - 10 * (F.size(F.filter(some, lambda c: trim_all(c) != "")) < 3).cast("int")


def header_scores(grid: DataFrame) -> DataFrame:
    """grid: sheet, row_idx, cells -> with score, first rows only."""
    return grid.where(F.col("row_idx") < HEADER_ROWS).select("sheet", "row_idx", header_score(F.col("cells")).alias("score"))


def header_pick(grid: DataFrame) -> DataFrame:
    """The first row with the highest score above 0 of each sheet; header_row is null if there is none."""
    best = F.max_by("row_idx", F.struct("score", -F.col("row_idx")))
    return header_scores(grid).groupBy("sheet").agg(F.when(F.max("score") > 0, best).alias("header_row"))


def clean_headers(names: list[str]) -> list[str]:
    """Stripped; trailing unnamed columns go."""
    names = [n.strip() for n in names]
    while names and names[-1].startswith("Unnamed:"):
        names.pop()
    return names


def read_names(row: list[str | None]) -> list[str]:
    """Column names as a CSV reader makes them of a header row: blank ones Unnamed: k, repeated ones with .1, .2."""
    seen: dict[str, int] = {}
    out = []
    for i, h in enumerate(row):
        h = h or f"Unnamed: {i}"
        n = seen.get(h, 0)
        seen[h] = n + 1
        out.append(f"{h}.{n}" if n else h)
    return out


def choose_header(picked: int | None, preview: dict[int, list], rows: int) -> tuple[int, list[str]]:
    """(header row, names) of a table; preview: its first rows, rows: how many it has. Header row -1 means that there is none.

    The picked row is taken if it has two named columns or more and a row follows; else the first of rows 0, 1 and 2 that a row with some value follows; else names are column_0, column_1, ...
    """
    if picked is not None and picked + 1 < rows:
        names = clean_headers(read_names(preview[picked]))
        if sum(bool(n) and not n.startswith("Unnamed:") for n in names) >= 2:
            return picked, names
    for at in range(min(3, rows - 1)):
        if any(c not in (None, "") for c in preview[at + 1]):
            return at, clean_headers(read_names(preview[at]))
    return -1, [f"column_{i}" for i in range(max((len(r) for r in preview.values()), default=0))]


def headers(grid: DataFrame) -> DataFrame:
    """(sheet, header_row, names) of each sheet of grid (sheet, row_idx, cells), with the fallbacks of choose_header. Of a sheet only the first rows and their count are gathered."""
    near = grid.where(F.col("row_idx") <= HEADER_ROWS).groupBy("sheet").agg(F.collect_list(F.struct("row_idx", "cells")).alias("first"))
    every = near.join(grid.groupBy("sheet").agg(F.count("*").alias("rows")), "sheet").join(header_pick(grid), "sheet", "left")

    def choose(batches):
        for b in batches:
            found = [choose_header(None if pd.isna(h) else int(h), {x["row_idx"]: list(x["cells"]) for x in first}, n) for h, first, n in zip(b["header_row"], b["first"], b["rows"], strict=True)]
            yield pd.DataFrame({"sheet": b["sheet"], "header_row": [f[0] for f in found], "names": [f[1] for f in found]})

    return every.select("sheet", "header_row", "first", "rows").mapInPandas(choose, "sheet string, header_row long, names array<string>")


def table_cells(grid: DataFrame, heads: DataFrame, sheets: int) -> DataFrame:
    """(sheet, row_id, pos, col_name, value) of all sheets, row_id from 0 below the header; heads as headers() gives it, with sheets rows."""
    j = grid.join(F.broadcast(heads) if sheets <= FEW_SHEETS else heads, "sheet").where(F.col("row_idx") > F.col("header_row"))
    named = F.transform("names", lambda n, i: F.struct(i.alias("pos"), n.alias("col_name"), F.get("cells", i).alias("value")))
    return j.select("sheet", (F.col("row_idx") - F.col("header_row") - 1).alias("row_id"), F.explode(named).alias("c")).select("sheet", "row_id", "c.*")


def unpivot(df: DataFrame, columns: list[str], order: str = "row_id") -> DataFrame:
    """(row_id, pos, col_name, value): one row per cell."""
    cells = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    return df.select(F.col(order).alias("row_id"), F.explode(cells).alias("c")).select("row_id", "c.*")


def _firsts(cells: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first n non-null values of each column. Each task keeps n per column before the shuffle."""
    some = cells.where(F.col("value").isNotNull()).withColumn("slice", F.spark_partition_id())
    near = Window.partitionBy(*by, "col_name", "slice").orderBy("row_id")
    w = Window.partitionBy(*by, "col_name").orderBy("row_id")
    kept = some.withColumn("r", F.row_number().over(near)).where(F.col("r") <= n)
    return kept.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select(*by, "col_name", "nth", "value")


def profile(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per column: rows, non_null_count, null_percentage, unique_count, sample_values (first 3) and pattern flags over the first 10 non-null values."""
    base = cells.groupBy(*by, "col_name").agg(F.count("value").alias("non_null_count"), F.count("*").alias("rows"), F.countDistinct("value").alias("unique_count"))
    v = F.col("value")
    flags = _firsts(cells, 10, by).groupBy(*by, "col_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("nth", "value")))).alias("s"),
        F.bool_or(v.rlike(r"@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")).alias("has_email"),
        F.bool_or(v.rlike("(?i)https?://")).alias("has_url"),
        F.bool_or(v.rlike(r"[0-9]{3,}")).alias("has_phone"),
    )
    no = F.lit(False)
    return base.join(flags, [*by, "col_name"], "left").select(
        *by, "col_name", "non_null_count", ((F.col("rows") - F.col("non_null_count")) * 100 / F.col("rows")).alias("null_percentage"), "unique_count",
        F.coalesce(F.array_join(F.transform("s", lambda x: x["value"]), "|"), F.lit("")).alias("sample_values"), *(F.coalesce(c, no).alias(c) for c in ("has_email", "has_url", "has_phone")),
    )


def map_columns(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(col_name, target): the deterministic rules over the first SAMPLES rows; columns that no rule maps are left out. Null samples count as the text nan."""
    s = cells.where(F.col("row_id") < SAMPLES).select(*by, "col_name", F.coalesce("value", F.lit("nan")).alias("v")).where(trim_all(F.col("v")) != "")
    v = F.col("v")
    a = s.groupBy(*by, "col_name").agg(
        F.avg(person_like(v).cast("int")).alias("people"), F.bool_or(v.contains("@")).alias("at"), F.bool_or(F.lower(v).contains("linkedin.com")).alias("link"), F.bool_or(v.rlike("[0-9]") & (F.length(v) > 6)).alias("digits")
    )
    n = F.lower("col_name")
    target = (
        F.when(_any(n, FULL_NAME_WORDS) & (F.col("people") >= 0.4), FULL_NAME)
        .when(F.col("at") | n.contains("email"), "email")
        .when(F.col("link") | n.contains("linkedin"), "linkedin")
        .when(n.contains("first") & n.contains("name"), "first_name")
        .when(n.contains("last") & n.contains("name"), "last_name")
        .when(_any(n, ["company", "organization", "account name"]), "current_company")
        .when(_any(n, ["title", "role", "position", "designation"]), "role")
        .when(F.col("digits"), F.when(_any(n, ["phone", "mobile"]), "phone"))
        .when(_any(n, ["city", "location", "address", "geo"]), "geo")
    )
    return a.select(*by, "col_name", target.alias("target")).where(F.col("target").isNotNull())


def valid_mapping(mapping: DataFrame) -> DataFrame:
    """Targets outside the fields and the full-name marker go."""
    return mapping.where(F.col("target").isin([*FIELDS, FULL_NAME]))


def column_quality(cells: DataFrame, mapping: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(col_name, target, pos, score): how well a column suits its target; all-null columns score 0."""
    v = F.col("value")
    c = cells.join(mapping, [*by, "col_name"]).where(v.isNotNull())
    bonus = (
        F.when(F.col("target") == "email", 10 * v.contains("@").cast("int"))
        .when(F.col("target").isin("first_name", "last_name"), 5 * person_like(v).cast("int"))
        .when(F.col("target") == "linkedin", 10 * F.lower(v).contains("linkedin.com").cast("int"))
        .when(F.col("target") == "phone", 8 * v.rlike("[0-9]{3}").cast("int"))
        .when(F.col("target") == "current_company", 3 * _any(F.lower(v), BUSINESS).cast("int"))
        .otherwise(0)
    )
    got = c.groupBy(*by, "col_name", "target").agg((2 * F.count("*") + F.sum(bonus) + F.floor(20 * F.countDistinct("value") / F.count("*"))).alias("score"))
    named = cells.select(*by, "col_name", "pos").distinct().join(mapping, [*by, "col_name"])
    return named.join(got, [*by, "col_name", "target"], "left").select(*by, "col_name", "target", "pos", F.coalesce("score", F.lit(0)).alias("score"))


def best_columns(quality: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The column with the highest score for each target, the first of equals."""
    w = Window.partitionBy(*by, "target").orderBy(F.col("score").desc(), "pos")
    return quality.withColumn("r", F.row_number().over(w)).where("r = 1").select(*by, "target", "col_name", "score")


def standardize(df: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The eight fields from mapped columns (column -> field or full-name marker), others empty; a later mapping of a field wins; rows stay."""
    out = dict.fromkeys(FIELDS, F.lit(""))
    for c, target in mapping.items():
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        if target == FULL_NAME:
            out["first_name"], out["last_name"] = split_name(text)
        elif target in out:
            out[target] = text
    return df.select(*keep, *(c.alias(f) for f, c in out.items()))


def standardize_sheets(grid: DataFrame, heads: DataFrame, chosen: DataFrame, sheets: int) -> DataFrame:
    """(sheet, row_id, the eight fields) of all sheets at once. chosen: (sheet, col_name, target), a column for each target at most; of a full name and a first or last name the later column wins."""
    at = heads.select("sheet", "header_row", F.posexplode("names").alias("pos", "col_name")).join(chosen.select("sheet", "col_name", "target"), ["sheet", "col_name"])
    places = at.groupBy("sheet", "header_row").agg(*(F.max(F.when(F.col("target") == t, F.col("pos"))).alias(f"at_{t}") for t in [*FIELDS, FULL_NAME]))
    rows = grid.join(F.broadcast(places) if sheets <= FEW_SHEETS else places, "sheet").where(F.col("row_idx") > F.col("header_row"))
    value = lambda t: F.coalesce(F.get("cells", F.col(f"at_{t}")), F.lit(""))
    whole = dict(zip(("first_name", "last_name"), split_name(value(FULL_NAME)), strict=True))
    out = {f: F.when(F.col(f"at_{FULL_NAME}") > F.coalesce(f"at_{f}", F.lit(-1)), whole[f]).otherwise(value(f)) if f in whole else value(f) for f in FIELDS}
    return rows.select("sheet", (F.col("row_idx") - F.col("header_row") - 1).alias("row_id"), *(F.coalesce(c, F.lit("")).alias(f) for f, c in out.items()))


def parse_reply(reply) -> tuple[dict[str, str], float | None]:
    """(mapping, quality score) of a mapping hook's answer: a mapping, or text with a JSON object that may stand behind a thinking block and in a code fence.

    The object is the mapping or has it as field_mappings, beside quality_score. What can't be read gives no mapping.
    """
    if isinstance(reply, str):
        text = reply.rsplit("</think>", 1)[-1]
        at, end = text.find("{"), text.rfind("}")
        try:
            reply = json.loads(text[at : end + 1]) if 0 <= at < end else {}
        except ValueError:
            reply = {}
    if not isinstance(reply, dict):
        return {}, None
    score = reply.get("quality_score") if "field_mappings" in reply else None
    found = reply.get("field_mappings", reply)
    found = {c: t for c, t in found.items() if isinstance(c, str) and isinstance(t, str)} if isinstance(found, dict) else {}
    return found, float(score) if isinstance(score, int | float) else None
