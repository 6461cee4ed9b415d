"""File sources and sinks: discovery, CSV and workbook cells of unknown headers, CSV and JSON output.

Cells are read as text, (file, sheet, row_idx, cells); files are read where they are, by the executors: workbooks sheet by sheet (see workbooks), old workbooks and CSV files of up to SPLIT
bytes one file at a time, larger CSV files in splits, line by line. A file that can't be read is listed with its error.
"""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import workbooks, xls

#: CSV files of more bytes are read in splits, unless a line of theirs has an open quote or isn't UTF-8.
SPLIT = 64 << 20


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files below folder that have a known suffix, in order of their paths."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return f.where(F.lower("path").rlike(r"\.(csv|xlsx|xls)$")).select("path", "length").orderBy("path")


def csv_cells(content: bytes) -> list[list[str | None]]:
    """Rows of a UTF-8 file, blank lines skipped; not UTF-8 raises."""
    return [[c if c != "" else None for c in row] for row in csv.reader(io.StringIO(content.decode("utf-8-sig"))) if row]


def _lines(spark: SparkSession, folder: str, over: int) -> DataFrame:
    """(file, block, nth, cells, odd) of the lines of CSV files of more than over bytes; nth counts a split's lines, odd marks those that tell that the file can't be read in splits."""
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").text(folder)
    f = f.where(F.col("_metadata.file_size") > over).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"), F.is_valid_utf8("value").alias("valid"))

    def run(batches):
        at, n = None, 0
        for b in batches:
            rows = []
            for file, block, line, valid in zip(b["file"], b["block"], b["value"], b["valid"], strict=True):
                if at != (file, block):
                    at, n = (file, block), 0
                line = line.removeprefix("\ufeff") if block == 0 and n == 0 else line
                if line:
                    odd = not valid or line.count('"') % 2 == 1
                    rows.append((file, block, n, [] if odd else csv_cells(line.encode())[0], odd))
                    n += 1
            yield pd.DataFrame(rows, columns=["file", "block", "nth", "cells", "odd"])

    return f.mapInPandas(run, "file string, block long, nth long, cells array<string>, odd boolean")


def _whole(batches):
    """Rows of ROWS from whole files: CSV, old workbooks, and workbooks of stores that only Spark reads, in batches."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            low = path.lower()
            try:
                stream = pa.BufferReader(content.as_buffer())
                if low.endswith(".xls"):
                    for name, rows in xls.sheets(stream.read()):
                        yield from workbooks.batches(path, name, iter(rows))
                elif low.endswith(".xlsx"):
                    yield from workbooks.workbook_batches(path, stream)
                else:
                    yield from workbooks.batches(path, "", iter(csv_cells(stream.read())))
            except Exception as e:  # whatever is wrong with the file, it is listed
                yield workbooks.batch(path, "", 0, [None], f"{type(e).__name__}: {e}")


def load(spark: SparkSession, folder: str, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(cells, failed) of all files below folder, read once and staged. failed: (file, error). Empty sheets have no rows; of a file that fails none counts."""
    try:
        books = workbooks.listed(folder)
        spark.dataSource.register(workbooks.WorkbookSource)
        sheets = spark.read.format("workbook").load(folder) if books else None
        suffixes = r"\.(csv|xls)$"
    except (pa.ArrowInvalid, OSError):  # no file system that Arrow opens
        sheets, suffixes = None, r"\.(csv|xlsx|xls)$"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.lower("path").rlike(suffixes))
    lines = _lines(spark, folder, split)
    parts = stage(lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("odd").alias("odd")))  # a row for each split
    whole = parts.groupBy("file").agg(F.max("odd").alias("odd"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = parts.withColumn("before", before).join(whole.where("not odd").select("file"), "file").select("file", "block", "before")
    cut = lines.join(offset, ["file", "block"]).select("file", F.lit("").alias("sheet"), (F.col("before") + F.col("nth")).alias("row_idx"), "cells", F.lit(None).cast("string").alias("error"))
    entire = f.join(whole.where("not odd").select(F.col("file").alias("path")), "path", "left_anti").select("path", "content").mapInArrow(_whole, workbooks.ROWS)
    every = stage(entire.unionAll(cut) if sheets is None else entire.unionAll(cut).unionAll(sheets))
    failed = stage(every.where("error is not null").groupBy("file").agg(F.min("error").alias("error")))
    return every.join(failed, "file", "left_anti").select("file", "sheet", "row_idx", "cells"), failed


def read_cells(spark: SparkSession, folder: str, failed: str = "skip") -> DataFrame:
    """The cells of load(). failed: skip leaves out files that can't be read, raise doesn't."""
    cells, bad = load(spark, folder)
    if failed == "raise" and (first := bad.orderBy("file").first()):
        raise ValueError(f"{first.file}: {first.error}")
    return cells


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """UTF-8 with header, a file for each task. one_file only for the hand-over to a system that asks for it: rows are shuffled into one writer, what makes them stays parallel."""
    (df.repartition(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv() wrote, as text."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A few aggregate rows as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str)


def verify(cells: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(file, readable, n_sheets, n_rows, error) of each file that has rows or failed."""
    good = cells.groupBy("file", "sheet").agg(F.count("*").alias("n")).groupBy("file").agg(F.count("*").alias("n_sheets"), F.sum("n").alias("n_rows"))
    out = good.select("file", F.lit(True).alias("readable"), "n_sheets", "n_rows", F.lit(None).cast("string").alias("error"))
    if failed is not None:
        none = F.lit(0).cast("long")
        out = out.unionAll(failed.select("file", F.lit(False), none, none, "error"))
    return out
