"""Shared plumbing: staging in the shared folder, checked broadcasts, bounded batches."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolomill.plans.staging import shared_dir, stage, unstage

__all__ = ["batches_of", "give_back", "pieces", "shared_dir", "slices", "small", "stage", "text_of", "unstage"]

#: A side of a join is broadcast only up to this many rows of one or two longs (about 16 MB); beyond it, the join shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; df must be staged and narrow (ids)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Bytes of an Arrow batch of rows that may be large, beside the limit on its rows; a single row may be larger.
BATCH_BYTES = 16_000_000


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """So many rows and BATCH_BYTES at most in the Arrow batches of what is run meanwhile: for rows that may be large."""
    now = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name, None) for name in now}
    for name, value in now.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def text_of(docs: DataFrame, text: str = "text"):
    """The text as a string, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def give_back() -> None:
    """Returns freed memory of this process to the system where the C library can (glibc keeps it otherwise): after work on the driver that is large for a while."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, rows: int = 1000):
    """The Arrow batches in slices of so many rows, so that only as many texts at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def pieces(texts: list, most_bytes: int = 250_000):
    """(from, to) ranges of texts with about most_bytes characters each; a single text may be longer."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most_bytes:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
