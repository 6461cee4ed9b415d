"""Verification of written tables by re-reading: a manifest of order-free digests, and the rows that differ.

Rows are dealt to buckets by a hash of all their columns as text. A bucket's digest is the sum of two independent row hashes, with the number of rows; it doesn't depend on order, files or tasks. Comparing
manifests tells which buckets differ; only their rows are read again to name what was changed, lost or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket, about.
ROWS = 100_000


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    # null and the empty text are one, as in CSV files; names go in, so that swapped columns differ
    text = [F.concat_ws("=", F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in sorted(df.columns)]
    h = F.xxhash64(*text)
    return df.select("*", F.pmod(h, F.lit(buckets)).alias("bucket"), h.alias("h1"), F.xxhash64(F.lit(1), *text).alias("h2"))


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def manifest(df: DataFrame, buckets: int) -> DataFrame:
    """(bucket, rows, digest) of the buckets that have rows."""
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return _hashed(df, buckets).groupBy("bucket").agg(F.count("*").alias("rows"), F.concat_ws(":", total("h1").cast("string"), total("h2").cast("string")).alias("digest"))


def differing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Buckets whose manifests aren't equal, with the rows expected and found."""
    e, f = expected.select("bucket", F.col("rows").alias("expected"), F.col("digest").alias("d1")), found.select("bucket", F.col("rows").alias("found"), F.col("digest").alias("d2"))
    j = e.join(f, "bucket", "full").where(~F.col("d1").eqNullSafe(F.col("d2")))
    return j.select("bucket", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))


def differences(df: DataFrame, again: DataFrame, buckets: int, kept: DataFrame | None = None) -> DataFrame:
    """The rows that aren't as often in again as in df: the columns of df, expected, found. kept: the manifest that was stored when df was written (made of df by default).

    A changed row is there twice, as it was (found less often) and as it is. Columns of again are taken by df's names; null and the empty text are equal.
    df and again are read twice (df once if kept is given): what is dear to make is to be staged before. Numbers of buckets are broadcast; rows are shuffled once, by their values.
    """
    again = again.select(*(f"`{c}`" for c in df.columns))
    bad = differing(manifest(df, buckets) if kept is None else kept, manifest(again, buckets)).select("bucket")
    rows = lambda x, n: _hashed(x, buckets).join(F.broadcast(bad), "bucket", "left_semi").select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns), F.lit(n).alias("side"))
    both = rows(df, 0).unionAll(rows(again, 1)).groupBy(*(f"`{c}`" for c in df.columns))
    counts = both.agg(F.sum((F.col("side") == 0).cast("long")).alias("expected"), F.sum((F.col("side") == 1).cast("long")).alias("found"))
    return counts.where("expected != found")
