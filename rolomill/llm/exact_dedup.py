"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. A digest of every text is staged: (row columns, digest).
2. A Misra-Gries summary (Spark's frequent-items sketch) of the digests names those that may be frequent; it has a fixed number of counters.
3. Exact counts and winners of the named digests are verified by an aggregation that combines on the map side.
4. The verified winners, as few as the sketch has counters, are broadcast and settle their rows without a shuffle.
5. All other digests are rare (under rows / counters each), so an ordinary shuffle by digest settles them evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of

#: Digests the summary reports, and counters it keeps. What it reports bounds the broadcast: TOP rows of 80 bytes.
TOP, COUNTERS = 1024, 8192


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text. Of equal texts the row with the largest key stays; a null key is
    smaller than all others. Rows that repeat key and text are each counted in group_size; all copies of the winning key are kept = true, as their
    key is the group's keep_id. A group whose keys are all null has keep_id null and kept true. No rows give no rows; other columns are not read.
    """
    d = stage(docs.select(F.col(key).alias("doc_id"), F.sha2(text_of(docs, text), 256).alias("text_sha256")))
    stats = (F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    frequent = d.agg(F.expr(f"approx_top_k(text_sha256, {TOP}, {COUNTERS})").alias("t")).select(F.explode("t").alias("t"))
    heavy = frequent.where("t.count > 1").select(F.col("t.item").alias("text_sha256"))
    winners = stage(d.join(F.broadcast(heavy), "text_sha256", "left_semi").groupBy("text_sha256").agg(*stats))
    settled = d.join(F.broadcast(winners), "text_sha256")
    w = Window.partitionBy("text_sha256")
    rest = d.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select("text_sha256", "doc_id", *(c.over(w).alias(n) for c, n in ((F.max("doc_id"), "keep_id"), (F.count("*"), "group_size"))))
    return settled.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
