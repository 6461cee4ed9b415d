"""Target-distribution importance resampling: documents are drawn by how much likelier the target's words make them than the corpus's, with Gumbel noise.

1. Each task feeds its texts into a word trie. An edge is a word and a node the run of words that leads to it; a node holds how often the run was met and the crc32 state after
   its bytes, from which a child's state goes on. A trie of over NODES nodes is emptied into the task's bucket totals, so its memory is bounded.
2. Bucket totals of all tasks are merged by a pre-aggregated sum, for the corpus and for the target; there are as many as there are buckets. They give each bucket's gain.
3. Documents are scored by walking a trie again, whose nodes have their bucket's gain attached when they are made.
4. Documents that are long enough are range-sorted by score; a row's place in its range and the rows of the ranges before give its rank, without a global sort in one task.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, slices, small, stage, text_of
from .words import runs

#: Production parameters: words of a run at most, buckets, words of a document that may be drawn, percent drawn, seed.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
#: Nodes after which a trie is emptied.
NODES = 500_000
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of words once A-Z are lower-cased: digits, letters and all of UTF-8 beyond ASCII.
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xFF]+"), re.compile(rb"[^0-9a-z\x80-\xFF]")


class Trie:
    """Runs of up to longest words. gains: if given, each node gets the gain of its bucket when it is made."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS, gains: list[int] | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.clear()

        self.sums = np.zeros(buckets, np.int64)

    def clear(self) -> None:
        self.kids: list[dict[bytes, int] | None] = [{}]
        self.crc, self.count, self.gain = [0], [0], [0]

    def __len__(self) -> int:
        return len(self.crc)

    def _made(self, parent: int, word: bytes) -> int:
        node = len(self.crc)
        if self.kids[parent] is None:
            self.kids[parent] = {}
        self.kids[parent][word] = node
        crc = zlib.crc32(b" " + word if parent else word, self.crc[parent])
        self.kids.append(None)
        self.crc.append(crc)
        self.count.append(0)
        self.gain.append(self.gains[crc % self.buckets] if self.gains else 0)
        return node

    def nodes(self, words: list[bytes], known: int = 0) -> list[int]:
        """The node of every run that ends behind the first known words."""
        top = self.kids[0]
        if self.longest == 1:
            return [top.get(w) or self._made(0, w) for w in words[known:]]
        out = []
        for i in range(len(words)):
            node = 0
            for j, w in enumerate(words[i : i + self.longest], i):
                kids = self.kids[node]
                node = (kids.get(w) if kids else None) or self._made(node, w)
                if j >= known:
                    out.append(node)
        return out

    def walk(self, text: str):
        """(nodes, words) of a text, block by block; runs go on from one block to the next."""
        tail: list[bytes] = []
        for words in runs(text.encode("utf-8", "surrogatepass").translate(_LOW), _WORD, _GAP):
            yield self.nodes(tail + words, len(tail)), len(words)
            tail = (tail + words)[1 - self.longest :] if self.longest > 1 else []

    def add(self, text: str) -> None:
        for nodes, _ in self.walk(text):
            for x in nodes:
                self.count[x] += 1
            if len(self) > NODES:
                self.totals()
                self.clear()

    def sum_gains(self, text: str) -> tuple[int, int, int]:
        """(words, features, sum of the features' gains)."""
        w = n = total = 0
        for nodes, words in self.walk(text):
            w, n, total = w + words, n + len(nodes), total + sum(map(self.gain.__getitem__, nodes))
            if len(self) > NODES:
                self.clear()
        return w, n, total

    def totals(self) -> np.ndarray:
        """How often the features of each bucket were met; the nodes' counts are added to the sums and begin anew."""
        np.add.at(self.sums, np.array(self.crc[1:], np.int64) % self.buckets, np.array(self.count[1:], np.int64))
        self.count = [0] * len(self.count)
        return self.sums


def bucket_totals(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Features of each bucket over all rows; the result has a number for each bucket, whatever the rows."""

    def run(batches):
        trie = Trie(longest, buckets)
        for b in slices(batches):
            for t in b.column(0):
                trie.add(t.as_py())
        n = trie.totals()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0], pa.int64())], ["bucket", "n"])

    got = docs.select(text_of(docs, text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket at most
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln of how much likelier a bucket is in the target), both smoothed by one."""
    s, t, k = float(corpus.sum()), float(target.sum()), len(corpus)
    return [math.floor(1000 * math.log((y + 1) * (s + k) / ((x + 1) * (t + k)))) for x, y in zip(corpus.astype(float), target.astype(float), strict=True)]


def weigh(docs: DataFrame, gains: list[int], longest: int = LONGEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight (floored mean of the features' gains, 0 without features)."""

    def run(batches):
        trie = Trie(longest, len(gains), gains)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for i, j in pieces(texts):
                rows = [trie.sum_gains(t) for t in texts[i:j]]
                cols = [[w for w, _, _ in rows], [n for _, n, _ in rows], [total // n if n else 0 for _, n, total in rows]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(key, seed: str = SEED):
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256(seed:key); a null key counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (null for rows that are not drawn).

    Of the rows with at least least_words words the floor(percent / 100) share with the highest scores is drawn, ties to the smaller key, null keys last. Null texts have
    no features and weight 0; repeated rows are each judged. An empty table gives no rows, an empty target gives all buckets the gains of no counts. Other columns are not read.
    """
    gains = bucket_gains(bucket_totals(docs, longest, buckets, text), bucket_totals(target, longest, buckets))
    spark = docs.sparkSession
    scored = weigh(docs, gains, longest, key, text)
    scored = stage(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.xxhash64("n_words", "n_features")
    fit = F.col("n_words") >= least_words
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = scored.where(fit).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranked = stage(ranked.withColumn("at", F.monotonically_increasing_id()))
    part, before, offsets = F.shiftright("at", 33), 0, []
    for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets.append((r.part, before))
        before += r.n
    offsets = small(spark.createDataFrame(offsets, "part long, before long"), len(offsets))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.when(rank <= percent * before // 100, rank)
    columns = ["doc_id", "n_features", "weight", "score"]
    out = ranked.withColumn("part", part).join(offsets, "part").select(*columns, drawn.alias("rank"))
    rest = scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    return out.unionAll(rest)
