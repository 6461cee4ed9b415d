"""What is already known of URLs, across runs: a table of results and Bloom filters in front of it.

The cache is a folder with results (url and further columns) and with filters, each in buckets of URLs. A look-up deals URLs to buckets, where a Bloom filter of each run tells most new URLs at once; only those
that may be known meet the results in an exact join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage

#: Buckets of URLs; bits of a filter for each URL, and hash functions: about 1 % of new URLs may seem known.
BUCKETS, BITS, HASHES = 256, 10, 7
FILTERS = "bucket int, bits binary"


def _places(urls: list[str], size: int) -> np.ndarray:
    """The bits of each URL in a filter of so many bits."""
    h = np.array([xxhash.xxh3_128_intdigest(u) for u in urls], object)
    a, b = (h & 0xFFFFFFFFFFFFFFFF).astype(np.uint64), (h >> 64).astype(np.uint64) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(size)


def bloom(urls: list[str]) -> bytes:
    """A filter of urls; its size follows from their number."""
    size = max(64, -(-len(urls) * BITS // 8) * 8)
    bits = np.zeros(size, np.uint8)
    if urls:
        bits[_places(urls, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_have(filters: list[bytes], urls: list[str]) -> np.ndarray:
    out = np.zeros(len(urls), bool)
    for f in filters:
        bits = np.unpackbits(np.frombuffer(f, np.uint8))
        if urls:
            out |= bits[_places(urls, len(bits))].all(axis=1)
    return out


def _bucket(c: str = "url"):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _filtered(urls: pa.Table, filters: pa.Table) -> pa.Table:
    names = urls["url"].to_pylist()
    return pa.table({"url": pa.array(names, pa.string()), "maybe": pa.array(may_have(filters["bits"].to_pylist(), names))})


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class UrlCache:
    """Results by URL in a folder that driver and executors share. results: the columns besides url, as DDL."""

    def __init__(self, spark: SparkSession, folder: str, results: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), f"url string, {results}"

    def _read(self, part: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{part}"
        return self.spark.read.schema(schema).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def look_up(self, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(known, new): the cached results of distinct urls, and the URLs that have none. Null URLs are neither. Staged, so that storing results later changes nothing."""
        u = stage(urls.select("url").where("url is not null").distinct())
        filters = self._read("filters", FILTERS)
        marked = u.groupBy(_bucket().alias("bucket")).cogroup(filters.groupBy("bucket")).applyInArrow(_filtered, "url string, maybe boolean")
        marked = stage(marked)
        known = stage(self._read("results", self.schema).join(marked.where("maybe").select("url"), "url", "left_semi"))
        maybe = marked.where("maybe").select("url").join(known.select("url"), "url", "left_anti")
        return known, stage(marked.where("not maybe").select("url").unionAll(maybe))

    def store(self, results: DataFrame) -> None:
        """Adds results of URLs that aren't known yet (see look_up), with a filter for each bucket of them. The filters go last: a run that dies in between leaves URLs that count as new, and a result that is stored twice stays one URL's."""
        r = stage(results.select([c.split(" ")[0] for c in self.schema.split(", ")]).where("url is not null").dropDuplicates(["url"]))
        r.write.mode("append").parquet(f"{self.folder}/results")
        made = lambda t: pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "bits": pa.array([bloom(t["url"].to_pylist())], pa.binary())})
        r.select("url", _bucket().alias("bucket")).groupBy("bucket").applyInArrow(made, FILTERS).write.mode("append").parquet(f"{self.folder}/filters")

    def through(self, urls: DataFrame, fetch) -> DataFrame:
        """The results of distinct urls: known ones from the cache, the others by fetch (a DataFrame of url -> a DataFrame of results), which are stored."""
        known, new = self.look_up(urls)
        made = stage(fetch(new))
        self.store(made)
        known = known.dropDuplicates(["url"])
        return known.unionByName(made.select(known.columns))
