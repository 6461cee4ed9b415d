"""Document fingerprints: MinHash signatures of five-word shingles in vectorised numpy, bands joined in Spark, Jaccard verified.

A fingerprint is the hex string of the lower halves (16 bits) of PERMUTATIONS minima. Likeness of two fingerprints is the share of equal minima, an estimate
of the Jaccard similarity of the shingle sets; texts without words are alike (1) to one another and to no other (0). Bands are runs of ROWS minima of the fingerprint; documents
that share one are candidates, and what the full sets confirm is linked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, text_of, unstage
from .minhash_dedup import linked_classes, shape
from .shingles import MinHash, shingles, short

PERMUTATIONS, BANDS, ROWS, SIMILARITY = 128, 32, 4, 0.8
#: Characters whose signatures are made at once; a single text may be longer.
AT_ONCE = 250_000


def signatures(texts: list[str]) -> np.ndarray:
    return MinHash(PERMUTATIONS)(*shingles(texts))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of signatures."""
    ea, eb = ((x == 0xFFFFFFFF).all(axis=1) for x in (a, b))
    return np.where(ea | eb, (ea & eb).astype(float), (short(a) == short(b)).mean(axis=1))


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _follow(batches):
    """Rows come sorted by slot, then descending key; each needs the text of the row after it. A slot's last row (own = false) only serves as that.

    Before the texts of a key stand its rows without a text: they have the groups of its shingle sets.
    """
    held = None  # (slot, key, own, text, groups)
    groups: dict = {}
    of = None
    unzip = zstandard.ZstdDecompressor()

    def rows(part, kind):
        h, n = shingles([t[1] for t in part])
        now = MinHash(PERMUTATIONS)(h, n)
        ed = [edited(t[1], t[2]) for t in part]
        then, nxt = signatures(ed), np.concatenate([now[1:], now[-1:]])
        lone = [k for k, t in enumerate(part) if k + 1 == len(part) or t[2] is not part[k + 1][1]]
        nxt[lone] = signatures([part[k][2] for k in lone])
        hexed = lambda s: [x.tobytes().hex() for x in short(s)]
        own = [t[3].get(xxhash.xxh3_128_digest(np.unique(x).tobytes()), (t[0], 0)) if t[3] else (t[0], 0) for t, x in zip(part, np.split(h, np.cumsum(n)[:-1]), strict=True)]
        cols = {"doc_id": pa.array([t[0] for t in part], kind), "n_chars": pa.array([len(t[1]) for t in part], pa.int64()), "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in ed], "fingerprint": hexed(now), "edited_fingerprint": hexed(then), "near_edited": likeness(now, then), "near_next": likeness(now, nxt)}
        cols |= {"group_id": pa.array([g[0] for g in own], kind), "n_links": pa.array([g[1] for g in own], pa.int64())}
        return pa.RecordBatch.from_pydict(cols)

    for b in batches:
        todo, total, kind = [], 0, b.schema.field("doc_id").type
        for slot, key, own, z, set_hash, group, links in zip(*(b.column(c).to_pylist() for c in ("slot", "doc_id", "own", "z", "set_hash", "group_id", "n_links")), strict=True):
            if key != of:
                groups, of = {}, key
            if z is None:
                groups[set_hash] = (group, links)
                continue
            text = unzip.decompress(z).decode("utf-8", "surrogatepass")
            if held and held[0] == slot and held[2]:
                todo.append((held[1], held[3], text, held[4]))
                total += len(text)
            held = (slot, key, own, text, groups)
            if total >= AT_ONCE:
                yield rows(todo, kind)
                todo, total = [], 0
        if todo:
            yield rows(todo, kind)


def _routes(spark, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning sends there (n rows)."""
    found: dict[int, int] = {}
    top = 16 * n
    while len(found) < n:
        part = spark.range(top).select(F.col("id").cast("int").alias("v"))
        found = {r.p: r.v for r in part.groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p")).agg(F.min("v").alias("v")).collect()}
        top *= 2
    return [found[p] for p in range(n)]


def fingerprints(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; group_id and n_links as near_documents has them.

    The next document is the one with the next smaller key (numbers; ties and repeated rows in the order of a hash of the text), after the last the first; a
    single document is its own next. Rows with a null key come last in that order. Null counts as the empty text. Other columns are not read.

    Keys are cut into slots of about equal row counts by a sketch. A row goes to its slot, and the first row of a slot also to the slot before, which
    thus has every neighbour: texts are shuffled once, compressed, and no task sees more than a slot. Rows with a null key have slots by ranges of their hash; rows that share one other key share a slot.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    found = _near(docs, similarity, key, text)
    groups = stage(found.where("not (doc_id <=> group_id) or n_links > 0").distinct())
    unstage(found)
    d = docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("text")).withColumn("h", F.xxhash64("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("cuts"), F.count("*").alias("rows"), F.count("doc_id").alias("keyed")).first()
    cuts = sorted({c for c in found.cuts or [] if c is not None}) if n > 1 else []
    bare = max(1, -(-(found.rows - found.keyed) * n // max(1, found.rows)))  # slots of rows with a null key, by ranges of their hash
    routes = _routes(spark, n)

    def slots(keys: pa.Array, h: pa.Array) -> pa.Array:
        """Slot 0 has the largest keys; null keys are in the last ones, by h."""
        some = np.array([cuts[0] if k is None else k for k in keys.to_pylist()]) if cuts else np.zeros(len(keys))
        at = len(cuts) - np.searchsorted(np.array(cuts), some, "right") if cuts else np.zeros(len(keys), int)
        if keys.null_count:
            up = h.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)  # in order of h
            sub = (up // np.uint64(-(-(1 << 64) // bare))).astype(int) if bare > 1 else 0
            at = np.where(np.array(keys.is_null()), len(cuts) + 1 + sub, at)
        return pa.array(at.astype(np.int32))

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([slots(b.column(0), b.column(1)), *b.columns], ["slot", *b.schema.names])

    def shrunk(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            packed = pa.array([z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([slots(b.column(0), b.column(1)), b.column(0), b.column(1), packed], ["slot", "doc_id", "h", "z"])

    order = lambda k, h: F.struct(F.coalesce(k.isNull(), F.lit(False)).alias("z"), (-k).alias("k"), h.alias("h"))
    place = order(F.col("doc_id"), F.col("h"))
    light = d.select("doc_id", "h").mapInArrow(placed, f"slot int, doc_id {kind}, h long")
    firsts = [(r.slot, r.o) for r in light.groupBy("slot").agg(F.min(place).alias("o")).collect()]  # a row for each slot
    firsts.sort(key=lambda x: x[0])
    place_kind = d.select(place["k"].alias("k")).schema["k"].dataType.simpleString()
    if not firsts:
        return spark.createDataFrame([], f"doc_id {kind}, {OUT}, group_id {kind}, n_links long")
    first = spark.createDataFrame([(s, o.k, o.h, firsts[i - 1][0]) for i, (s, o) in enumerate(firsts)], f"fs int, fk {place_kind}, fh long, to int")  # a row for each slot
    # the first row of each slot again, for the slot before; of repeated rows that tie for the first place, one is enough
    extra = d.join(F.broadcast(first), place["k"].eqNullSafe(F.col("fk")) & (F.col("h") == F.col("fh"))).dropDuplicates(["to", "doc_id"]).select("doc_id", "h", "text", "to")
    extra = stage(extra)  # as many rows as slots
    none = [F.lit(None).cast("binary").alias("set_hash"), F.lit(None).cast(kind).alias("group_id"), F.lit(None).cast("long").alias("n_links")]
    nothing = [F.lit(0).cast("long").alias("h"), F.lit(None).cast("binary").alias("z")]
    texts = "slot int, doc_id " + kind + ", h long, z binary"
    own = d.select("doc_id", "h", "text").mapInArrow(shrunk, texts).select("slot", "doc_id", F.lit(True).alias("own"), "h", "z", *none)
    more = extra.drop("to").mapInArrow(shrunk, texts).join(F.broadcast(first), place["k"].eqNullSafe(F.col("fk")) & (F.col("h") == F.col("fh"))).select("to", "doc_id", F.lit(False), "h", "z", *none)
    known = groups.select("doc_id", F.lit(0).cast("long").alias("h"), "set_hash", "group_id", "n_links").mapInArrow(placed, f"slot int, doc_id {kind}, h long, set_hash binary, group_id {kind}, n_links long")
    known = known.select("slot", "doc_id", F.lit(True).alias("own"), *nothing, "set_hash", "group_id", "n_links")
    both = own.unionAll(more).unionAll(known)
    both = both.withColumn("route", F.array(*(F.lit(v) for v in routes))[F.pmod(F.col("slot"), F.lit(n))])
    both = both.repartition(n, "route").sortWithinPartitions("slot", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("z").isNotNull(), "h")
    return both.drop("route").mapInArrow(_follow, f"doc_id {kind}, {OUT}, group_id {kind}, n_links long")


def _near(docs: DataFrame, similarity: float, key: str, text: str) -> DataFrame:
    """near_documents with the set_hash of each row, staged."""
    percent = round(100 * similarity, 9)
    form = (BANDS, ROWS) if similarity >= SIMILARITY else shape(percent)
    rows, classes, links, comp = linked_classes(docs, key, text, percent, form)
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(n, "rep", "left")
    out = rows.drop("n").join(named, "set_hash", "left").select("doc_id", "set_hash", F.coalesce("component", "rep", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return stage(out)


def near_documents(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, group_id (smallest key that verified pairs reach), n_links of its class representative.

    Equal shingle sets form a class with its smallest key as representative; classes that share band keys are candidates, and pairs are kept if the
    Jaccard similarity of the full sets is at least similarity. In each bucket all are first checked against one member, then what buckets still hold in
    different groups is paired by rarest shingles (minhash_dedup), so no group is split; n_links counts the links of both passes, as many as connect the
    groups and not all pairs within. Null or word-free texts stand alone.
    """
    return _near(docs, similarity, key, text).drop("set_hash")
