"""MinHash near-deduplication: universal hash minima in bands, signature check, exact check, components by large-star and small-star.

Links are pairs with Jaccard similarity of at least percent / 100 between five-word shingle sets; percent is a parameter, PERCENT the value of op6's
contract. The steps:

1. One pass over the texts (vectorised numpy) gives each document its set's size, a 128-bit hash of the set and the lower halves of its minima. Equal sets form a
   class; the smallest doc_id stands for it, so copies are never paired.
2. Band keys (hashes of a few neighbouring minima, made in Spark) that two classes share make them candidates: shape() chooses how many so that P(a pair at percent shares none) is under 1e-6.
3. Exact pruning: a shingle that no other candidate has can't be shared. With m the shingles of a set that some other candidate has, J is at most
   min(m) / (n1 + n2 - min(m)); a candidate with m under percent of n has no link at all and leaves. This keeps large groups of loosely alike texts from being paired.
4. In each bucket all members are checked against the member with the fewest own shingles (a star, linear in the bucket). Checks compare signatures, then full sets.
   A star's centre meets its many partners in salted parts, and its set isn't shuffled with them.
5. Documents of buckets that still hold different components are then paired across components by their rarest shingles (prefix and place filter, exact) and
   checked, so no link is lost and no group is expanded into all pairs.
6. Components over the confirmed links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, pieces, slices, small, stage, text_of, unstage
from .graph import components
from .shingles import MinHash, sets, shingles, short

PERCENT = 85
#: Partners of a star's centre that meet it in one part.
PARTNERS = 128


def shape(percent: float) -> tuple[int, int]:
    """(bands, rows): a pair at percent shares no band key with P under 2.5e-7; (26, 5) at 85, (29, 4) at 80."""
    p = min(percent / 100, 0.99)
    rows = max(1, min(8, int(math.log(0.4) / math.log(p))))
    return math.ceil(math.log(2.5e-7) / math.log1p(-(p**rows))), rows


def least_equal(percent: float, n: int) -> int:
    """Fewer equal minima than this can't come from a link but for a chance of about 1e-6 (5.1 standard deviations below the mean of n)."""
    p = percent / 100
    return int((p - 5.1 * math.sqrt(p * (1 - p) / n)) * n)


def band_keys(sig, n_bands: int, rows: int):
    """One 64-bit key for each band of so many rows of a short signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.substring(sig, i * (2 * rows) + 1, F.lit(2 * rows))))


def _fingerprint(batches, minima):
    mh = MinHash(minima)
    for b in slices(batches):
        ids, texts = b.column(0), b.column(1).to_pylist()
        for i, j in pieces(texts):
            h, n = shingles(texts[i:j])
            own = [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
            cols = [pa.array([len(x) for x in own], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary()), pa.array([x.tobytes() for x in short(mh(h, n))], pa.binary())]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *cols], ["doc_id", "n", "set_hash", "sig"])


def _blobs(batches):
    for b in slices(batches):
        ids, texts = b.column(0), b.column(1).to_pylist()
        for i, j in pieces(texts):
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([x.tobytes() for x in sets(texts[i:j])], pa.binary())], ["rep", "blob"])


def _unfold(batches):
    for b in batches:
        ids = b.column(0).to_numpy()
        blobs = b.column(1).to_pylist()
        n = np.array([len(x) // 8 for x in blobs], np.int64)
        for i, j in pieces(blobs, 1_000_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs[i:j]), np.int64)), pa.array(np.repeat(ids[i:j], n[i:j]))], ["s", "rep"])


def _alike(batches, least):
    """Keep pairs whose signatures agree in least minima or more."""
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(len(b), -1) for c in ("ba", "bb"))
            yield b.loc[(x == y).sum(axis=1) >= least, ["a", "b"]]


def _linked(batches, percent):
    """Keep pairs whose full sets are similar enough. The sets are read where Arrow has them, without copies."""
    for b in batches:
        ok = []
        for x, y in zip(b.column("ba"), b.column("bb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _turned(pairs: DataFrame) -> DataFrame:
    """pairs (a, b), staged, with the one that has more pairs as a."""
    degree = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS))
    if not degree.take(1):
        return pairs
    of = lambda c: small(degree.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")))
    turn = F.coalesce("n_b", F.lit(0)) > F.coalesce("n_a", F.lit(0))
    out = stage(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b")))
    unstage(degree)
    return out


def _met(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column of table (rep, column) for both, as ba and bb. a may have very many pairs: then it is there once for each PARTNERS of them."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS)
    many = stage(many.select("a", F.ceil(F.col("n") / PARTNERS).cast("int").alias("parts")))
    cut = pairs.join(small(many), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).drop("parts")
    centre = table.select(F.col("rep").alias("a"), F.col(column).alias("ba")).join(small(many), "a", "left")
    centre = centre.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    return cut.join(table.select(F.col("rep").alias("b"), F.col(column).alias("bb")), "b").join(centre, ["a", "part"]).select("a", "b", "ba", "bb")


def _confirm(pairs: DataFrame, sigs: DataFrame, blobs: DataFrame, percent: float, least: int) -> DataFrame:
    kind = f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}"
    near = stage(_met(pairs, sigs, "sig").mapInPandas(lambda x: _alike(x, least), kind))
    with batches_of(pairs.sparkSession, 500):  # two sets in each row
        out = stage(_met(near, blobs, "blob").mapInArrow(lambda x: _linked(x, percent), kind))
    unstage(near)
    return out


def _bound(m1, n1, m2, n2, percent):
    """Whether a pair may be a link, by the shingles that any other candidate has."""
    m = F.least(m1, m2)
    return 100 * m >= percent * (n1 + n2 - m)


def _rare_pairs(rest: DataFrame, blobs: DataFrame, kind: str, percent: float) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(rep, rep2), and what to unstage after use, of different components that may be links; rest: rep, n, comp. No link between components is left out.

    Shingles are put in one order, those of the fewest documents first. A link shares a shingle within the first n - ceil(n percent / 100) + 1 of both sets, and
    from the places of the first one they share follows the most they can share. Sets that differ from all others in many rare shingles thus meet nobody,
    however many there are and however many shingles of the common kind they have.
    """
    s = blobs.join(small(rest.select("rep")), "rep").mapInArrow(_unfold, f"s long, rep {kind}")
    every = s = stage(s)
    s = s.join(s.groupBy("s").agg(F.count("*").alias("c")), "s").join(rest, "rep")
    s = s.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("c", "s")) - 1)
    s = stage(s.where((F.col("c") > 1) & (F.col("at") <= F.col("n") - F.ceil(percent * F.col("n") / 100))).select("s", "rep", "n", "comp", "at"))
    unstage(every)
    # whether two rows may link by size and place depends on their (n, at) alone: these meet first, so a shingle that very many rows share at places that can't link makes no pairs
    kinds = stage(s.groupBy("s", "n", "at").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    other = kinds.select("s", *(F.col(c).alias(f"{c}2") for c in ("n", "at", "lo", "hi")))
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    may = kinds.join(other, "s").where(((100 + percent) * most >= percent * (F.col("n") + F.col("n2"))) & ~((F.col("lo") == F.col("hi2")) & (F.col("lo2") == F.col("hi")))).select("s", "n", "at", "n2", "at2")
    second = s.select("s", F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("rep").alias("rep2"), F.col("comp").alias("comp2"))
    return s.join(may, ["s", "n", "at"]).join(second, ["s", "n2", "at2"]).where("comp < comp2"), (s, kinds)


def linked_classes(docs: DataFrame, key: str, text: str, percent: float, form: tuple[int, int]) -> tuple[DataFrame, ...]:
    """(rows, classes, links, components) of docs, with form = (bands, rows).

    rows: doc_id, n (of shingles), set_hash (null if without shingles or key); classes: set_hash, rep (smallest key); links: a, b, the confirmed pairs of
    reps; components: node, component.
    """
    kind, (n_bands, rows) = docs.schema[key].dataType.simpleString(), form
    least = least_equal(percent, n_bands * rows)
    src = docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("text"))
    meta = stage(src.mapInArrow(lambda x: _fingerprint(x, n_bands * rows), f"doc_id {kind}, n long, set_hash binary, sig binary"))
    full = meta.where("n > 0 and doc_id is not null")
    classes = stage(full.groupBy("set_hash").agg(F.min("doc_id").alias("rep")))
    reps = meta.join(classes, (F.col("doc_id") == F.col("rep")) & (meta.set_hash == classes.set_hash)).select("rep", "n", "sig").dropDuplicates(["rep", "n"])
    reps = stage(reps)
    keys = reps.select("rep", F.explode(band_keys(F.col("sig"), n_bands, rows)).alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    members = stage(keys.join(shared, "key"))
    cands = stage(members.select("rep").distinct())
    sigs = reps.select("rep", "sig")
    blobs = stage(src.join(small(cands), src.doc_id == cands.rep, "left_semi").mapInArrow(_blobs, f"rep {kind}, blob binary").dropDuplicates(["rep"]))
    own = blobs.mapInArrow(_unfold, f"s long, rep {kind}").groupBy("s").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1").groupBy("rep").agg(F.count("*").alias("u"))
    live = reps.select("rep", "n").join(cands, "rep").join(own, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("m")).where(100 * F.col("m") >= percent * F.col("n"))
    live = stage(live)
    m = members.join(live, "rep")
    lead = m.groupBy("key").agg(F.min(F.struct(F.col("n") - F.col("m"), "rep", "n", "m")).alias("l")).select("key", F.col("l.rep").alias("lrep"), F.col("l.n").alias("ln"), F.col("l.m").alias("lm"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = stage(m.join(lead, "key").where((F.col("rep") != F.col("lrep")) & _bound(F.col("m"), F.col("n"), F.col("lm"), F.col("ln"), percent)).select(F.col("lrep").alias("a"), F.col("rep").alias("b")).distinct())
    links = _confirm(tried, sigs, blobs, percent, least)
    comp = stage(components(links))
    mc = m.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", "m", F.coalesce("component", "rep").alias("comp"))
    split = mc.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = stage(mc.join(split, "key").select("rep", "n", "comp").distinct())
    more, rare = _rare_pairs(rest, blobs, kind, percent)
    more = stage(more.select(*pair("rep", "rep2")).distinct().join(tried.select(*pair("a", "b")), ["a", "b"], "left_anti"))
    unstage(*rare)
    links = stage(links.unionAll(_confirm(_turned(more), sigs, blobs, percent, least)).select(*pair("a", "b")).distinct())
    unstage(reps, members, cands, blobs, live, tried, comp, rest, more)
    out = meta.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    return out, classes, links, stage(components(links))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: float = PERCENT) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (smallest key reachable), kept (key = component_id).

    Null or word-free texts have no shingles and link with nothing; equal sets are linked. A row with a null key stands alone: component_id null, kept
    true. Rows that share a key count as one node (their links are joined). No rows give no rows; other columns are not read.
    """
    out, classes, _, comp = linked_classes(docs, key, text, percent, shape(percent))
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = out.join(named, "set_hash", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"))
