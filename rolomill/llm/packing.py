"""Bulk-synchronous best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Each document becomes ids plus an end id; one longer than the capacity is cut into full pieces behind a first one that takes the remainder.
2. Pieces are range-sorted by length (longest first; ties by a hash), which gives every piece its rank among pieces of its length. Lengths are integers up to the
   capacity, so pieces of a length with neighbouring ranks, and gaps of a size in neighbouring sequences, form runs: a DataFrame with a row for each run.
3. A superstep deals the runs out by ranges of size with about as many sizes each. Each range is swept from small to large: a gap run is matched with the longest pieces that fit, so that a piece gets the smallest gap
   among those that longer pieces leave; what finds no partner within its range meets in a last sweep. Conflicts are resolved by rank: of pieces
   that seek the same gaps the longest go first, then those of lower rank, and a gap run takes ranks one after another, so no two pieces claim one place. Matched gaps shrink (are
   updated), unmatched pieces and gaps are swept again in the next superstep, until no piece is left.
4. Pieces join in classes of falling length. Pieces over half the capacity all open sequences; later, those that are longer than every gap open as many as their tokens need.
5. The matches (runs of ranks -> runs of sequences) go to all tasks, which place their rows by binary search: every row is placed where it is, without another shuffle.

The number of supersteps follows from the capacity (some 30 for 2048), that of runs and matches from it and a superstep's; neither grows with the documents.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, text_of, unstage

CAPACITY, END = 2048, 0
#: A class has the lengths down to FALL of the class before; the lengths up to SHORT are one class. Ranges of a superstep.
FALL, SHORT, RANGES = 0.8, 12, 16
PIECE, GAP, MATCH = 0, 1, 2
#: Rows of runs: of pieces (length, first rank, how many), of gaps (size, first sequence, how many) and of matches (length, first rank, how many sequences; first sequence, pieces in each, offset).
RUNS = "kind int, size int, first long, n long, sequence long, each long, offset long"
#: Fixed value: the public pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: Unicode's white space. The pattern's look-ahead can't take runs of 1,000,000; texts of over 100,000 characters are cut at runs of 1,000 and more.
_WHITE, _RUN, _LONG = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 1000, 100_000
_LONG_RUN = re.compile(f"[{_WHITE}]{{{_RUN},}}")
_encodings: dict = {}


def _encoding(path: str):
    """The tokenizer file's vocabulary in tiktoken, which needs ids in the order of the merges and gives the same ids."""
    if path not in _encodings:
        import tiktoken

        from .bpe import Vocabulary

        v = Vocabulary(path)
        if v.made != sorted(v.made) or len(set(v.made)) != len(v.made):
            raise ValueError("the ids must follow the order of the merges")
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)
    return _encodings[path]


def token_ids(enc, text: str) -> np.ndarray:
    """The text's ids; special tokens in it count as such. Long runs of white space become the pre-tokens that the pattern makes of them: all of the run, less its last one if a word follows."""
    if len(text) < _LONG:
        return enc.encode_to_numpy(text, allowed_special="all")
    parts, at = [], 0
    for m in _LONG_RUN.finditer(text):
        start, end = m.span()
        if end < len(text) and not any(text.startswith(x, end) for x in enc.special_tokens_set):
            end -= 1
        parts += enc.encode_to_numpy(text[at:start], allowed_special="all"), np.array(enc._encode_single_piece(text[start:end]), np.uint32)
        at = end
    return np.concatenate([*parts, enc.encode_to_numpy(text[at:], allowed_special="all")])


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; the ids themselves are not kept."""

    def run(batches):
        enc = _encoding(path)
        for b in slices(batches):
            keys, texts = b.column(0), b.column(1).to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, t in enumerate(texts):
                ids = np.append(token_ids(enc, t), np.uint32(END)).astype("<u4")
                n = len(ids)
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    end = first if not k else at + capacity
                    for r, x in zip(rows, (i, k, at, end - at, zlib.crc32(ids[at:end].tobytes())), strict=True):
                        r.append(x)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(runs: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """One sweep over runs (see RUNS), from small to large: pieces wait on a stack, a gap run takes the longest that wait, as many as fit, by rank.

    Gives matches, what is left of the gaps and the pieces that found none. Matches that are given pass through.
    """
    out, waiting = [r for r in runs if r[0] == MATCH], []
    for kind, size, first, n, *_ in sorted((r for r in runs if r[0] != MATCH), key=lambda r: (r[1], r[0], -r[2] if r[0] == PIECE else r[2])):
        if kind == PIECE:
            waiting.append([size, first, n])
            continue
        while n and waiting:
            length, rank, left = waiting[-1]
            each = min(size // length, left)
            # full sequences, then one with the pieces that are fewer
            for take, k in ((min(n, left // each), each), (1, left % each if n > left // each else 0)):
                if take and k:
                    out.append((MATCH, length, rank, take, first, k, capacity - size))
                    if size > k * length:
                        out.append((GAP, size - k * length, first, take, 0, 0, 0))
                    first, n, rank, left = first + take, n - take, rank + take * k, left - take * k
            if left:
                waiting[-1][1:] = rank, left
            else:
                waiting.pop()
        if n:
            out.append((GAP, size, first, n, 0, 0, 0))
    return out + [(PIECE, *w, 0, 0, 0) for w in waiting]


def superstep(runs: DataFrame, sizes: list[int], capacity: int = CAPACITY) -> DataFrame:
    """Sweeps within ranges of size, then of what these leave; runs and result as in RUNS. Some thousand rows at most, whatever the input. sizes: those of the runs, sorted."""

    def swept(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sweep(list(x[names].itertuples(index=False, name=None)), capacity), columns=names)

    names = runs.columns
    bounds = sizes[:: -(-len(sizes) // RANGES)]
    local = runs.groupBy(sum((F.col("size") >= b).cast("int") for b in bounds).alias("range")).applyInPandas(swept, RUNS)
    return local.groupBy().applyInPandas(swept, RUNS)


def best_fit(pieces: DataFrame, counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[DataFrame], int]:
    """(matches of each superstep, sequences) for piece runs; counts: how many pieces there are of each length (capacity entries at most)."""
    spark = pieces.sparkSession
    state, matches, opened, bar = None, [], 0, capacity + 1
    gaps: dict[int, int] = {}
    waiting: dict[int, int] = {}
    while waiting or any(x < bar for x in counts):
        runs = [] if state is None else [state.where(F.col("kind") != MATCH)]
        if longest := max((x for x in counts if x < bar), default=0):  # the next class joins
            old, bar = bar, capacity // 2 + 1 if bar > capacity else 1 if longest <= SHORT else int(longest * FALL) + 1
            runs.append(pieces.where((F.col("size") >= bar) & (F.col("size") < old)))
            for x, n in counts.items():
                if bar <= x < old:
                    waiting[x] = n
        stuck = {x: n for x, n in waiting.items() if x > max(gaps, default=0)}
        if more := max(sum(n for x, n in stuck.items() if 2 * x > capacity), -(-sum(x * n for x, n in stuck.items()) // capacity)):
            runs.append(spark.createDataFrame([(GAP, capacity, opened, more, 0, 0, 0)], RUNS))
            opened += more
        if runs:
            state = stage(superstep(reduce(DataFrame.unionAll, runs), sorted({*waiting, *gaps, capacity}), capacity))
            matches.append(state.where(F.col("kind") == MATCH))
            sums = state.where(F.col("kind") != MATCH).groupBy("kind", "size").agg(F.sum("n").alias("n")).collect()  # 2 * capacity rows at most
            gaps, waiting = ({r["size"]: r["n"] for r in sums if r["kind"] == kind} for kind in (GAP, PIECE))
    return matches, opened


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null counts as the empty text, which is one piece of the end id alone. Repeated rows and null keys are packed like others. Only documents longer than the
    capacity are cut. Sequences are numbered from 0; each is filled without gaps from offset 0. No rows give no rows; other columns are not read.
    """
    made = stage(tokenised_pieces(docs, path, capacity, key, text))
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = made.repartitionByRange(n, F.col("length").desc(), tie).sortWithinPartitions(F.col("length").desc(), tie)
    ranked = stage(ranked.withColumn("at", F.monotonically_increasing_id()))
    # a row for each length and partition that has it: partitions plus lengths at most, as the rows are sorted
    runs = sorted(tuple(r) for r in ranked.groupBy("length", F.shiftright("at", 33).alias("part")).agg(F.min("at"), F.count("*")).collect())
    unstage(made)
    counts: dict[int, int] = {}
    base = []  # (length, first at, rank of that row)
    for length, _, first, m in runs:
        base.append((length, first, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + m
    whole = ranked.groupBy("length").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    whole = stage(whole.select(F.lit(PIECE).alias("kind"), F.col("length").cast("int").alias("size"), zero.alias("first"), "n", zero.alias("sequence"), zero.alias("each"), zero.alias("offset")))
    matches, _ = best_fit(whole, counts, capacity)
    plan = sorted((r["size"], r["first"], r["sequence"], r["each"], r["offset"]) for r in reduce(DataFrame.unionAll, matches, whole.limit(0)).collect())  # some thousand rows, see above
    b = np.array(base, np.int64).reshape(-1, 3)
    p = np.array(plan, np.int64).reshape(-1, 5)

    def place(batches):
        for x in batches:
            if not len(x):
                continue
            length, at = x["length"].to_numpy(), x["at"].to_numpy()
            rank, seq, off = (np.empty(len(x), np.int64) for _ in range(3))
            for size in np.unique(length):
                own = length == size
                lo, hi = np.searchsorted(b[:, 0], [size, size + 1])
                k = lo + np.searchsorted(b[lo:hi, 1], at[own], "right") - 1
                rank = at[own] - b[k, 1] + b[k, 2]
                lo, hi = np.searchsorted(p[:, 0], [size, size + 1])
                s = p[lo + np.searchsorted(p[lo:hi, 1], rank, "right") - 1]
                r = rank - s[:, 1]
                seq[own], off[own] = s[:, 2] + r // s[:, 3], s[:, 4] + r % s[:, 3] * size
            yield pd.concat([x.drop(columns="at"), pd.DataFrame({"sequence_id": seq, "offset": off}, index=x.index)], axis=1)

    kind = made.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
