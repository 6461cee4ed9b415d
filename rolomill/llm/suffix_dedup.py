"""Suffix-array deduplication: bytes covered by a 200-byte string that starts in more than one place of the corpus.

A suffix array of the whole corpus can't be built in one task, so suffixes are dealt to shards by content:

1. Anchors. Of every SPAN - GRAM + 1 neighbouring GRAM-byte strings the one with the least hash is an anchor. Equal SPAN-byte strings have equal anchors at equal
   places, so a repeated string is found through an anchor that repeats, with its context: all bytes a SPAN-byte string over the anchor may reach.
2. Keys (anchor hashes) that occur once are dropped. A context that occurs more than once (equal by 128 bits of hash besides the key's 64) is repeated as a whole; its bytes are sorted once.
3. The distinct contexts of a key form a shard. All have the anchor's bytes, so these count as one symbol, and a context is cut to what it has in common with any other of its shard on
   either side of the anchor (its neighbours when sorted by that side show how much). Shards of more than HOT contexts are split: a string that starts s bytes before its anchor lies within the s bytes before and
   the SPAN - GRAM - s bytes after it, so the range of s is halved again and again, and contexts go on with those that agree in all bytes that every string of their half has.
   Of contexts that have the same bytes in all strings of their half, which thus repeat, only one goes on. No string is lost; a range of a single s leaves one string to a group.
4. In every shard a suffix array is built by induced sorting: suffixes are classified, leftmost-smaller substrings are sorted, recursively where they are not all different, and
   all suffixes are induced from them. The shards of a task are worked through side by side, each step of the induction for all of them at once. Permuted common prefixes then tell which suffixes share SPAN
   bytes with a neighbour that stands at another place of the corpus.
5. The spans found are gathered by document, joined and cut out.

A text is known by its row id, a hash of key and text, so repeated rows are repeated texts. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, slices, small, stage, text_of, unstage
from .shingles import mix, powers, span_hashes

SPAN, GRAM = 200, 100
REACH = SPAN - GRAM
#: Bytes of contexts that a task works on, about; contexts of a shard that are split over tasks, and those that are split within one.
TASK_BYTES, HOT, MOST = 4_000_000, 8192, 32


def _slide(v: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over v[i : i + width] for every full window."""
    have, x = 1, v
    while 2 * have <= width:
        x = best(x[: len(x) - have], x[have:])
        have *= 2
    more = width - have
    return best(x[: len(x) - more], x[more:]) if more else x


def anchors(texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text's number, place, key, context hash, another context hash) of all anchors of texts of at least span bytes."""
    long = [i for i, t in enumerate(texts) if len(t) >= span]
    empty = np.empty(0, np.int64)
    if not long:
        return empty, empty, empty, empty, empty
    size = np.array([len(texts[i]) for i in long])
    raw = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    s = span_hashes(raw)
    inverse = powers(len(raw) + 1)[1]
    h = mix((s[gram:] - s[:-gram]) * inverse[: len(raw) - gram + 1])
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(long)), size)[: len(h)]
    h[np.arange(len(h)) + gram > end[owner]] = np.uint64(0xFFFFFFFFFFFFFFFF)  # grams that would leave their text
    width = span - gram + 1
    least = _slide(h, width, np.minimum)
    starts = np.arange(len(least))
    least[starts + span > end[owner[: len(least)]]] = 0  # windows that would leave their text are no windows
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum)[: len(h)] == h)
    at = at[h[at] != np.uint64(0xFFFFFFFFFFFFFFFF)]
    own = owner[at]
    lo, hi = np.maximum(at - (span - gram), end[own] - size[own]), np.minimum(at + span, end[own])
    form = ((at - lo) << 32 | (hi - at)).astype(np.uint64)
    ctx = mix(((s[hi] - s[lo]) * inverse[lo]) ^ form)
    s = span_hashes(raw, 1)
    other = mix(((s[hi] - s[lo]) * inverse[lo]) ^ form)
    return np.array(long)[own], at - (end - size)[own], h[at].view(np.int64), ctx.view(np.int64), other.view(np.int64)


def _classify(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one of its string; that of a string's end counts as smaller."""
    n = len(b)
    differ = np.flatnonzero(b[1:] != b[:-1])
    at = np.searchsorted(differ, np.arange(n))  # the first place from here on where a symbol and the next differ
    kind = np.append(b[1:] > b[:-1], True)[np.append(differ, n - 1)[at]]
    kind[ends] = True
    return kind


def _scan(sa: np.ndarray, bucket: np.ndarray, free: np.ndarray, at: np.ndarray, active: np.ndarray, step: int) -> None:
    """One sweep of the induction: each string's j-th suffix puts the one before it at its bucket's next free place, for all strings at once.

    bucket: of the suffix before each position, or the last one, which takes what isn't to be put anywhere; active: how many strings have a j-th suffix.
    """
    nowhere, away = len(free) - 1, free[-1]
    for m in active.tolist():
        x = sa[at[:m]]
        k = bucket[x]
        p = free[k]
        sa[p] = x - 1
        free[k] = p + step
        free[nowhere] = away
        sa[-1] = len(bucket) - 1
        at += step


def _induce(b: np.ndarray, starts: np.ndarray, size: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones in the order given; sizes fall from string to string."""
    n, buckets = len(b), int(b.max()) + 1
    count = np.bincount(b, minlength=buckets)
    end = np.cumsum(count)
    sa = np.full(n + 1, n, np.int32)  # n: nothing
    by = np.argsort(b[lms], kind="stable")
    own = b[lms][by]
    have = np.bincount(own, minlength=buckets)
    sa[(end - np.cumsum(have))[own] + np.arange(len(own))] = lms[by]
    inner = np.ones(n, bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
    for smaller in (False, True):
        put = inner[kind[inner - 1] == smaller]
        bucket = np.full(n + 1, buckets, np.int32)
        bucket[put] = b[put - 1]
        if smaller:  # from right to left, from the buckets' ends
            _scan(sa, bucket, np.append(end - 1, n).astype(np.int32), starts + size[0] - 1, active[::-1], -1)
        else:
            _scan(sa, bucket, np.append(end - count, n).astype(np.int32), starts.copy(), active, 1)
    return sa[:n]


def suffix_arrays(b: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of concatenated strings by induced sorting (SA-IS), side by side: positions in all of b, string by string.

    Symbols are numbers that grow from string to string; each string ends with its least symbol, which it has once.
    """
    order = np.argsort(-size, kind="stable")
    if (order[1:] < order[:-1]).any():  # longest first
        now = size[order]
        at = np.cumsum(now) - now
        src = np.repeat(starts[order] - at, now) + np.arange(len(b))
        c = b[src]
        least = np.minimum.reduceat(c, at)
        width = np.maximum.reduceat(c, at) - least + 1
        out = np.empty(len(b), np.int64)
        out[src] = src[suffix_arrays(c + np.repeat(np.cumsum(width) - width - least, now), at, now)]
        return out
    ends = starts + size - 1
    kind = _classify(b, starts, ends)
    marked = np.append(False, kind[1:] & ~kind[:-1])
    marked[starts], marked[ends] = False, True
    lms = np.flatnonzero(marked)
    order = _induce(b, starts, size, kind, lms)
    order = order[marked[order]]  # sorted by the substrings up to the next leftmost-smaller suffix
    after = np.zeros(len(b), np.int64)
    after[lms[:-1]] = lms[1:]
    after[ends] = 0
    length = np.where(after[order] > 0, after[order] - order, -1)
    equal = np.zeros(len(order), bool)
    at, k = np.flatnonzero((length[1:] == length[:-1]) & (length[1:] > 0)) + 1, 0
    while len(at):
        at = at[b[order[at] + k] == b[order[at - 1] + k]]
        done = length[at] == k
        equal[at[done]] = True
        at, k = at[~done], k + 1
    if equal.any():
        name = np.empty(len(b), np.int64)
        name[order] = np.cumsum(~equal) - 1
        first = np.searchsorted(lms, starts)
        order = lms[suffix_arrays(name[lms], first, np.searchsorted(lms, ends) + 1 - first)]
    return _induce(b, starts, size, kind, order)


def common_prefixes(symbol: np.ndarray, before: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each position in text order how many symbols its suffix shares with the one before it in the suffix array, most at most.

    before: that suffix, or -1; room: symbols up to the context's end. A position's value is at least that of d positions earlier less d, so every other position is
    worked out first, then those between from what is known; symbols (16 bits) are compared four at a time, many positions side by side.
    """
    n = len(symbol)
    cap = np.where(before >= 0, np.minimum(np.minimum(room, room[before]), most), 0)
    wide = np.concatenate([symbol.astype(np.uint64), np.zeros(most + 8, np.uint64)])
    words = wide[: n + most + 4].copy()
    for k in range(1, 4):
        words |= wide[k : k + len(words)] << np.uint64(16 * k)
    shared = np.zeros(n, np.int64)
    d = 128
    at = np.arange(0, n, d)
    while True:
        todo = at[shared[at] < cap[at]]
        while len(todo):
            have = shared[todo]
            x = words[todo + have] ^ words[before[todo] + have]
            low = x & (~x + np.uint64(1))  # the lowest bit that differs
            same = np.where(x == 0, 4, np.frexp(low.astype(np.float64))[1] - 1 >> 4)
            shared[todo] = have = np.minimum(have + same, cap[todo])
            todo = todo[(same == 4) & (have < cap[todo])]
        if d == 1:
            return shared
        d //= 2
        at = np.arange(d, n, 2 * d)
        shared[at] = np.minimum(np.maximum(shared[at - d] - d, 0), cap[at])


#: Symbols: 0 ends a shard, 1 a context; bytes follow from 2 on; the anchor.
ANCHOR = 258


def repeated_windows(strings: list[bytes], anchor: np.ndarray, shard: np.ndarray, place: np.ndarray, many: np.ndarray, reach: int) -> list[np.ndarray]:
    """For each string the offsets from which reach + 1 symbols over its anchor also stand at another place of the corpus, among the strings of its shard.

    strings: contexts with one byte for the anchor, at the offset that anchor has; shard: the shards' numbers, rising; place: a number for each string's first byte, such that equal sums
    place + offset mean the same place; many: whether the whole context stands in several places.
    """
    if not strings:
        return []
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    symbol = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 2
    start = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(n), size + 1)
    room = (start + size)[owner] - np.arange(len(symbol))
    new = np.append(True, shard[1:] != shard[:-1])
    symbol[start + size] = np.append(new[1:], True) ^ 1
    symbol[start + anchor] = ANCHOR
    key = symbol + (ANCHOR + 1) * (np.cumsum(new) - 1)[owner]
    used = np.bincount(key) > 0
    starts = start[new]
    sa = suffix_arrays((np.cumsum(used) - 1)[key], starts, np.diff(starts, append=len(symbol)))
    before = np.full(len(symbol), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[starts]] = -1
    joined = common_prefixes(symbol, before, room, reach + 1)[sa] > reach
    # runs of ranks that share so many symbols are equal; only those within one string count
    inside = room[sa] > reach
    run, pos = np.cumsum(~joined)[inside], sa[inside]
    if not len(pos):
        return [np.empty(0, np.int64)] * n
    where = place[owner[pos]] + pos - start[owner[pos]]
    first = np.flatnonzero(np.diff(run, prepend=-1))
    differ = np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first)
    differ |= np.maximum.reduceat(many[owner[pos]].astype(np.int8), first) > 0
    hit = pos[np.repeat(differ, np.diff(first, append=len(run)))]
    hit.sort()
    cut = np.searchsorted(owner[hit], np.arange(n + 1))
    return [hit[i:j] - start[k] for k, (i, j) in enumerate(zip(cut, cut[1:]))]


def _agreement(group: np.ndarray, parts: list[bytes], reach: int) -> np.ndarray:
    """The longest common prefix of each part with any other of its group: its neighbours' when sorted."""
    n, wide = len(parts), -(-reach // 8) * 8
    size = np.fromiter(map(len, parts), np.int64, n)
    m = np.frombuffer(b"".join([x.ljust(wide, b"\0") for x in parts]), np.uint8).reshape(n, wide)
    order = np.lexsort((*m.view(">u8").T[::-1].astype(np.uint64), group))
    x, y = order[:-1], order[1:]
    x, y = x[group[x] == group[y]], y[group[x] == group[y]]
    differ = m[x] != m[y]
    common = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), wide), np.minimum(size[x], size[y]))
    most = np.full(n, -1, np.int64)
    np.maximum.at(most, x, common)
    np.maximum.at(most, y, common)
    return most


def halves(lo: int, hi: int) -> tuple[tuple[int, int], tuple[int, int]]:
    mid = (lo + hi) // 2
    return (lo, mid), (mid + 1, hi)


def agreed(context: bytes, before: int, lo: int, hi: int, reach: int, gram: int) -> bytes:
    """The bytes of every string over the anchor that starts lo to hi bytes before it, as far as the context has them. before: the context's bytes before the anchor."""
    return context[max(0, before - lo) : before + gram + max(0, reach - hi)]


def small_shards(rows: list[int], lo: int, hi: int, contexts: list[bytes], before: np.ndarray, least: np.ndarray, most: np.ndarray, reach: int, gram: int):
    """(rows, lo, hi) of shards with MOST contexts at most, or with a single start lo = hi: those agree in their whole string. A row's strings start least to most bytes before its anchor."""
    if len(rows) <= MOST or lo == hi:
        if len(rows) > 1:
            yield rows, lo, hi
        return
    for a, b in halves(lo, hi):
        groups: dict[bytes, list[int]] = {}
        for i in rows:
            if least[i] <= b and most[i] >= a:
                groups.setdefault(agreed(contexts[i], before[i], a, b, reach, gram), []).append(i)
        for own in groups.values():
            yield from small_shards(own, a, b, contexts, before, least, most, reach, gram)


def repeated_spans(groups: list, counts: np.ndarray, rids: np.ndarray, ats: np.ndarray, contexts: list[bytes], span: int = SPAN, gram: int = GRAM, stats: list | None = None) -> list[tuple[int, int, int]]:
    """(rid, from, to) of what repeats in contexts that stand once (counts 1); others only serve as partners.

    groups: (key, lo, hi) of each context; contexts of a group are distinct and share strings that start lo to hi bytes before the anchor. stats gets the symbols that were sorted.
    """
    reach, n = span - gram, len(contexts)
    before = np.minimum(ats, reach)
    members: dict[tuple, int] = {}
    group = np.fromiter((members.setdefault(g, len(members)) for g in groups), np.int64, n)
    lo, hi = (np.fromiter((g[k] for g in groups), np.int64, n) for k in (1, 2))
    if not n:
        return []
    least = np.maximum(lo, reach - _agreement(group, [c[b + gram :] for c, b in zip(contexts, before, strict=True)], reach))
    most = np.minimum(hi, _agreement(group, [c[:b][::-1] for c, b in zip(contexts, before, strict=True)], reach))
    able = np.flatnonzero(least <= most)
    able = able[np.argsort(group[able], kind="stable")]
    out: list[tuple[int, int, int]] = []
    todo: list[tuple[int, list[int], int, bytes]] = []  # shard, rows with this string, the anchor's offset, bytes
    total = number = 0

    def flush():
        nonlocal total
        if todo:
            shard, anchor = (np.array([t[k] for t in todo], np.int64) for k in (0, 2))
            row = np.array([t[1][0] for t in todo], np.int64)
            many = np.array([len(t[1]) > 1 for t in todo]) | (counts[row] > 1)
            place = mix(rids[row].view(np.uint64)).view(np.int64) + ats[row] - anchor
            found = repeated_windows([t[3] for t in todo], anchor, shard, place, many, reach)
            for (_, rows, left, _), w in zip(todo, found, strict=True):
                if len(w):
                    cuts = np.flatnonzero(np.diff(w) > span) + 1
                    runs = [(x[0], x[-1] + span) for x in (np.split(w, cuts) if len(cuts) else [w])]
                    out.extend((rids[i], ats[i] - left + x, ats[i] - left + y) for i in rows if counts[i] == 1 for x, y in runs)
            if stats is not None:
                stats.append(total)
        todo.clear()
        total = 0

    for rows in np.split(able, np.flatnonzero(np.diff(group[able])) + 1):
        for own, a, b in small_shards(rows.tolist(), int(lo[rows[0]]), int(hi[rows[0]]), contexts, before, least, most, reach, gram) if len(rows) else ():
            if a == b and len(own) > MOST:
                out += [(rids[i], ats[i] - a, ats[i] - a + span) for i in own if counts[i] == 1]
                continue
            alike: dict[tuple[int, bytes], list[int]] = {}
            for i in own:
                left, right, at = min(b, most[i]), reach - max(a, least[i]), before[i]
                alike.setdefault((left, contexts[i][at - left : at] + b"\0" + contexts[i][at + gram : at + gram + right]), []).append(i)
            if len(alike) == 1:  # nothing to compare with: all of it repeats
                (left, x), _ = alike.popitem()
                out += [(rids[i], ats[i] - left, ats[i] - left + len(x) - 1 + gram) for i in own if counts[i] == 1]
                continue
            number += 1
            for (left, x), same in alike.items():
                todo.append((number, same, left, x))
                total += len(x)
            if total >= TASK_BYTES:
                flush()
    flush()
    return _union(out)


def _union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans (rid, from, to) of each rid as maximal runs."""
    if not spans:
        return spans
    rid, lo, hi = np.array(spans, np.int64).T
    order = np.lexsort((lo, rid))
    rid, lo, hi = rid[order], lo[order], hi[order]
    text = np.cumsum(np.append(0, rid[1:] != rid[:-1]))
    far = np.maximum.accumulate(text * (1 << 40) + hi)  # the largest end so far, of the text or one before it
    first = np.flatnonzero(np.append(True, text[1:] * (1 << 40) + lo[1:] > far[:-1]))
    ends = far[np.append(first[1:], len(far)) - 1] - text[first] * (1 << 40)
    return list(zip(rid[first].tolist(), lo[first].tolist(), ends.tolist(), strict=True))


def _joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])) if len(lo) else np.empty(0, np.int64)
    return lo[new], (hi[np.append(new[1:], len(hi)) - 1] if len(lo) else hi)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    Null counts as the empty text; repeated rows are repeated texts and lose what repeats; null keys are keys like others. Texts under span bytes lose
    nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("text"))
    rid = lambda k, t: xxhash.xxh3_64_intdigest(t, seed=xxhash.xxh3_64_intdigest(str(k))) - (1 << 63)
    reach = span - gram

    def mark(batches):
        for b in slices(batches):
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in pieces(texts, 100_000):  # arrays that fit a CPU's cache
                data = [t.encode("utf-8", "surrogatepass") for t in texts[i:j]]
                own, at, k, ctx, other = anchors(data, span, gram)
                ids = np.array([rid(a, t) for a, t in zip(keys[i:j], data, strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(ctx), pa.array(other), pa.array(ids[own]), pa.array(at.astype(np.int32))], ["key", "ctx", "other", "rid", "at"])

    def shrink(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            data = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            ids = [rid(a, t) for a, t in zip(b.column(0).to_pylist(), data, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array([z.compress(t) for t in data], pa.binary())], ["doc_id", "rid", "z"])

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for z_text, want in zip(b["z"], b["want"], strict=True):
                t = z.decompress(z_text)
                rows += [(w["key"], w["c"], w["rid"], w["at"], t[max(0, w["at"] - reach) : w["at"] + span]) for w in want]
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["key", "c", "rid", "at", "context"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["key", "c", "rid", "at", "context"])

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        c, rid, at = (part[x].to_numpy(np.int64) for x in ("c", "rid", "at"))
        return pd.DataFrame(repeated_spans(list(zip(part["key"], part["lo"], part["hi"])), c, rid, at, list(part["context"]), span, gram), columns=["rid", "lo", "hi"])

    def split(batches):
        for b in batches:
            rows = []
            for key, lo, hi, c, r, at, x in b[names].itertuples(index=False, name=None):
                before = min(at, reach)
                after = len(x) - before - gram
                for i, j in halves(lo, hi):
                    if max(i, reach - after) <= min(j, before):  # it has such a string
                        left, right = min(j, before), min(after, reach - i)
                        own = xxhash.xxh3_128_digest(key + b"%d:%d:" % (i, j) + agreed(x, before, i, j, reach, gram))
                        rows.append((own, i, j, c, r, at, x, xxhash.xxh3_128_digest(b"%d:" % left + x[before - left : before + gram + right]), at - left, at + gram + right))
            yield pd.DataFrame(rows, columns=[*names, "part", "start", "end"])

    def remove(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for k, z_text, spans in zip(b["doc_id"], b["z"], b["spans"], strict=True):
                t = z.decompress(z_text)
                lo, hi = (np.array([s[c] for s in spans], np.int64) if spans is not None else np.empty(0, np.int64) for c in ("lo", "hi"))
                lo, hi = _joined(lo, np.minimum(hi, len(t)))
                rest = b"".join([t[i:j] for i, j in zip([0, *hi], [*lo, len(t)])])
                out.append((k, len(t), len(t) - len(rest), len(lo), rest, hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]).astype({"doc_id": b["doc_id"].dtype})

    names = ["key", "lo", "hi", "c", "rid", "at", "context"]
    shards_of = "key binary, lo int, hi int, c long, rid long, at int, context binary"
    marks = src.mapInArrow(mark, "key long, ctx long, other long, rid long, at int")
    keys = marks.groupBy("key").agg(F.count("*").alias("c"), *(f(x).alias(f"{n}_{x}") for x in ("ctx", "other") for n, f in (("min", F.min), ("max", F.max)))).where("c > 1")
    keys = stage(keys.select("key", ((F.col("min_ctx") != F.col("max_ctx")) | (F.col("min_other") != F.col("max_other"))).alias("multi")))
    found = stage(marks.join(keys, "key"))
    multi = found.where("multi")
    contexts = stage(multi.groupBy("key", "ctx", "other").agg(F.count("*").alias("c"), F.min(F.struct("rid", "at")).alias("r")).select("key", "ctx", "other", "c", "r.rid", "r.at"))
    whole = F.greatest(F.col("at") - reach, F.lit(0)).alias("lo"), (F.col("at") + span).alias("hi")
    again = stage(contexts.where("c > 1").select("key", "ctx", "other"))
    same = found.where("not multi").select("rid", *whole).unionAll(multi.join(small(again), ["key", "ctx", "other"]).select("rid", *whole))
    texts = src.mapInArrow(shrink, f"doc_id {kind}, rid long, z binary")

    def bytes_of(some: DataFrame) -> DataFrame:
        want = some.groupBy("rid").agg(F.collect_list(F.struct("key", "c", "rid", "at")).alias("want"))  # bounded by a text's length
        one = texts.select("rid", "z").join(want, "rid").dropDuplicates(["rid"])
        cuts = one.mapInPandas(cut, "key long, c long, rid long, at int, context binary")
        return cuts.select(F.hex("key").cast("binary").alias("key"), F.lit(0).alias("lo"), F.lit(reach).alias("hi"), "c", "rid", "at", "context")

    hot = stage(contexts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
    ready, alike_spans = [bytes_of(contexts.join(small(hot), "key", "left_anti"))], []  # what is sorted; spans of contexts that agree in all strings of a half
    if hot.take(1):
        some = stage(bytes_of(contexts.join(small(hot), "key", "left_semi")))
        while some is not None:
            parts = stage(some.mapInPandas(split, shards_of + ", part binary, start int, end int"))
            unstage(some)
            alike = stage(parts.groupBy("key", "part").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one")).where("n > 1"))
            parts = parts.join(small(alike), ["key", "part"], "left")
            alike_spans.append(stage(parts.where("n > 1 and c = 1").select("rid", F.col("start").alias("lo"), F.col("end").alias("hi"))))
            one = parts.where("n is null or (one.rid = rid and one.at = at)").withColumn("c", F.coalesce("n", "c")).select(names)
            n = stage(one.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
            one = one.join(small(n), "key")
            ready.append(stage(one.where(F.col("n") <= HOT).drop("n")))
            some = one.where(F.col("n") > HOT).drop("n")
            some = stage(some) if some.take(1) else None
    cuts = reduce(DataFrame.unionAll, ready)
    tasks = max(1, contexts.count() * (2 * span - gram) // TASK_BYTES)
    sorted_ = cuts.groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task")).applyInPandas(lambda s: sort(s), "rid long, lo int, hi int")
    spans = reduce(DataFrame.unionAll, [same, sorted_, *alike_spans]).groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # bounded by a text's length
    return texts.join(spans, "rid", "left").select("doc_id", "z", "spans").mapInPandas(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
