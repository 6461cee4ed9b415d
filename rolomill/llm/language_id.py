"""Language identification by a linear-chain conditional random field over words, for code-switched text too.

Every word is a position; its features are affixes (1 to 3 letters), inner n-grams (2 and 3 letters), the word itself and its class in a lexicon. The lexicon
is learned from the training words: it has the words of two documents or more with the language that most of them are in and how sure that is. While the
weights are learned, a document's words are looked up in the lexicon of the other half of the documents, as its own would be right too often. Labels are the languages. Emission
weights and a transition matrix are learned together by gradient ascent on the conditional likelihood, computed by forward-backward. Training sequences switch language
in places: runs of words of several documents are joined, as documents alone would teach that languages never change within a text.

Prediction runs forward-backward over the words of every whole text and adds up the words' posteriors by the number of their letters; the
label with the largest share wins, the share is the score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import odd
from .common import give_back, pieces, slices, text_of
from .shingles import powers

#: Bound of the training sample: so many documents of each label, those whose ids hash lowest; their whole texts are used.
TRAIN_EACH = 400
#: A lexicon class is a label and one of LEVELS: the least share of a word's documents that are in that language.
LEVELS = (0.0, 0.8, 0.99)
#: Hashed features; words of a training sequence; words of a run of one language in it; epochs; learning rate; weight decay.
BITS, SEQUENCE, RUN, EPOCHS, RATE, DECAY = 16, 100, 12, 6, 0.3, 1e-5
#: Characters that are labelled at a time (a single text may be longer), and words whose scores are remembered: both bound the memory of a Python worker.
PIECE, KNOWN = 1_000_000, 200_000
BUCKETS = 1 << BITS
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, lower-cased; odd numerals, which re takes for letters, aren't any."""
    if not text.isascii() and not odd().isdisjoint(text):
        text = "".join([" " if c in odd() else c for c in text])
    return _LETTERS.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): hashed features of words of any length, in order: the word, prefixes, suffixes, inner bigrams and trigrams with < and > as its ends."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    c = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    at = end - size
    counts = 7 + (size - 1) + (size - 2)
    to = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)

    def put(where, kind, *chars):
        h = np.full(len(where), (kind + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for x in chars:
            h = (h ^ x) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        out[where] = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)

    p, inverse = powers(len(c) + 1)
    s = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c + np.uint64(7)) * p[: len(c)], out=s[1:])
    put(to, 0, (s[end] - s[at]) * inverse[at])
    one, two, three = at + 1, np.minimum(at + 2, end - 1), np.minimum(at + 3, end - 1)
    put(to + 1, 1, c[one])
    put(to + 2, 2, c[one], c[two])
    put(to + 3, 3, c[one], c[two], c[three])
    one, two, three = end - 2, np.maximum(end - 3, at), np.maximum(end - 4, at)
    put(to + 4, 4, c[one])
    put(to + 5, 5, c[one], c[two])
    put(to + 6, 6, c[one], c[two], c[three])
    i = np.arange(len(c))
    slot = np.repeat(to + 7 - at, size) + i
    left = np.repeat(end, size) - i
    k = np.flatnonzero(left > 1)
    put(slot[k], 7, c[k], c[k + 1])
    k = np.flatnonzero(left > 2)
    put(slot[k] + np.repeat(size - 1, size)[k], 8, c[k], c[k + 1], c[k + 2])
    return out, counts


def _scan(step, e: np.ndarray, starts: np.ndarray, init: np.ndarray, block: int = 512) -> np.ndarray:
    """x[t] = step(x[t - 1], e[t]), scaled to sum 1, within sequences that begin at starts, where x[start] = init[start]; step is linear in x.

    Exact, in blocks that are worked through side by side: a long sequence's blocks are first multiplied out, then follow one another, then
    all blocks fill in their positions.
    """
    n, k = init.shape
    size = np.diff(starts, append=n)
    per = -(-size // block)
    first = np.cumsum(per) - per
    owner = np.repeat(np.arange(len(starts)), per)
    nth = np.arange(len(owner)) - first[owner]
    at = starts[owner] + nth * block
    length = np.minimum(block, size[owner] - nth * block)
    order = np.argsort(-length, kind="stable")
    enter = np.empty((len(at), k))
    enter[first] = init[starts]
    if len(owner) > len(starts):
        more = np.flatnonzero(nth + 1 < per[owner])  # blocks that another follows; they are all full
        prod = np.broadcast_to(np.eye(k), (len(more), k, k)).copy()
        for j in range(block):
            go = slice(None) if j else np.flatnonzero(nth[more] > 0)
            v = step(prod[go], e[at[more][go] + j][:, None, :])
            prod[go] = v / v.sum(axis=(1, 2), keepdims=True)
        place = np.full(len(at), -1)
        place[more] = np.arange(len(more))
        for j in range(1, int(per.max())):
            on = first[per > j] + j
            v = np.einsum("bi,bij->bj", enter[on - 1], prod[place[on - 1]])
            enter[on] = v / v.sum(axis=1, keepdims=True)
    x = np.empty((n, k))
    at, v, begin = at[order], enter[order], nth[order] == 0
    live = np.searchsorted(-length[order], -np.arange(block), "left")  # how many blocks have more than j positions
    for j in range(block):
        m = int(live[j])
        if not m:
            break
        where, y = at[:m] + j, v[:m]
        z = step(y, e[where])
        if not j:
            z = np.where(begin[:, None], y, z)
        v = z / z.sum(axis=1, keepdims=True)
        x[where] = v
    return x


def forward_backward(scores: np.ndarray, trans: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the labels, and the scaled forward and backward vectors, of concatenated sequences that begin at starts."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    n = len(e)
    f = _scan(lambda v, x: (v @ t) * x, e, starts, e / e.sum(axis=1, keepdims=True))
    # backwards: the reversed sequences, with the next word's emission on the way
    rev = (n - np.append(starts[1:], n))[::-1]
    nxt = np.roll(e[::-1], 1, axis=0)  # at reversed position r: the emission of the word after it
    b = _scan(lambda v, x: (v * x) @ t.T, nxt, rev, np.full_like(e, 1 / e.shape[1]))[::-1]
    p = f * b
    return p / p.sum(axis=1, keepdims=True), f, b


class Crf:
    """Learned weights; labels are sorted."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.w = np.zeros((BUCKETS, len(labels)), np.float32)
        self.lexicon: dict[str, int] = {}
        self.l = np.zeros((len(labels) * len(LEVELS) + 1, len(labels)), np.float32)  # the last class: not in the lexicon
        self.t = np.zeros((len(labels), len(labels)))
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 16, len(labels)), np.float32)

    def copy(self) -> Crf:
        """The same weights with nothing remembered, for another process."""
        m = Crf(self.labels)
        m.w, m.t, m.l, m.lexicon = self.w, self.t, self.l, self.lexicon
        return m

    def _classes(self, seen: np.ndarray, words: list[str], least: int = 2) -> dict[str, int]:
        """Words to lexicon classes; seen: in how many documents of each label each word stands."""
        n = seen.sum(axis=1)
        best = seen.argmax(axis=1)
        level = np.searchsorted(LEVELS, seen[np.arange(len(n)), best] / np.maximum(n, 1), "right") - 1
        return {words[i]: int(best[i] * len(LEVELS) + level[i]) for i in np.flatnonzero(n >= least)}

    def fit(self, texts: list[str], langs: list[str], seed: int = 5) -> Crf:
        """Learns lexicon, emission weights and transitions from whole texts; no labels or no words leave all weights 0."""
        rng, k = np.random.default_rng(seed), len(self.labels)
        vocab: dict[str, int] = {}
        runs, half, gold_of, docs = [], [], [], []
        many = Counter()
        for text, lang in zip(texts, langs, strict=True):
            y = self.labels.index(lang)
            h = many[y] % 2  # each label's documents are halved
            many[y] += 1
            ids = np.array([vocab.setdefault(w, len(vocab)) for w in words_of(text)], np.int32)
            docs.append((np.unique(ids), y, h))
            for i in range(0, len(ids), RUN):
                runs.append(ids[i : i + RUN])
                half.append(h)
                gold_of.append(y)
        if not runs:
            return self
        seen = np.zeros((2, len(vocab), k), np.int64)
        for ids, y, h in docs:
            seen[h, ids, y] += 1
        words, none = list(vocab), len(self.l) - 1
        self.lexicon = self._classes(seen.sum(axis=0), words)
        # a word in a document of one half is looked up among the other half's documents
        other = np.full((2, len(vocab)), none)
        for h in (0, 1):
            for w, c in self._classes(seen[1 - h], words, 1).items():
                other[h, vocab[w]] = c
        some = [features(words[i : i + 4096]) for i in range(0, len(words), 4096)]
        flat, count = np.concatenate([x.astype(np.uint16) for x, _ in some]), np.concatenate([n for _, n in some])
        del some
        at = np.cumsum(count) - count
        seen_w, seen_t, seen_l = np.full(self.w.shape, 1e-6), np.full(self.t.shape, 1e-6), np.full(self.l.shape, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(runs))
            # a run is often followed by one of its own language, so that both staying and switching are seen
            same = {y: [j for j in order if gold_of[j] == y] for y in range(k)}
            chain, used = [], np.zeros(len(runs), bool)
            for j in order:
                if used[j]:
                    continue
                chain.append(j)
                used[j] = True
                pool = same[gold_of[j]]
                while rng.random() < 0.8:
                    while pool and used[pool[-1]]:
                        pool.pop()
                    if not pool:
                        break
                    used[pool[-1]] = True
                    chain.append(pool.pop())
            word = np.concatenate([runs[j] for j in chain])
            size = [len(runs[j]) for j in chain]
            gold = np.repeat([gold_of[j] for j in chain], size)
            lex = other[np.repeat([half[j] for j in chain], size), word]
            for a in range(0, len(word), 20_000):
                x, y, z = word[a : a + 20_000], gold[a : a + 20_000], lex[a : a + 20_000]
                u, inv = np.unique(x, return_inverse=True)
                idx = np.concatenate([flat[at[i] : at[i] + count[i]] for i in u])
                ends = np.cumsum(count[u]) - count[u]
                scores = (np.add.reduceat(self.w[idx], ends, axis=0) / np.sqrt(count[u])[:, None])[inv].astype(float) + self.l[z]
                starts = np.arange(0, len(x), SEQUENCE)
                post, f, b = forward_backward(scores, self.t, starts)
                err = -post
                err[np.arange(len(y)), y] += 1
                by_word = np.zeros((len(u), k))
                np.add.at(by_word, inv, err)
                grad = np.zeros(self.w.shape)
                np.add.at(grad, idx, np.repeat(by_word / np.sqrt(count[u])[:, None], count[u], axis=0))
                grad = grad / len(x) - DECAY * self.w
                seen_w += grad**2
                self.w += (RATE * grad / np.sqrt(seen_w)).astype(np.float32)
                grad = np.zeros(self.l.shape)
                np.add.at(grad, z, err)
                grad = grad / len(x) - DECAY * self.l
                seen_l += grad**2
                self.l += (RATE * grad / np.sqrt(seen_l)).astype(np.float32)
                inner = np.setdiff1d(np.arange(1, len(x)), starts)
                e = np.exp(scores - scores.max(axis=1, keepdims=True))
                pair = f[inner - 1][:, :, None] * np.exp(self.t)[None] * (e[inner] * b[inner])[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                gt = -pair.sum(axis=0)
                np.add.at(gt, (y[inner - 1], y[inner]), 1)
                gt /= len(x)
                seen_t += gt**2
                self.t += RATE * gt / np.sqrt(seen_t)
        return self

    def _ids(self, words: list[str]) -> np.ndarray:
        """Rows of the score table; scores of new words are computed together and remembered."""
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list(set(words))
            if len(known) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(known) + len(new), len(self.labels)), np.float32)])
            for i in range(0, len(new), 4096):
                flat, n = features(new[i : i + 4096])
                none = len(self.l) - 1
                s = np.add.reduceat(self.w[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None] + self.l[[self.lexicon.get(w, none) for w in new[i : i + 4096]]]
                self.table[len(known) : len(known) + len(n)] = s
                known.update(zip(new[i : i + 4096], range(len(known), len(known) + len(n)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """For each text its words and their label posteriors."""
        words = [words_of(t) for t in texts]
        flat = [w for x in words for w in x]
        if not flat or not self.labels:
            return [(w, np.zeros((len(w), len(self.labels)))) for w in words]
        size = np.array([len(w) for w in words])
        starts = (np.cumsum(size) - size)[size > 0]
        ids = self._ids(flat)
        post, _, _ = forward_backward(self.table[ids].astype(float), self.t, starts)
        return list(zip(words, np.split(post, np.cumsum(size)[:-1]), strict=True))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for w, p in self.label(texts):
            if not w or not self.labels:
                out.append((UNKNOWN, 0.0))
                continue
            share = np.fromiter(map(len, w), float, len(w)) @ p
            share /= share.sum()
            out.append((self.labels[int(share.argmax())], float(min(1.0, share.max()))))
        return out


def train(docs: DataFrame, each: int = TRAIN_EACH) -> Crf:
    """Fits on a bounded sample of labelled rows (text, lang): of each label the each rows whose doc_id hashes lowest, whole texts.

    Labels are all languages of labelled rows, however rare. Executors leave out rows whose hash is above twice the sample's share of their label's rows, so what
    reaches the driver depends on each and the number of labels and not on the rows. Should ids be repeated so often that too few rows are left, the share grows.
    No labelled row gives a model without labels, which predicts und.
    """
    rows = docs.where("lang is not null and text is not null").select(F.xxhash64("doc_id", F.lit(3)).alias("h"), "doc_id", F.col("lang").cast("string").alias("lang"), "text")
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each label
    share, found = {lang: min(1.0, 2 * each / m) for lang, m in n.items()}, []
    while share:
        most = F.create_map(*(F.lit(x) for lang, s in share.items() for x in (lang, min((1 << 63) - 1, int(s * (1 << 64)) - (1 << 63)))))
        low = rows.where(F.col("h") <= most[F.col("lang")])
        first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
        got = low.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each).select("lang", "nth", "text").collect()
        have = Counter(r.lang for r in got)
        done = {lang for lang in share if have[lang] >= min(each, n[lang]) or share[lang] >= 1}
        found += [r for r in got if r.lang in done]
        share = {lang: min(1.0, 4 * s) for lang, s in share.items() if lang not in done}
    found.sort(key=lambda r: (r.nth, r.lang))
    model = Crf(sorted(n)).fit([r.text for r in found], [r.lang for r in found])
    del found
    give_back()
    return model


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, lang_pred, score. Null or letter-free texts give und and 0; repeated rows and null keys give a row each; other columns are not read."""
    bare = model.copy()

    def run(batches):
        m = bare.copy()
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for i, j in pieces(texts, PIECE):
                got = m.predict(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Crf, least: float, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs, in their own columns, less the rows whose text has no letter or whose likeliest language has a share under least; lang is set to that language. Null texts go; repeated rows, shared and null ids are each judged; an empty table stays empty, a model without labels keeps nothing."""
    bare = model.copy()

    def run(batches):
        m = bare.copy()
        for b in slices(batches):
            at, to = b.schema.get_field_index(text), b.schema.get_field_index(lang)
            texts = [x or "" for x in b.column(at).to_pylist()]
            got = [g for i, j in pieces(texts, PIECE) for g in m.predict(texts[i:j])]
            b = b.set_column(to, b.schema.field(to), pa.array([g[0] for g in got], b.schema.field(to).type))
            yield b.filter(pa.array([g[0] != UNKNOWN and g[1] >= least for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
