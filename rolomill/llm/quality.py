"""Quality by nearest-neighbour voting: labelled documents as latent-semantic vectors, exact cosine products of every document with all of them, votes weighted by similarity.

1. A document's terms are hashed words, shapes of words (letters by case and class, other characters as they are, repeats once) and classes of a few figures of its form (repeated words
   and lines, shares of letters and capitals, lengths). Words, shapes and form are scaled to length 1 each.
2. Document frequencies of terms are counted over all documents; there is a number for each term of the fixed table.
3. The labelled sample (TRAIN_EACH documents of each label at most) becomes a term matrix, whose leading singular vectors map terms to RANK latent dimensions.
4. The map and the sample's vectors are broadcast: both have a fixed size. Blocks of documents are projected and multiplied with all sample vectors; the NEIGHBOURS nearest vote.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pieces, slices, stage, text_of, unstage
from .shingles import mix, powers, span_hashes

#: Labelled documents of each label that are learned from; latent dimensions; neighbours that vote.
TRAIN_EACH, RANK, NEIGHBOURS = 1000, 64, 25
#: Terms: hashed words, hashed shapes, classes of each figure of a document's form.
WORDS, SHAPES, FIGURES, CLASSES = 8192, 2048, 7, 16
TERMS = WORDS + SHAPES + FIGURES * CLASSES
_PART = np.repeat([0, 1, 2], [WORDS, SHAPES, FIGURES * CLASSES])
#: Bytes of a text that are measured at a time; a longer text is cut behind its lines, or words, or anywhere.
BLOCK = 1 << 20
_SPACE, _ALNUM, _LETTER, _UPPER = (np.zeros(256, bool) for _ in range(4))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ALNUM[48:58] = True
_ALNUM |= _LETTER
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Of a shape: A for capitals of ASCII, a for other letters (all bytes beyond ASCII count as such), 0 for digits, the rest as it is.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _hashes(raw: np.ndarray, keep: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the kept bytes of each span, whether there are any)."""
    pos = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=pos[1:])
    s = span_hashes(raw[keep])
    a, b = pos[starts], pos[ends]
    return mix((s[b] - s[a]) * powers(len(s))[1][a]), a < b


def _cut(text: bytes) -> list[bytes]:
    out, at = [], 0
    while len(text) - at > BLOCK:
        end = text.rfind(b"\n", at + 1, at + BLOCK)
        end = end if end > 0 else text.rfind(b" ", at + 1, at + BLOCK)
        end = end + 1 if end > 0 else at + BLOCK
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _measured(parts: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of parts of documents doc: (terms, their counts), distinct tokens, lines and their counts, as keys with the document before them; sums per document of tokens, repeats of the token before, letters, capitals and bytes."""
    n = int(doc[-1]) + 1
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    at = np.cumsum([0] + [len(p) + 1 for p in parts])
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    of = doc[np.searchsorted(at, starts, "right") - 1]
    whole, _ = _hashes(raw, ~space, starts, ends)
    word, some = _hashes(_LOW[raw], _ALNUM[raw], starts, ends)
    shape = _SHAPE[raw]
    fresh = np.ones(len(raw), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[starts] = True
    shape, _ = _hashes(shape, fresh & ~space, starts, ends)
    terms = np.concatenate([np.where(some, word, whole) % np.uint64(WORDS), np.uint64(WORDS) + shape % np.uint64(SHAPES)]).astype(np.int64) + np.tile(of * TERMS, 2)
    key = lambda d, h: (d.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    line_ends = np.flatnonzero(raw == 10)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    lines, _ = _hashes(raw, np.ones(len(raw), bool), line_starts, line_ends)
    line_of = doc[np.searchsorted(at, line_starts, "right") - 1]
    again = (whole[1:] == whole[:-1]) & (of[1:] == of[:-1])
    within = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[ends] - c[starts]
    sums = [np.bincount(of, None, n), np.bincount(of[1:][again], None, n), *(np.bincount(of, x, n).astype(np.int64) for x in (within(_LETTER[raw]), within(_UPPER[raw]), ends - starts))]
    return *np.unique(terms, return_counts=True), np.unique(key(of, whole)), np.unique(key(line_of, lines)), np.bincount(line_of, None, n), *sums


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of whole texts, in order of documents and terms; each has the terms of its form, an empty one no others."""
    cut = [_cut(t.encode("utf-8", "surrogatepass")) for t in texts]
    n, got = len(texts), []
    parts, doc = [p for c in cut for p in c], np.repeat(np.arange(n), [len(c) for c in cut])
    for i, j in pieces(parts, BLOCK):
        got.append(_measured(parts[i:j], doc[i:j]))
    term, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([g[1] for g in got]))
    per = lambda keys: np.bincount((np.unique(np.concatenate(keys)) >> np.uint64(44)).astype(np.int64), None, n)
    total = lambda k: sum(np.pad(g[k], (0, n - len(g[k]))) for g in got)
    tokens, lines = per([g[2] for g in got]), per([g[3] for g in got])
    n_lines, n_tokens, again, letters, capitals, size = (total(k) for k in range(4, 10))
    log = lambda x: np.log2(1 + x).astype(np.int64)
    part = lambda x, y: np.ceil((CLASSES - 1) * x / np.maximum(y, 1)).astype(np.int64)
    figures = [log(n_tokens), part(n_tokens - tokens, n_tokens), part(again, n_tokens), part(letters, size), part(capitals, letters), log(size / np.maximum(n_tokens, 1)), part(n_lines - lines, n_lines)]
    form = np.concatenate([np.arange(n) * TERMS + WORDS + SHAPES + i * CLASSES + np.minimum(x, CLASSES - 1) for i, x in enumerate(figures)])
    term, count = np.concatenate([term, form]), np.concatenate([count, np.ones(len(form))])
    order = np.argsort(term, kind="stable")
    return term[order] // TERMS, term[order] % TERMS, count[order].astype(np.float32)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(documents, documents with each term); TERMS numbers, whatever the rows."""

    def run(batches):
        df = np.zeros(TERMS + 1, np.int64)
        for b in slices(batches):
            texts = b.column(0).to_pylist()
            for i, j in pieces(texts):
                df[:TERMS] += np.bincount(terms_of(texts[i:j])[1], None, TERMS)
            df[TERMS] += len(texts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for r in docs.select(text_of(docs, text).alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return int(out[TERMS]), out[:TERMS]


def weights(doc: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln count) idf of each term; the words, shapes and form of a document are scaled to length 1 each."""
    w = (1 + np.log(count)) * idf[term]
    part = doc * 3 + _PART[term]
    return (w / np.sqrt(np.bincount(part, w * w))[part]).astype(np.float32)


@dataclass
class Voters:
    """idf and the map of terms, the sample's vectors (unit length) and their labels."""

    idf: np.ndarray
    latent: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """Shares of label 1 among the neighbours' votes. Neighbours are the NEIGHBOURS most similar ones and all as similar as the last; a vote counts as much as its similarity."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        doc, term, count = terms_of(texts)
        p = np.add.reduceat(weights(doc, term, count, self.idf)[:, None] * self.latent[term], np.searchsorted(doc, np.arange(len(texts))), axis=0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        cosine = np.round(p @ self.vectors.T, 5)
        k = min(NEIGHBOURS, len(self.labels))
        last = np.partition(cosine, -k, axis=1)[:, -k]
        vote = np.where(cosine >= last[:, None], np.maximum(cosine, 0), 0).astype(float)
        total = vote.sum(axis=1)
        return np.where(total > 0, vote @ self.labels / np.maximum(total, 1e-12), self.labels.mean())


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str) -> DataFrame:
    """docs with a column y of 0 and 1; a document that is labelled more than once has its smallest label, null keys and labels none."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("labelled_key")).agg(F.min(F.col(label).cast("int")).alias("y"))
    return docs.join(own, docs[key] == own["labelled_key"]).where("y in (0, 1)")


def train(docs: DataFrame, labels: DataFrame, statistics: DataFrame, label: str = "quality", each: int = TRAIN_EACH, rank: int = RANK, key: str = "doc_id", text: str = "text") -> Voters:
    """Learns from the labelled rows of docs: of each label the each keys whose hash is lowest, whole texts. statistics: the documents whose terms are counted.

    Only term numbers and counts of the sample reach the driver: at most 2 * each rows of at most TERMS terms. Of rows that share a key one is taken. Without labelled rows the model
    scores 0.5.
    """
    n, df = document_frequencies(statistics, text)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    src = docs.select(F.col(key).alias("k"), text_of(docs, text).alias("text"))
    ids = stage(labelled(docs.select(key), labels, label, key).select(F.col(key).alias("k"), "y", F.xxhash64(F.col(key), F.lit(5)).alias("h")).distinct())
    chosen = ids.where("y = 0").orderBy("h", "k").limit(each).unionAll(ids.where("y = 1").orderBy("h", "k").limit(each))
    chosen = stage(chosen)

    def run(batches):
        for b in slices(batches, 100):
            texts = b.column(2).to_pylist()
            for i, j in pieces(texts):
                doc, term, count = terms_of(texts[i:j])
                at = np.searchsorted(doc, np.arange(1, j - i))
                cols = [pa.array([x.tobytes() for x in np.split(c, at)], pa.binary()) for c in (term.astype(np.int32), count)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *cols], ["h", "y", "ids", "counts"])

    rows = src.join(F.broadcast(chosen), "k").select("h", "y", "text").mapInArrow(run, "h long, y int, ids binary, counts binary")
    rows = rows.groupBy("h").agg(F.min(F.struct("y", "ids", "counts")).alias("r")).select("h", "r.*").collect()
    unstage(ids, chosen)
    rows.sort(key=lambda r: r.h)
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        at = np.frombuffer(r.ids, np.int32)
        x[i, at] = weights(np.zeros(len(at), np.int64), at, np.frombuffer(r.counts, np.float32), idf)
    y = np.array([r.y for r in rows], float)
    del rows
    values, left = np.linalg.eigh((x @ x.T).astype(float))
    keep = [i for i in range(len(y) - 1, max(-1, len(y) - 1 - rank), -1) if values[i] > 1e-6]
    left = (left[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    latent = np.ascontiguousarray(x.T @ left)
    vectors = x @ latent
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    del x, left
    give_back()
    return Voters(idf, latent, vectors, y)


def classify(docs: DataFrame, model: Voters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), predicted (1 from 0.5 on). Null texts count as empty, which have a form to compare; repeated rows and null keys give a row each; other columns are not read."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = model_.value
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for i, j in pieces(texts):
                s = np.clip(m.score(texts[i:j]), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
