"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

A merge list has a sufficient lookahead L: the token boundaries in a prefix of the input can't depend on bytes more than L after them, nor on anything
behind the end of a pre-token. The transducer takes pre-tokens as they come. Its state is the bytes of the current one that are not emitted yet, at most a window of 2 L and
what is being fed; a step encodes the window by the merge list and emits the tokens that are stable: all if the pre-token ends with the window, else those that end L bytes or more
before the window's end. It goes on from the last emitted boundary (any run of tokens of an encoding is itself the encoding of its bytes). All pre-tokens
take these steps. Steps that ended a pre-token in one window are remembered in a table of fixed size. Memory stays constant, however long a text or a pre-token is.

The decoder is a state machine over bytes: it keeps the up to three bytes of an unfinished UTF-8 character and emits text as soon as it is sure.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

#: Steps remembered by each worker (in two halves, the older of which goes when the younger is full).
REMEMBER = 1 << 18
#: Characters of a text that are cut into pre-tokens at once.
SLICE = 1 << 16


@cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: a byte's own Latin-1 character if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def pretoken_pattern() -> re.Pattern:
    """Fixed value: the public byte-level pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ in terms of re's classes.

    Used for slices that hold odd characters only (see ODD); re has no \\p; its \\w is letters, numbers and _, so letters are \\w less _ and the numbers, which are listed as ranges made from the Unicode data.
    """
    nums = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "N"]  # a long class is slow
    runs: list[list[int]] = []
    for i in nums:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    n = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    s = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[^\\W_{n}]+| ?[{n}]+| ?(?:[^\\w{s}]|_)+|[{s}]+(?![^{s}])|[{s}]+")


@cache
def odd() -> frozenset[str]:
    """Characters for which re's own \\d and \\s aren't \\p{N} and the pattern's \\s."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No") or "\x1c" <= c <= "\x1f")


#: The same pattern by re's own classes, for slices without odd characters.
_SIMPLE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


class Vocabulary:
    """Merge list, ids and special tokens of a tokenizer file (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are read")
        letters = byte_letters()
        plain = lambda t: bytes(letters[c] for c in t)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {plain(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[plain(a), plain(b)] = k
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        #: Ranks of pairs of ids, and the id that each rank makes.
        self.pairs = {self.ids[a] << 32 | self.ids[b]: k for (a, b), k in self.rank.items()}
        self.made, self.no = [self.ids[a + b] for a, b in self.rank], len(self.rank)
        self.said = {i: f"{i}," for i in [*self.ids.values(), *self.special.values()]}
        self.text = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @property
    def lookahead(self) -> int:
        """A sufficient lookahead in bytes.

        Whether a rule (u, v) applies depends on text after v only if that text takes away v or one of the tokens at v's right end (v, its last
        part, that part's last part, ...) by a rule of an earlier rank that has it on the left. So with reach(rule) = |u v| + the largest reach of
        such earlier rules, processed in rank order, the longest chain of rules bounds how far ahead a boundary can depend on the text.
        """
        if not hasattr(self, "_lookahead"):
            last = {a + b: b for (a, b) in self.rank}
            reach: dict[bytes, int] = {}
            most = max(map(len, self.ids))
            for (u, v), _ in sorted(self.rank.items(), key=lambda x: x[1]):
                far, t = 0, v
                while t:
                    far = max(far, reach.get(t, 0))
                    t = last.get(t, b"")
                far += len(u) + len(v)
                reach[u] = max(reach.get(u, 0), far)
                most = max(most, far)
            self._lookahead = most
        return self._lookahead

    def merge(self, data: bytes) -> list[int]:
        """The ids of a pre-token: the lowest-ranked pair merges first, the leftmost of equals."""
        parts = [*map(self.byte_id.__getitem__, data)]
        if len(parts) > 48:
            return self._merge_long(parts)
        rank, made, no = self.pairs.get, self.made, self.no
        ranks = [rank(a << 32 | b, no) for a, b in zip(parts, parts[1:])]
        while ranks and (k := min(ranks)) != no:
            i = ranks.index(k)
            parts[i] = x = made[k]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | x, no)
            if i < len(ranks):
                ranks[i] = rank(x << 32 | parts[i + 1], no)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank = self.pairs.get
        heap = [(k, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (k := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[k], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (k := rank(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (k, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]


class Steps(dict):
    """Pre-tokens of one window to their values; what isn't remembered is found by the transducer."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.transducer.whole(word)
        if 2 * len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class Transducer:
    """Streams pre-tokens into values, made by pack(ids) of the ids that become stable together.

    feed() takes bytes of the current pre-token and gives the ids that are stable by then, end() the rest. steps counts the windows that were
    encoded, early the tokens that were emitted before their pre-token's end, most the largest window in bytes.
    """

    def __init__(self, v: Vocabulary, pack=tuple):
        self.v, self.pack, self.rest, self.window = v, pack, b"", 2 * v.lookahead
        self.steps = self.early = self.most = 0
        self.known = Steps(self)

    def step(self, last: bool) -> list[int]:
        """Encodes the window; the stable ids go, the bytes of the others stay."""
        self.steps += 1
        self.most = max(self.most, len(self.rest))
        ids = self.v.merge(self.rest)
        if last:
            self.rest = b""
            return ids
        size, end, n, sure = self.v.text, 0, 0, len(self.rest) - self.v.lookahead
        for i in ids:
            if end + len(size[i]) > sure:
                break
            end += len(size[i])
            n += 1
        self.rest = self.rest[end:]
        self.early += n
        return ids[:n]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.rest += data[at : at + self.window]
            if len(self.rest) > self.window:
                out += self.step(False)
        return out

    def end(self) -> list[int]:
        return self.step(True)

    def whole(self, word: str):
        """The value of a pre-token that fits one window."""
        return self.pack(self.feed(word.encode("utf-8", "surrogatepass")) + self.end())

    def values(self, words: list[str]) -> Iterator[list]:
        """The values of pre-tokens, in parts: those that fit a window by the remembered steps, others window by window as they become stable."""
        fits = self.window // 4  # characters whose bytes fit in any case
        if max(map(len, words), default=0) <= fits:
            yield [*map(self.known.__getitem__, words)]
            return
        for w in words:
            if len(w) <= fits:
                yield [self.known[w]]
            else:
                for i in range(0, len(w), fits):
                    if ids := self.feed(w[i : i + fits].encode("utf-8", "surrogatepass")):
                        yield [self.pack(ids)]
                yield [self.pack(self.end())]


class Encoder:
    """Encodes texts: cuts them into pre-tokens slice by slice and sends all of these through one transducer."""

    def __init__(self, v: Vocabulary, pack=tuple):
        self.v, self.pack, self.find, self.transducer = v, pack, pretoken_pattern(), Transducer(v, pack)

    def _plain(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens slice by slice. Slices end where white space follows another character: a boundary of pre-tokens whatever comes next."""
        at, n = 0, len(text)
        while at < n:
            end = n
            if n - at > SLICE:
                m = _BREAK.search(text, at + SLICE)
                end = m.start() + 1 if m else n
            if end - at > 4 * SLICE:  # no break for long: one match at a time
                found = (m[0] for m in self.find.finditer(text, at, n))
                while some := list(islice(found, 4096)):
                    yield some
                return
            part = text if end - at == n else text[at:end]
            yield (_SIMPLE if part.isascii() and not _CONTROL.search(part) or odd().isdisjoint(part) else self.find).findall(part)
            at = end

    def encode(self, text: str) -> Iterator[list]:
        """Parts of the text's values, in order; special tokens are found before all else."""
        at = 0
        if self.v.special_pattern is not None:
            for m in self.v.special_pattern.finditer(text):
                for x in self._plain(text[at : m.start()]):
                    yield from self.transducer.values(x)
                yield [self.pack([self.v.special[m[0]]])]
                at = m.end()
        for x in self._plain(text[at:] if at else text):
            yield from self.transducer.values(x)


_CONTROL = re.compile("[\x1c-\x1f]")
_BREAK = re.compile(r"\S(?=[ \n\t\r])")


class Decoder:
    """Ids to text, incrementally; bytes that aren't UTF-8 become U+FFFD, as the tokenizers library has it."""

    def __init__(self, v: Vocabulary):
        self.v, self.state = v, codecs.getincrementaldecoder("utf-8")("replace")

    def put(self, raw: bytes) -> str:
        """The text that is sure after these bytes of tokens."""
        return self.state.decode(raw)

    def feed(self, ids: Iterable[int]) -> str:
        text = self.v.text
        return self.put(b"".join([text[i] for i in ids if i in text]))

    def end(self) -> str:
        return self.state.decode(b"", True)


_made: dict = {}


def encoder(path: str, pack) -> Encoder:
    """One encoder for each worker process, vocabulary file and form of the values."""
    if (path, pack) not in _made:
        v = _made.get(path) or _made.setdefault(path, Vocabulary(path))
        _made[path, pack] = Encoder(v, pack)
    return _made[path, pack]


def encode_ids(path: str, text: str) -> list[int]:
    return [i for part in encoder(path, tuple).encode(text) for ids in part for i in ids]


def decode_ids(path: str, ids: list[int]) -> str:
    d = Decoder(encoder(path, tuple).v)
    return "".join([d.feed(ids[i : i + 4096]) for i in range(0, len(ids), 4096)]) + d.end()


class _Digest:
    """A pre-token's part of the digests: its ids in decimal, each with a comma after it, their number and their bytes."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, ids):
        v = _made[self.path]
        return ("".join([v.said[i] for i in ids]), len(ids), b"".join([v.text[i] for i in ids]))

    def __hash__(self):
        return hash(self.path)

    def __eq__(self, other):
        return isinstance(other, _Digest) and other.path == self.path


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_tokens, ids_sha256, decoded_sha256.

    The digests are taken slice by slice while the transducer emits ids and the decoder's state machine turns their bytes into text. Null counts as
    the empty text (no ids); repeated rows and null keys give a row each; other columns are not read.
    """

    def run(batches):
        e = encoder(path, _Digest(path))
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            counts, ids_sha, text_sha = [], [], []
            for t in texts:
                ids_part, text_part, n, held, decoder = hashlib.sha256(), hashlib.sha256(), 0, "", Decoder(e.v)
                for part in e.encode(t):
                    if part:
                        s, k, raw = zip(*part, strict=True)
                        now = held + "".join(s)
                        n += sum(k)
                        ids_part.update(now[:-1].encode())
                        held = now[-1:]  # the comma after the last id is only written if another follows
                        text_part.update(decoder.put(b"".join(raw)).encode())
                text_part.update(decoder.end().encode())
                counts.append(n)
                ids_sha.append(ids_part.hexdigest())
                text_sha.append(text_part.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
