"""Word shingles and MinHash in vectorised numpy.

Words are maximal runs of characters other than space and \\t to \\r, with A-Z lower-cased; all separators are ASCII, so the
UTF-8 bytes are cut as the characters would be. A shingle is five words in a row; a text of one to four words is one shingle as a whole.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)


def _seeded(n: int, seed: int) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh64_digest(f"{seed}:{i}") for i in range(n)), "<u8").copy()


_BYTE = _seeded(512, 1).reshape(2, 256) | np.uint64(1)
_STEP = _seeded(WORDS + 1, 2) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PI)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums (of one of two independent kinds) from which the hash of any span follows: mix((s[end] - s[start]) * inverse_power[start])."""
    p, _ = powers(len(raw) + 1)
    s = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[which][raw] * p[: len(raw)], out=s[1:])
    return s


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): shingle hashes of all texts in order, repeats kept, and how many each text has."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    at = np.cumsum([0] + [len(p) + 1 for p in parts])
    sep = _SEP[raw]
    edge = np.flatnonzero(np.diff(sep.view(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    s = span_hashes(_LOW[raw])
    words = mix((s[ends] - s[starts]) * _powers[1][starts])
    first = np.searchsorted(starts, at)
    n = np.diff(first)
    counts = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    out = np.empty(int(counts.sum()), np.uint64)
    long = np.repeat(n >= WORDS, counts)
    if len(words) >= WORDS:
        doc = np.repeat(np.arange(len(texts)), n)
        m = len(words) - WORDS + 1
        acc = words[:m] * _STEP[0]
        for k in range(1, WORDS):
            acc += words[k : m + k] * _STEP[k]
        out[long] = mix(acc[doc[:m] == doc[WORDS - 1 :]])
    for k, d in zip(np.flatnonzero(~long), np.flatnonzero((n > 0) & (n < WORDS)), strict=True):
        w = words[first[d] : first[d] + n[d]]
        out[k] = mix((w * _STEP[: len(w)]).sum(keepdims=True) + _STEP[WORDS:] * np.array([len(w)], np.uint64))[0]
    return out, counts


def sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, n = shingles(texts)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if len(n) else []


class MinHash:
    """n universal hash functions x -> (a x + b mod 2**64) >> 32 with odd a; a text's signature has the least value of each."""

    def __init__(self, n: int, seed: int = 7):
        self.n, self.a, self.b = n, _seeded(n, seed) | np.uint64(1), _seeded(n, seed + 1)

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Signatures as rows; a text without shingles has the largest value everywhere."""
        out = np.full((len(counts), self.n), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(counts)
        if len(full):
            at = (np.cumsum(counts) - counts)[full]
            step = 16384  # keeps the work in the CPU's cache
            cut = [0]
            while cut[-1] < len(full):
                cut.append(max(cut[-1] + 1, int(np.searchsorted(at, at[cut[-1]] + step, "right")) - 1))
            for i, j in zip(cut, cut[1:]):
                end = at[j] if j < len(full) else len(hashes)
                x, where = hashes[at[i] : end], at[i:j] - at[i]
                for k in range(self.n):
                    v = x * self.a[k]
                    v += self.b[k]
                    v >>= np.uint64(32)
                    out[full[i:j], k] = np.minimum.reduceat(v, where)
        return out


def short(sig: np.ndarray) -> np.ndarray:
    """The lower halves of signatures, 16 bits each, most significant byte first: the upper ones of minima over many shingles are all 0."""
    return (sig & np.uint32(0xFFFF)).astype(">u2")
