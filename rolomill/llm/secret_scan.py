"""Secret scan: an Aho-Corasick keyword prefilter, anchored regular expressions near its hits only, then checks and embedded checksums.

Texts are scanned as UTF-8 bytes (read as Latin-1, so that one character is one byte); offsets of the few spans found are turned into code points.
The prefilter finds the keywords of all kinds in one pass over the lower-cased bytes; the expression of a kind is only tried at the start of a hit.
Hex runs have no keyword: a run of 24 covers two neighbours of every twelfth byte, so pairs of hex digits on that grid are their anchors.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

#: Base kinds as listed by the contract, then the kinds that embed a checksum.
KINDS = ["assign", "access", "hex", "github", "npm", "card", "iban", "xprv", "jwt"]
BASE = 3
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
GITHUB_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")  # on lower-cased bytes
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CHECKED = re.compile(r"(gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
CARD_WORDS, IBAN_WORDS = ["card", "visa", "amex"], ["iban"]
_CARD = re.compile(r"[a-z]{4,6}[^0-9a-z]{0,3}(?:(?:no|nr|num|number)\b)?[^0-9a-z]{0,3}([2-6][0-9]*(?:[\x20-][0-9]+)*)(?![0-9a-z])")  # on lower-cased bytes, as the next one
_IBAN = re.compile(r"iban[^0-9a-z]{0,3}([a-z]{2}[0-9]{2}(?:[a-z0-9]{11,30}|(?:\x20[a-z0-9]{4}){2,7}(?:\x20[a-z0-9]{1,3})?))")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_GRID = re.compile(r"[0-9a-f]{2,}")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_words: list = []


def _prefilter():
    if not _words:
        a = ahocorasick.Automaton()
        for w in ASSIGN_WORDS:
            a.add_word(w, (0, len(w)))
        a.add_word("akia", (1, 4))
        for w in [*GITHUB_WORDS, "npm_"]:
            a.add_word(w, (3, 4))
        for words, kind in ((CARD_WORDS, 5), (IBAN_WORDS, 6), (["xprv"], 7), (["eyj"], 8)):
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _words.append(a)
    return _words[0]


def checksum(secret: str) -> str:
    """The last six characters of a checked token: CRC-32 of the 30 before them, in base 62."""
    n, out = binascii.crc32(secret.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.rjust(6, "0")


def luhn(digits: str) -> bool:
    """Whether the last digit of a payment card's number is right: every second one from the right doubled, the digits' sum a multiple of 10."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number's check digits are right: the first four characters put last, letters as 10 to 35, 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def base58check(key: str) -> bool:
    """Whether the last four bytes are the double SHA-256 of those before."""
    n = 0
    for c in key:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes(-(-n.bit_length() // 8), "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def signed_header(part: str) -> bool:
    """Whether the first part of a web token is a JSON object that names its algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _checked(kind: int, raw: str, low: str, at: int) -> tuple[int, int] | None:
    """The span of a card, account number, key or web token whose keyword stands at at, if its check holds."""
    if kind == 5:
        m = _CARD.match(low, at)
        digits = re.sub("[^0-9]", "", m[1]) if m else ""
        return m.span(1) if 13 <= len(digits) <= 19 and luhn(digits) else None
    if kind == 6:
        if m := _IBAN.match(low, at):
            for end in range(m.end(1), m.start(1) + 14, -1):  # the longest that holds: words may follow
                number = low[m.start(1) : end].replace(" ", "")
                if low[end - 1] != " " and not low[end : end + 1].isalnum() and len(number) >= 15 and mod97(number):
                    return m.start(1), end
        return None
    if at and raw[at - 1].isascii() and raw[at - 1].isalnum():
        return None
    m = (_XPRV if kind == 7 else _JWT).match(raw, at)
    return m.span() if m and (base58check(m[0]) if kind == 7 else signed_header(m[1])) else None


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) of all spans in code points, by start, then kind. Spans of one kind don't overlap."""
    data = text.encode("utf-8", "surrogatepass")
    raw, low = data.decode("latin-1"), data.lower().decode("latin-1")
    found, free = [], [0] * len(KINDS)
    for last, (kind, n) in sorted(_prefilter().iter(low), key=lambda h: h[0] - h[1][1]):
        at = last - n + 1
        if kind == 3:
            m = _CHECKED.match(raw, at)
            if m and not (at and raw[at - 1].isalnum() and raw[at - 1].isascii()) and checksum(m[2]) == m[3]:
                found.append((at, m.end(), KINDS.index("npm" if m[1] == "npm" else "github")))
        elif kind > 3:
            if at >= free[kind] and (span := _checked(kind, raw, low, at)):
                free[kind] = span[1]
                found.append((*span, kind))
        elif at >= free[kind]:
            if m := (_ACCESS.match(raw, at) if kind else _ASSIGN.match(low, at)):
                free[kind] = m.end()
                if len(m[0]) >= 20 if kind else len(m[2]) >= 6:
                    found.append((at, m.end(), kind))
    done = 0
    for g in _GRID.finditer(raw[11::12]):
        for at in range(11 + 12 * g.start(), 11 + 12 * g.end(), 12):  # neighbours on the grid may belong to different runs
            if at >= done:
                start = at
                while start and raw[start - 1] in "0123456789abcdef":
                    start -= 1
                done = _HEX.match(raw, at).end()
                if done - start >= 24:
                    found.append((start, done, 2))
    if found and len(data) != len(text):
        marks = sorted({x for s in found for x in s[:2]})
        place, chars, at = {}, 0, 0
        for x in marks:
            chars += len(data[at:x].decode("utf-8", "surrogatepass"))
            place[x], at = chars, x
        found = [(place[a], place[b], k) for a, b, k in found]
    return sorted(found, key=lambda s: (s[0], s[2]))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, overlapping ones joined, replaced by [kind]."""
    out, at = [], 0
    for a, b, k in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k]}]"]
            at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_assign, n_access, n_hex, base_sha256, spans, n_checked.

    Spans are kind:start:end, comma-joined by start, then kind. Null counts as the empty text; repeated rows and null keys give a row each; other columns are not read.
    """

    def run(batches):
        for b in slices(batches):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for t in b.column(1).to_pylist():
                s = find(t)
                say = lambda x: ",".join(f"{KINDS[k]}:{a}:{e}" for a, e, k in x)
                n = [sum(1 for x in s if x[2] == k) for k in range(BASE)]
                for c, x in zip(cols, (*n, hashlib.sha256(say([x for x in s if x[2] < BASE]).encode()).hexdigest(), say(s), len(s) - sum(n)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if i in (3, 4) else pa.int64()) for i, c in enumerate(cols))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with secrets in the text replaced by [kind] and n_chars, if there is such a column, set anew; null texts and all other columns stay as they are."""

    def run(batches):
        for b in slices(batches):
            i = b.schema.get_field_index(text)
            out = [t if t is None else redacted(t, find(t)) for t in b.column(i).to_pylist()]
            b = b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))
            if (k := b.schema.get_field_index(n_chars)) >= 0:
                was = b.column(k).to_pylist()
                b = b.set_column(k, b.schema.field(k), pa.array([w if t is None else len(t) for t, w in zip(out, was, strict=True)], b.schema.field(k).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
