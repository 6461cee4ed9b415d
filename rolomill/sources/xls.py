"""Old workbooks (.xls, BIFF8 in a compound file) to rows of text. A sheet has 65,536 rows of 256 cells at most, so a workbook is read as a whole."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: The compound file's mark, ends of sector chains, and numbers of records.
MARK, FREE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFA
BOUNDSHEET, SST, CONTINUE, LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR, BOF, EOF = 0x85, 0xFC, 0x3C, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x6, 0x207, 0x205, 0x809, 0xA


def _u16(b: bytes, at: int) -> int:
    return struct.unpack_from("<H", b, at)[0]


def _u32(b: bytes, at: int) -> int:
    return struct.unpack_from("<I", b, at)[0]


def stream(data: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """The stream of one of these names in a compound file."""
    if data[:8] != MARK:
        raise ValueError("not a compound file")
    size, small = 1 << _u16(data, 30), 1 << _u16(data, 32)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    tables, more = [x for x in struct.unpack_from("<109I", data, 76) if x < FREE], _u32(data, 68)
    for _ in range(_u32(data, 72)):
        own = struct.unpack(f"<{size // 4}I", sector(more))
        tables, more = tables + [x for x in own[:-1] if x < FREE], own[-1]
    fat = [x for t in tables for x in struct.unpack(f"<{size // 4}I", sector(t))]

    def chain(first: int, table: list[int], part, most: int) -> bytes:
        out, at = [], first
        while at < FREE:
            out.append(part(at))
            at = table[at]
            if len(out) > most:
                raise ValueError("a chain of sectors has no end")
        return b"".join(out)

    whole = lambda first: chain(first, fat, sector, len(fat))
    folder = whole(_u32(data, 48))
    entries = {}
    for at in range(0, len(folder) - 127, 128):
        n = _u16(folder, at + 64)
        if n >= 2:
            entries[folder[at : at + n - 2].decode("utf-16-le")] = (_u32(folder, at + 116), _u32(folder, at + 120), folder[at + 66])
    found = next((entries[x] for x in names if x in entries), None)
    if found is None:
        raise ValueError("no workbook in the compound file")
    first, length, _ = found
    if length >= _u32(data, 56):
        return whole(first)[:length]
    minis = whole(next(x for x in entries.values() if x[2] == 5)[0])
    table = whole(_u32(data, 60))
    short = list(struct.unpack(f"<{len(table) // 4}I", table))
    return chain(first, short, lambda i: minis[i * small : (i + 1) * small], len(short))[:length]


def records(book: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(book):
        kind, n = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + n]
        at += 4 + n


def _chars(part: bytes, at: int, n: int, wide: int) -> str:
    return part[at : at + 2 * n].decode("utf-16-le", "replace") if wide else part[at : at + n].decode("latin-1")


def shared(parts: list[bytes]) -> list[str]:
    """The shared strings of an SST record and its continuations. Characters may go on in the next part, behind a byte that tells their width anew."""
    out, p, at = [], 0, 8
    n = _u32(parts[0], 4)

    def skip(k: int) -> None:
        nonlocal p, at
        while k:
            if at == len(parts[p]):
                p, at = p + 1, 0
            step = min(k, len(parts[p]) - at)
            k, at = k - step, at + step

    while len(out) < n:
        if at >= len(parts[p]):
            p, at = p + 1, 0
        left, flags = _u16(parts[p], at), parts[p][at + 2]
        at += 3
        runs = extra = 0
        if flags & 8:
            runs, at = _u16(parts[p], at), at + 2
        if flags & 4:
            extra, at = _u32(parts[p], at), at + 4
        wide, text = flags & 1, ""
        while left:
            if at >= len(parts[p]):
                p, at = p + 1, 1
                wide = parts[p][0] & 1
            k = min(left, (len(parts[p]) - at) // (2 if wide else 1))
            text += _chars(parts[p], at, k, wide)
            left, at = left - k, at + k * (2 if wide else 1)
        out.append(text)
        skip(4 * runs + extra)
    return out


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _rk(v: int) -> str:
    x = float((v >> 2) - (1 << 30 if v & 1 << 31 else 0)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return _number(x / 100 if v & 1 else x)


def _cells(book: bytes, at: int, strings: list[str]) -> dict[int, dict[int, str]]:
    """Cells of the sheet that begins at a place of the stream, by row and column."""
    rows: dict[int, dict[int, str]] = {}
    waits = None
    depth = 0
    for kind, d in records(book, at):
        if kind == BOF:
            depth += 1
        elif kind == EOF:
            depth -= 1
            if not depth:
                break
        if depth > 1:  # charts within the sheet
            continue
        if kind == STRING and waits:
            rows.setdefault(waits[0], {})[waits[1]] = _chars(d, 3, _u16(d, 0), d[2] & 1)
            waits = None
        if kind not in (LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, BOOLERR):
            continue
        row, col = struct.unpack_from("<HH", d)
        values: list[str | None] = []
        if kind == LABELSST:
            values = [strings[_u32(d, 6)]]
        elif kind == LABEL:
            values = [_chars(d, 9, _u16(d, 6), d[8] & 1)]
        elif kind == NUMBER:
            values = [_number(struct.unpack_from("<d", d, 6)[0])]
        elif kind == RK:
            values = [_rk(_u32(d, 6))]
        elif kind == MULRK:
            values = [_rk(_u32(d, 6 + 6 * i)) for i in range((len(d) - 6) // 6)]
        elif kind == BOOLERR:
            values = [None if d[7] else str(d[6])]
        elif d[12:14] != b"\xff\xff":
            values = [_number(struct.unpack_from("<d", d, 6)[0])]
        elif d[6] == 0:
            waits = (row, col)
        elif d[6] == 1:
            values = [str(d[8])]
        for i, v in enumerate(values):
            if v is not None:
                rows.setdefault(row, {})[col + i] = v
    return rows


def sheets(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """(name, rows) of each worksheet; rows without cells are left out, cells that aren't there are null."""
    book = stream(data)
    found, parts, last = [], [], None
    for kind, d in records(book):
        if kind == BOF and _u16(d, 0) != 0x600:
            raise ValueError("a workbook before BIFF8; save it as .xlsx or .csv")
        if kind == BOUNDSHEET and d[5] == 0:
            found.append((_chars(d, 8, d[6], d[7] & 1), _u32(d, 0)))
        if kind == SST or (kind == CONTINUE and last == SST):
            parts.append(d)
            kind = SST
        last = kind
        if kind == EOF:
            break
    strings = shared(parts) if parts else []
    out = []
    for name, at in found:
        rows = _cells(book, at, strings)
        out.append((name, [[rows[r].get(c) for c in range(max(rows[r]) + 1)] for r in sorted(rows)]))
    return out
