"""Workbooks (.xlsx) as a Python data source: a partition for each sheet, whose rows are read from the zipped XML one after another.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").load("/folder")

Files are listed and opened through Arrow's file systems (local, HDFS, S3, GCS). A sheet of any length takes the memory of a batch of rows and of the workbook's shared strings. Rows are
those of ROWS: a workbook that can't be read has one row with its error, sheets without cells have none.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "file string, sheet string, row_idx long, cells array<string>, error string"
#: Rows of a batch.
BATCH = 5000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])


def sheet_name(name: str) -> str:
    """Letters, digits, space, - and _ stay."""
    return "".join(c for c in name if c.isalnum() or c in " -_").rstrip()


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of each sheet."""
    to = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = [(s.get("name"), to[s.get(_REL)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(f"{_MAIN}sheets/{_MAIN}sheet")]
    return [(name, t if t.startswith("xl/") else f"xl/{t}") for name, t in found]


def _text(e) -> str:
    """A string's text, also of its formatted runs, without pronunciation aids."""
    return "".join(t.text or "" for part in (e, *e.iterfind(f"{_MAIN}r")) for t in part.iterfind(f"{_MAIN}t"))


def _closed(stream, tag: str) -> Iterator:
    """Elements of that tag as they close; each is dropped after use, so the tree doesn't grow."""
    path = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(e)
        else:
            path.pop()
            if e.tag == _MAIN + tag:
                yield e
                e.clear()
                if path:
                    path[-1].remove(e)


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as f:
        return [_text(s) for s in _closed(f, "si")]


def sheet_rows(z: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[list[str | None]]:
    """The cells of each row that has any, as text; cells that aren't there are null."""
    with z.open(member) as f:
        for r in _closed(f, "row"):
            row: list[str | None] = []
            for c in r.iterfind(f"{_MAIN}c"):
                at = 0
                for ch in re.match("[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(ch) - 64
                row += [None] * (at - 1 - len(row))
                v, kind = c.find(f"{_MAIN}v"), c.get("t")
                inline = c.find(f"{_MAIN}is")
                row.append(_text(inline) if inline is not None else None if v is None else shared[int(v.text)] if kind == "s" else v.text)
            if any(x is not None for x in row):
                yield row


def batches(file: str, sheet: str, rows: Iterator[list[str | None]]) -> Iterator[pa.RecordBatch]:
    at, part = 0, []
    for row in rows:
        part.append(row)
        if len(part) == BATCH:
            yield batch(file, sheet, at, part)
            at, part = at + BATCH, []
    if part:
        yield batch(file, sheet, at, part)


def batch(file: str, sheet: str, at: int, rows: list, error: str | None = None) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([sheet_name(sheet)] * n), pa.array(range(at, at + n), pa.int64()), pa.array(rows, pa.list_(pa.string())), pa.array([error] * n, pa.string())], schema=_ARROW)


def workbook_batches(file: str, stream) -> Iterator[pa.RecordBatch]:
    """All sheets of a workbook, one after another; for stores that only Spark reads."""
    with zipfile.ZipFile(stream) as z:
        shared = shared_strings(z)
        for name, member in sheets_of(z):
            yield from batches(file, name, sheet_rows(z, member, shared))


def workbook(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook with inline texts: the counterpart of the reader, for small books."""
    main, rel, pack = _MAIN[1:-1], _REL[1 : _REL.index("}")], "http://schemas.openxmlformats.org/package/2006/relationships"
    letter = lambda i: (letter(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for r, row in enumerate(rows, 1):
                    cells = "".join(f'<c r="{letter(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>' for k, x in enumerate(row) if x is not None)
                    f.write(f'<row r="{r}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI or local path; raises for those that Arrow doesn't know."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def listed(folder: str) -> list[tuple[str, str]]:
    """(path within the file system, name as Spark gives it) of workbooks below a folder, in order of paths."""
    files, at = opened(folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else "file:"
    found = files.get_file_info(fs.FileSelector(at, recursive=True)) if files.get_file_info(at).type == fs.FileType.Directory else [files.get_file_info(at)]
    return sorted((x.path, scheme + x.path) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".xlsx"))


class Sheet(InputPartition):
    def __init__(self, path: str, file: str, name: str, member: str | None, error: str | None = None):
        self.path, self.file, self.name, self.member, self.error = path, file, name, member, error


class WorkbookReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Sheet]:
        """A partition for each sheet; only the directory of each workbook is read here."""
        files, out = opened(self.folder)[0], []
        for path, file in listed(self.folder):
            try:
                with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    out += [Sheet(path, file, name, member) for name, member in sheets_of(z)]
            except Exception as e:  # whatever is wrong with the file, it is listed
                out.append(Sheet(path, file, "", None, f"{type(e).__name__}: {e}"))
        return out or [Sheet("", "", "", None)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        if partition.error:
            yield batch(partition.file, "", 0, [None], partition.error)
        elif partition.member:
            try:
                with opened(self.folder)[0].open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
                    yield from batches(partition.file, partition.name, sheet_rows(z, partition.member, shared_strings(z)))
            except (ElementTree.ParseError, zipfile.BadZipFile, ValueError, IndexError, KeyError) as e:
                yield batch(partition.file, partition.name, 0, [None], f"{type(e).__name__}: {e}")


class WorkbookSource(DataSource):
    """Option path: a folder, searched below too, or one file."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])
