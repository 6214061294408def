"""Files read as rows on the executors: workbooks by sheet, delimited tables, and texts of any encoding in pieces."""

from __future__ import annotations

import codecs
import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Bytes that tell an encoding, characters of a piece of text, of a block of rows and of a header in it,
# and the numbers of the built-in formats that show a date or time.
HEAD_BYTES, PIECE_CHARS, BLOCK_CHARS, HEADER_CHARS = 65_536, 2_000_000, 1_600, 800
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
# End of fixed values.

#: Rows given out together.
ROWS = 1_024
ROW_SCHEMA = "path string, sheet string, n long, cells array<string>"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def encoding_of(head: bytes, whole: bool) -> str:
    """The encoding of a text by its first bytes: by its mark, else UTF-8 where they are that (a character cut at the end aside), else Windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=whole)
    except UnicodeDecodeError:
        return "cp1252"
    return "utf-8"


def decoded(content: bytes) -> str:
    head = content[:HEAD_BYTES]
    return content.decode(encoding_of(head, len(head) == len(content)), errors="replace")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A text in pieces of about ``size`` characters that end at lines; a line of twice that is cut."""
    at = 0
    while len(text) - at > size:
        end = text.rfind("\n", at, at + size)
        if end <= at:
            end = text.find("\n", at + size, at + 2 * size)
        stop = end if end > at else min(at + 2 * size, len(text))
        yield text[at:stop]
        at = stop + 1 if end > at else stop
    if text[at:].strip():
        yield text[at:]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_texts(spark: SparkSession, path: str, size: int = PIECE_CHARS) -> DataFrame:
    """``path, piece, text`` of the text files at ``path``, whatever their encoding. Files are opened in the tasks that read them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for i, text in enumerate(pieces(decoded(content.as_py()), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int32()), pa.array([text])], ["path", "piece", "text"])

    return _files(spark, path).mapInArrow(run, "path string, piece int, text string")


def _date(value: float) -> str:
    return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(value * 86_400)))


class _Workbook:
    """The parts of a workbook's archive. Its shared texts and formats are held, its sheets are streamed."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        self.texts = [self._said(e) for e in self._each("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._dates() if "xl/styles.xml" in names else []
        links = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        parts = [(s.get("name"), links[s.get(_REL)]) for s in book.iter(f"{_NS}sheet")]
        self.sheets = [(name, p if p.startswith("xl/") else f"xl/{p}") for name, p in parts]

    def _each(self, part: str, tag: str) -> Iterator[ElementTree.Element]:
        """Elements of a part, one at a time: what has been read is dropped."""
        with self.zip.open(part) as f:
            events = ElementTree.iterparse(f, events=("start", "end"))
            _, root = next(events)
            for event, e in events:
                if event == "end" and e.tag == _NS + tag:
                    yield e
                    e.clear()
                    root.clear()

    @staticmethod
    def _said(e: ElementTree.Element) -> str:
        """The text of an element, without readings beside it."""
        aside = {id(t) for r in e.iter(f"{_NS}rPh") for t in r.iter(f"{_NS}t")}
        return "".join(t.text or "" for t in e.iter(f"{_NS}t") if id(t) not in aside)

    def _dates(self) -> list[bool]:
        """Which cell formats show dates."""
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        shown = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_NS}numFmt")}
        dated = lambda i: i in DATE_FORMATS or bool(re.search("[dmhysDMHYS]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", shown.get(i, ""))))
        formats = root.find(f"{_NS}cellXfs")
        return [dated(int(f.get("numFmtId", 0))) for f in formats] if formats is not None else []

    def _cell(self, c: ElementTree.Element) -> str | None:
        kind, value = c.get("t", "n"), c.findtext(f"{_NS}v")
        if kind == "inlineStr":
            return self._said(c)
        if value is None:
            return None
        if kind == "s":
            return self.texts[int(value)]
        if kind == "b":
            return str(value == "1")
        if kind != "n":
            return value
        style = int(c.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return _date(float(value))
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def rows(self, part: str) -> Iterator[list[str | None]]:
        """Cells of each row that is there, at their columns."""
        for row in self._each(part, "row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_NS}c"):
                letters = re.match("[A-Z]+", c.get("r", ""))
                column = 0
                for x in letters[0] if letters else "":
                    column = column * 26 + ord(x) - 64
                cells += [None] * (column - 1 - len(cells))
                cells.append(self._cell(c))
            yield cells


def _given(path: str, sheet: str, rows: Iterable[list[str | None]]) -> Iterator[pa.RecordBatch]:
    held: list[list[str | None]] = []
    n = 0

    def batch() -> pa.RecordBatch:
        size = len(held)
        return pa.RecordBatch.from_arrays([pa.array([path] * size), pa.array([sheet] * size, pa.string()), pa.array(range(n - size, n), pa.int64()), pa.array(held, pa.list_(pa.string()))], ["path", "sheet", "n", "cells"])

    for row in rows:
        held.append(row)
        n += 1
        if len(held) == ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, n, cells`` of every row of every sheet of the workbooks at ``path``: cells as text, dates by their formats.

    Rows are given out in bounded batches while a sheet is read. A file that is no workbook, or is
    broken, gives one row without a sheet or cells where it breaks, so it is seen and fails nothing.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    book = _Workbook(content.as_py())
                    for sheet, part in book.sheets:
                        yield from _given(name, sheet, book.rows(part))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.string()))], ["path", "sheet", "n", "cells"])

    return _files(spark, path).mapInArrow(run, ROW_SCHEMA)


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``path, sheet, n, cells`` of the rows of delimited files, of any encoding, as ``read_workbooks`` gives them (``sheet`` is null)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from _given(name, None, csv.reader(io.StringIO(decoded(content.as_py()), newline=""), delimiter=sep))

    return _files(spark, path).mapInArrow(run, ROW_SCHEMA)


def table_blocks(rows: DataFrame, size: int = BLOCK_CHARS, head: int = HEADER_CHARS) -> DataFrame:
    """``path, heading, block, text``: the rows of each table as lines ``a | b`` without empty cells, in blocks under the header.

    ``rows(path, sheet, n, cells)``; the first row with a cell is the header, of at most ``head``
    characters, and alone a block where nothing follows. The heading is ``Sheet:`` and the
    sheet's name, or the file's name. Rows pass through in order, with the block in hand as the
    only state; a line longer than a block is cut to it.
    """
    heading = F.when(F.col("sheet").isNotNull(), F.concat(F.lit("Sheet: "), "sheet")).otherwise(F.regexp_extract("path", r"([^/]*)$", 1))
    line = F.array_join(F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != ""), " | ")
    lines = rows.filter("cells is not null").select("path", heading.alias("heading"), "n", line.alias("line")).filter("line <> ''")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, header, block, held, used = None, "", 0, [], 0

        def done() -> tuple:
            return (*here, block, "\n".join([header, *held]))

        for pdf in batches:
            out = []
            for path, name, text in zip(pdf["path"].tolist(), pdf["heading"].tolist(), pdf["line"].tolist(), strict=True):
                if (path, name) != here:
                    if here and (held or not block):
                        out.append(done())
                    here, header, block, held, used = (path, name), text[:head], 0, [], len(text[:head])
                    continue
                text = text[:size]
                if held and used + len(text) + 1 > size:
                    out.append(done())
                    block, held, used = block + 1, [], len(header)
                held.append(text)
                used += len(text) + 1
            yield pd.DataFrame(out, columns=["path", "heading", "block", "text"])
        if here and (held or not block):
            yield pd.DataFrame([done()], columns=["path", "heading", "block", "text"])

    dealt = lines.repartition("path", "heading").sortWithinPartitions("path", "heading", "n")
    return dealt.mapInPandas(pack, "path string, heading string, block int, text string")
