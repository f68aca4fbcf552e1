"""Workbooks (``.xlsx``, or ``.zip`` holding ``.xlsx``) -> sheet rows.

Spark reads the files in splits, whatever store they are in, and no task holds a
file in memory: one task per workbook puts the bytes in order in a temporary file,
opens it as a zip and cuts the sheets into pieces of whole rows without parsing
them.  The pieces, compressed and dealt over all tasks, become rows
``(source_file = {stem}_{sheet}, sheet, row_ordinal, cells)`` with row 0 the first
sheet row (the header).  The reader is a small helper over the Office Open XML
parts (shared strings, workbook, worksheets) using the standard library; it reads
cached cell values, never formulas.

Cell text follows the sheet-to-CSV step: empty -> '', CR removed, LF -> <br>;
integral numbers print without a decimal part, booleans as True/False, cells
with a date format as the date (``2016-04-01 00:00:00``).  Phonetic readings
(furigana) are not part of a cell's text.

Rows carry the workbook's file name.  When several sources hold the same sheet
file, all zips come before all loose workbooks, so a loose workbook wins over any
zipped one; among zips the last name wins, and within a zip the later member.

A source that cannot be read stops the job, as do errors in later stages; with
``on_error="skip"`` its rows are left out, the others stay, and ``failed_sources``
lists it.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import pyexpat
import re
import shutil
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import BinaryIO
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetwise.session import join_per_file, stored
from sheetwise.sources.sheets import SHEET_ROWS_SCHEMA, list_files

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"([A-Z]+)([0-9]+)")


@lru_cache(maxsize=20000)
def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    """Own text and rich-text runs; phonetic runs (rPh) are left out."""
    return "".join(t.text or "" for t in el.findall("m:t", _NS) + el.findall("m:r/m:t", _NS))


# Built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}


def _is_date_format(code: str) -> bool:
    """A custom format with day, month, year or hour letters outside quotes and brackets."""
    plain = re.sub(r'"[^"]*"|\\[^"]|\[[^\]]*\]|_.|\*.', "", code)
    return bool(re.search("[ymdhs]", plain, re.I)) and not re.search("general", plain, re.I)


def _date_styles(styles: bytes | None) -> set[int]:
    """Cell style numbers whose number format is a date or time."""
    if styles is None:
        return set()
    root = ET.fromstring(styles)
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.findall("m:numFmts/m:numFmt", _NS)}
    kinds = [int(x.get("numFmtId", "0")) for x in root.findall("m:cellXfs/m:xf", _NS)]
    return {i for i, k in enumerate(kinds) if (_is_date_format(custom[k]) if k in custom else k in DATE_FORMATS)}


def _date_text(v: str, from_1904: bool) -> str:
    """Serial number -> date text; a time of day alone for serials below 1."""
    try:
        serial = float(v)
        start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30) if serial >= 60 else dt.datetime(1899, 12, 31)
        # spreadsheets store fractions of days: whole seconds are meant
        moment = start + dt.timedelta(seconds=round(serial * 86400))
    except (ValueError, OverflowError):
        return v
    return str(moment.time()) if 0 <= serial < 1 else str(moment)


def _number(v: str) -> str:
    """Cached numeric text as the sheet-to-CSV step prints it: int unless the
    text has a decimal point or exponent, then Python float text."""
    try:
        return str(float(v)) if any(ch in v for ch in ".Ee") else str(int(v))
    except ValueError:
        return v


_M = f"{{{_NS['m']}}}"
ROW, CELL, VALUE, INLINE = (_M + t for t in ("row", "c", "v", "is"))


def _cell_text(kind: str, v: str, style: str, shared: dict[int, str], dates: set[int], from_1904: bool) -> str:
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return "True" if v.strip() == "1" else "False"
    if kind in ("str", "e"):
        return v
    if int(style) in dates:
        return _date_text(v, from_1904)
    return _number(v)


#: bytes of a worksheet's rows parsed at once
PIECE_BYTES = 1 << 20
_ATTRIBUTES = rb"""((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*/?>"""
_ROW_NUMBER = re.compile(rb"""\sr\s*=\s*["']([0-9]+)""")
_ANY_VALUE = re.compile(rb"<(?:[\w.-]+:)?v(?:\s[^>]*)?>\s*([0-9]+)\s*<")
_OTHER_ENCODING = re.compile(rb"""(?:\xef\xbb\xbf)?<\?xml[^>]*encoding\s*=\s*["'](?!utf-?8|us-ascii)""", re.I)
_SHEET_DATA = re.compile(rb"<((?:[\w.-]+:)?)sheetData" + _ATTRIBUTES)


class _Rows:
    """Counts rows as they are cut off a sheet: ``ordinal`` rows are given out
    (gaps in the row numbers filled), the last one has the sheet's row number ``at``."""

    def __init__(self, ordinal: int = 0, at: int = -1):
        self.ordinal, self.at, self.elements = ordinal, at, 0

    def step(self, number: int | None) -> int:
        """The number of missing rows before the next row element."""
        at = self.at + 1 if number is None else number - 1
        gap = max(0, at - self.at - 1)
        self.ordinal, self.at, self.elements = self.ordinal + gap + 1, at, self.elements + 1
        return gap


def _row_pieces(open_part) -> Iterator[tuple[int, int, bytes, bytes]]:
    """A worksheet cut into runs of whole rows without parsing them: (rows before,
    row number before, start tag with the sheet's namespaces, xml of the rows).
    What surrounds the rows is parsed here, so a part that is not well formed is
    noticed; the rows are parsed by whoever gets the piece.

    Inside ``sheetData`` a "<" begins a tag unless there are comments, CDATA or
    processing instructions; a sheet that has these, a DTD or another encoding is
    parsed here and its rows written out anew.
    """
    seen = _Rows()
    with open_part() as f:
        head = b""
        while not (found := _SHEET_DATA.search(head)):
            more = f.read(PIECE_BYTES)
            if not more:
                break
            head += more
        plain = found and b"<!DOCTYPE" not in head[:found.end()] and not _OTHER_ENCODING.match(head)
        if plain:
            outside = ET.XMLPullParser(("start", "start-ns", "end-ns"))
            outside.feed(head[:found.end()])
            spaces, last = [], None
            for event, x in outside.read_events():
                if event == "start-ns":
                    spaces.append(x)
                elif event == "end-ns":
                    spaces.pop()
                else:
                    last = x.tag
            plain = last == _M + "sheetData"
        if plain:
            # the innermost declaration of a prefix holds
            start = ("<rows" + "".join(f" xmlns{':' if p else ''}{p}={quoteattr(u)}" for p, u in dict(spaces).items()) + ">").encode()
            tag = b"<" + found.group(1) + b"row"
            row, close = re.compile(re.escape(tag) + _ATTRIBUTES), b"</" + found.group(1) + b"sheetData"
            buf, empty = head[found.end():], found.group(0).endswith(b"/>")
            while not empty:
                end = buf.find(close)
                cut = end if end >= 0 else _last_tag(buf, tag)
                if cut > 0 and (end >= 0 or cut >= PIECE_BYTES // 2):
                    xml = buf[:cut]
                    if b"<!" in xml or b"<?" in xml:
                        plain = False
                        break
                    before = (seen.ordinal, seen.at)
                    for m in row.finditer(xml):
                        r = _ROW_NUMBER.search(m.group(1)) if m.group(1) else None
                        seen.step(int(r.group(1)) if r else None)
                    yield *before, start, xml
                    buf = buf[cut:]
                    end = end - cut if end >= 0 else end
                if end >= 0:
                    break
                more = f.read(PIECE_BYTES)
                if not more:
                    break  # the parser finds the end missing
                buf += more
            if plain:
                while buf:
                    outside.feed(buf)
                    buf = f.read(PIECE_BYTES)
                outside.close()
    if not plain:
        yield from _parsed_pieces(open_part, seen)


def _last_tag(buf: bytes, tag: bytes) -> int:
    """Where the last ``tag`` begins, -1 if there is none."""
    at = buf.rfind(tag)
    while at >= 0 and buf[at + len(tag):at + len(tag) + 1] not in (b" ", b"\t", b"\r", b"\n", b"/", b">"):
        at = buf.rfind(tag, 0, at)
    return at


def _parsed_pieces(open_part, seen: _Rows) -> Iterator[tuple[int, int, bytes, bytes]]:
    """As ``_row_pieces``, from the row after those ``seen``, by parsing the part."""
    skip, out, size, before = seen.elements, [], 0, (seen.ordinal, seen.at)
    with open_part() as f:
        for _, row in ET.iterparse(f):
            if row.tag != ROW:
                continue
            if skip:
                skip -= 1
            else:
                seen.step(int(row.get("r")) if row.get("r") else None)
                row.tail = None
                out.append(ET.tostring(row))
                size += len(out[-1])
            row.clear()
            if size >= PIECE_BYTES:
                yield *before, b"<rows>", b"".join(out)
                out, size, before = [], 0, (seen.ordinal, seen.at)
    if out:
        yield *before, b"<rows>", b"".join(out)


#: a plain cell (column, style, type, ">" and inline text, value), the end of a row, or the begin of one or of any other tag
_TOKEN = re.compile('<c(?: r="([A-Z]+)[0-9]+")?(?: s="([0-9]+)")?(?: t="([A-Za-z]+)")?'
                    '(?:/>|>(?:<is><t(?: xml:space="preserve")?(>[^<]*)</t></is>|<v>([^<]*)</v>)?</c>)|</row>|(<row(?: [A-Za-z:0-9]+="[^"<]*")*/?>|<)')
_ROW_ATTRIBUTE = re.compile(' r="([^"]*)"')
_REFERENCE = re.compile("&(#x[0-9a-fA-F]+|#[0-9]+|[a-z]+);")
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _referred(m) -> str:
    name = m.group(1)
    return _ENTITIES[name] if name[0] != "#" else chr(int(name[2:], 16) if name[1] == "x" else int(name[1:]))


def _plain_rows(seen: _Rows, start: bytes, xml: bytes, shared: dict[int, str], dates: set[int], from_1904: bool) -> list[list[str]] | None:
    """The rows of a piece that holds only plain cells, as nearly all do: the parser
    checks the whole piece and one expression finds the cells.  Else nothing."""
    if f' xmlns="{_NS["m"]}"'.encode() not in start or b"\r" in xml:
        return None
    pyexpat.ParserCreate(None, "}").Parse(start + xml + b"</rows>", True)
    rows, cells, following = [], [], 0
    for ref, style, kind, inline, v, row in _TOKEN.findall(xml.decode()):
        if row:
            if row == "<" or "xmlns" in row:
                return None
            number = _ROW_ATTRIBUTE.search(row)
            rows += [[] for _ in range(seen.step(int(number.group(1)) if number else None))]
            cells, following = [], 0
            rows.append(cells)
            continue
        i = _col_index(ref) if ref else following
        following = i + 1
        text = inline[1:] if inline else v
        if "&" in text:
            text = _REFERENCE.sub(_referred, text)
        if kind == "inlineStr":
            if not inline:
                continue
        elif not v:
            continue
        else:
            text = _cell_text(kind or "n", text, style or "0", shared, dates, from_1904)
        if i == len(cells):
            cells.append(text)
        else:
            _put(cells, i, text)
    return rows


def _put(cells: list[str], i: int, text: str) -> None:
    if i >= len(cells):
        cells += [""] * (i + 1 - len(cells))
    cells[i] = text


def _parse_piece(ordinal: int, at: int, start: bytes, xml: bytes, shared: dict[int, str], dates: set[int], from_1904: bool) -> list[list[str]]:
    """The rows of a piece, as wide as their last cell; missing rows are empty."""
    rows = _plain_rows(_Rows(ordinal, at), start, xml, shared, dates, from_1904)
    if rows is not None:
        return rows
    rows, seen = [], _Rows(ordinal, at)
    for row in ET.fromstring(start + xml + b"</rows>"):
        if row.tag != ROW:
            continue
        number, cells, following = row.get("r"), [], 0
        rows += [[] for _ in range(seen.step(int(number) if number else None))]
        rows.append(cells)
        for c in row:
            if c.tag != CELL:
                continue
            i = _col_index(_REF.match(c.get("r")).group(1)) if c.get("r") else following
            following, kind = i + 1, c.get("t", "n")
            if kind == "inlineStr":
                is_ = next((x for x in c if x.tag == INLINE), None)
                text = None if is_ is None else _text(is_)
            else:
                v = next((x.text for x in c if x.tag == VALUE), None)
                text = None if v is None else _cell_text(kind, v, c.get("s", "0"), shared, dates, from_1904)
            if text is not None:
                _put(cells, i, text)
    return rows


def _shared_strings(part: BinaryIO) -> list[str]:
    """The texts of the shared strings; the tree is let go of as it is read."""
    texts, open_ = [], []
    for event, el in ET.iterparse(part, ("start", "end")):
        if event == "start":
            open_.append(el)
            continue
        open_.pop()
        if len(open_) == 1:
            if el.tag == _M + "si":
                texts.append(_text(el))
            open_[0].clear()
    return texts


def iter_pieces(data: bytes | BinaryIO) -> Iterator[tuple[str, tuple]]:
    """(sheet name, what ``_parse_piece`` needs for some rows) in book order, last
    an empty piece per sheet.  A piece carries the shared strings it may name."""
    z = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        with z.open("xl/sharedStrings.xml") as part:
            shared = _shared_strings(part)
    dates = _date_styles(z.read("xl/styles.xml") if "xl/styles.xml" in names else None)
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", _NS)}
    book = ET.fromstring(z.read("xl/workbook.xml"))
    about = book.find("m:workbookPr", _NS)
    from_1904 = about is not None and about.get("date1904") in ("1", "true")
    for s in book.find("m:sheets", _NS).findall("m:sheet", _NS):
        target = rels[s.get(f"{{{_NS['r']}}}id")]
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        empty = (0, -1, b"<rows>", b"")
        for ordinal, at, start, xml in chain(_row_pieces(lambda path=path: z.open(path)), [empty]):
            # any number in a value may be that of a shared string
            named = {int(v) for v in set(_ANY_VALUE.findall(xml)) if len(v) < 12} if shared else ()
            yield s.get("name"), (ordinal, at, start, xml, {i: shared[i] for i in named if i < len(shared)}, dates, from_1904)


def read_xlsx(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """[(sheet name, rows of cell text)] of a small workbook at once."""
    sheets: dict[str, list[list[str]]] = {}
    for name, piece in iter_pieces(data):
        sheets.setdefault(name, []).extend(_parse_piece(*piece))
    width = {name: max(map(len, rows), default=0) for name, rows in sheets.items()}
    return [(name, [r + [""] * (width[name] - len(r)) for r in rows]) for name, rows in sheets.items()]


def _workbook_members(name: str, content: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(content) as zf:
            for member in zf.namelist():
                if member.endswith(".xlsx") and not member.startswith("__MACOSX"):
                    stem = posixpath.splitext(posixpath.basename(member))[0]
                    with zf.open(member) as f:
                        if zf.getinfo(member).compress_type == zipfile.ZIP_STORED:
                            yield stem, f  # read where it is
                            continue
                        with tempfile.TemporaryFile() as book:
                            shutil.copyfileobj(f, book, PIECE_BYTES)
                            yield stem, book
    else:
        yield posixpath.splitext(name)[0], content


#: order of sources that hold the same sheet file: the greatest wins
ZIPPED, LOOSE = 0, 1
#: row number that marks a source that could not be read
FAILED = -1
_PIECES = T.StructType([T.StructField(n, t) for n, t in (
    ("source_file", T.StringType()), ("sheet", T.StringType()), ("workbook", T.StringType()), ("_source", T.StringType()), ("_piece", T.LongType()),
    ("ordinal", T.LongType()), ("at", T.LongType()), ("start", T.BinaryType()), ("xml", T.BinaryType()), ("size", T.LongType()), ("ids", T.ArrayType(T.IntegerType())),
    ("texts", T.ArrayType(T.StringType())), ("dates", T.ArrayType(T.IntegerType())), ("from_1904", T.BooleanType()))])
#: cells are as wide as the row here, ``_width`` says how wide
_PARSED = T.StructType([*SHEET_ROWS_SCHEMA.fields, T.StructField("workbook", T.StringType()), T.StructField("_source", T.StringType()), T.StructField("_width", T.IntegerType())])
_UNREADABLE = (zipfile.BadZipFile, ET.ParseError, pyexpat.ExpatError, KeyError, IndexError, ValueError, AttributeError, EOFError, zlib.error)


#: bytes of a file; the row before a file's first bytes has its length
_BYTES = "path string, block long, k long, length long, data binary"


def _runs_of_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: the lines of files' splits, in order -> the bytes they are.
    A file that does not end in a line feed has one too many here."""
    for k, b in enumerate(batches):
        path, block = b.column("path"), b.column("block")
        new = np.flatnonzero(pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)) + 1
        edges = [0, *new.tolist(), b.num_rows]
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            if at < to:
                data = b"\n".join(b.column("value")[at:to].to_pylist()) + b"\n"
                yield pa.RecordBatch.from_arrays([path[at:at + 1], block[at:at + 1], pa.array([k], pa.int64()), pa.nulls(1, pa.int64()), pa.array([data], pa.binary())],
                                                 names=["path", "block", "k", "length", "data"])


def _bytes_of_files(spark: SparkSession, found: list[str]) -> DataFrame:
    """Every file's bytes in order, all of a file in one partition.  Spark's text
    source cuts files at line feeds, whatever they hold, and reads their splits in
    parallel.  Like Spark's other sources it passes over files without any byte."""
    path = F.col("_metadata.file_path").alias("path")
    lines = spark.read.option("lineSep", "\n").text(found).select(path, F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    lengths = spark.read.format("binaryFile").load(found).select(path, F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("k"), "length", F.lit(None).cast("binary").alias("data"))
    return lengths.unionByName(lines.mapInArrow(_runs_of_bytes, _BYTES)).repartition("path").sortWithinPartitions("path", "block", "k")


def _cut_workbooks(skip: bool):
    """mapInArrow body: the bytes of workbooks, in order -> the pieces of their
    sheets.  A source that cannot be read gives, when skipped, one piece without xml
    whose ``_source`` is the error; rows it gives otherwise are left out by
    ``ingest_workbooks``."""
    arrow = to_arrow_schema(_PIECES)

    def pieces_of(name: str, content: BinaryIO):
        kind, n = ZIPPED if name.lower().endswith(".zip") else LOOSE, 0
        for k, (stem, data) in enumerate(_workbook_members(name, content)):
            for sheet, (ordinal, at, start, xml, shared, dates, from_1904) in iter_pieces(data):
                packed = pa.compress(xml, "zstd", asbytes=True)
                yield (f"{stem}_{sheet}", sheet, name, f"{kind}/{name}/{k:06d}", n, ordinal, at, start, packed, len(xml), list(shared), list(shared.values()), list(dates), from_1904)
                n += 1

    def cut(path: str, length: int, content: BinaryIO):
        name = posixpath.basename(unquote(path))
        content.truncate(length)
        try:
            for piece in pieces_of(name, content):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(piece, arrow, strict=True)], schema=arrow)
        except _UNREADABLE as e:
            if not skip:
                raise
            yield pa.RecordBatch.from_pylist([{"workbook": name, "_source": f"{type(e).__name__}: {e}", "_piece": -1}], schema=arrow)

    def run(batches):
        path, length, content = None, 0, None
        for b in batches:
            for i in range(b.num_rows):
                if (n := b.column("length")[i].as_py()) is not None:
                    if content:
                        with content:
                            yield from cut(path, length, content)
                    path, length, content = b.column("path")[i].as_py(), n, tempfile.TemporaryFile()
                else:
                    content.write(b.column("data")[i].as_buffer())
        if content:
            with content:
                yield from cut(path, length, content)

    return run


def _parse_pieces(skip: bool):
    """mapInArrow body: pieces -> sheet rows; cell text is escaped (S3)."""
    arrow = to_arrow_schema(_PARSED)

    def rows_of(p: dict) -> pa.RecordBatch:
        shared = dict(zip(p["ids"], p["texts"], strict=True))
        xml = pa.decompress(p["xml"], p["size"], "zstd", asbytes=True)
        rows = _parse_piece(p["ordinal"], p["at"], p["start"], xml, shared, set(p["dates"]), p["from_1904"])
        n, widths = len(rows), np.array([len(r) for r in rows], "int32")
        texts = pa.array([c for r in rows for c in r], pa.string())
        texts = pc.replace_substring(pc.replace_substring(texts, "\r", ""), "\n", "<br>")
        cells = pa.ListArray.from_arrays(np.concatenate([[0], widths.cumsum()]).astype("int32"), texts)
        same = lambda v: pa.repeat(pa.scalar(v, pa.string()), n)
        columns = [same(p["source_file"]), same(p["sheet"]), pa.array(np.arange(p["ordinal"], p["ordinal"] + n)), cells, same(p["workbook"]), same(p["_source"]), pa.array(widths)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                p = b.slice(i, 1).to_pylist()[0]
                error = p["_source"]
                if p["xml"] is not None:
                    try:
                        yield rows_of(p)
                        continue
                    except _UNREADABLE as e:
                        if not skip:
                            raise
                        error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"source_file": "", "row_ordinal": FAILED, "workbook": p["workbook"], "_source": error}], schema=arrow)

    return run


def _sources(spark: SparkSession, folder: str, target_files: list[str] | None, skip: bool) -> DataFrame:
    found = [f for p in ("xlsx", "zip") for f in list_files(spark, f"{folder.rstrip('/')}/*.{_either_case(p)}")]
    if target_files:
        found = [f for f in found if posixpath.basename(f) in set(target_files)]
    if not found:
        return spark.createDataFrame([], _PARSED)
    # a workbook is cut into pieces of whole rows by one task; the pieces are
    # dealt out, so it is parsed by many tasks
    pieces = _bytes_of_files(spark, found).mapInArrow(_cut_workbooks(skip), _PIECES)
    return stored(pieces.repartition("workbook", "_piece").mapInArrow(_parse_pieces(skip), _PARSED), "workbooks")


def ingest_workbooks(spark: SparkSession, folder: str, target_files: list[str] | None = None, on_error: str = "stop") -> DataFrame:
    """S1 (+S2 target-file filter, +S3 escaping): every worksheet of every
    workbook under ``folder`` as sheet rows, with the ``workbook`` they are from.
    Only the listed files are opened: the filter is on file names, before any
    content is read."""
    return ingest_with_failures(spark, folder, target_files, on_error)[0]


def ingest_with_failures(spark: SparkSession, folder: str, target_files: list[str] | None = None, on_error: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(sheet rows, ``(workbook, error)`` of the sources left out).  A source goes
    in whole or not at all: its rows from before the error are dropped."""
    rows = _sources(spark, folder, target_files, on_error == "skip")
    failed = rows.where(F.col("row_ordinal") == FAILED).groupBy("workbook").agg(F.min("_source").alias("error"))
    rows = rows.join(failed.select("workbook"), "workbook", "left_anti") if on_error == "skip" else rows
    # rows are made as wide as the sheet's widest
    wide = rows.groupBy("source_file", "_source").agg(F.max("_width").alias("w"))
    last = wide.groupBy("source_file").agg(F.max(F.struct("_source", "w")).alias("_last"))
    rows = join_per_file(rows, last)
    rows = rows.where(F.col("_source") == F.col("_last._source"))
    missing = F.col("_last.w") - F.col("_width")
    rows = rows.withColumn("cells", F.when(missing == 0, F.col("cells")).otherwise(F.concat("cells", F.array_repeat(F.lit(""), missing))))
    return rows.select(*[f.name for f in SHEET_ROWS_SCHEMA.fields], "workbook"), failed


def _either_case(extension: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in extension)
