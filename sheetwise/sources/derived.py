"""Report sheets derived from the driver tables (test and bench input).

The engine's real input is report workbooks; the driver only gives TPC-H-like
tables.  These builders *encode* table rows as sheet rows -- one order or one
line item per sheet row, header text per year in the layouts the grammars
expect -- so the whole engine (header parsing, unpivot, regroup, keys) runs,
its work grows with the tables, and an independent SQL query can compute the
expected answer straight from the numbers.

Every cell and header is a SQL expression string valid in both Spark SQL and
DuckDB, so the oracle can reuse the *cell values* (never the engine logic).

Files: one per (year, group); ``R`` = order/ship year + 19 is the nominal
review year.  R = 2020 gives a name without a year key, so those rows are
skipped by every table (P8).
"""

from __future__ import annotations

import io
import itertools
import struct
import zipfile
import zlib
from functools import reduce
from operator import xor
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise import constants as K
from sheetwise.operators.ordinal import dense_ordinal
from sheetwise.session import shuffles_released, stored


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Ministry names used by the derived sheets: the 24 master names, the two
# spelling variants, and one unknown name.
FIXTURE_MINISTRY_NAMES = [n for _, n in K.MINISTRY_MASTER] + list(K.MINISTRY_NAME_VARIANTS) + ["不明省"]


def ministry_name_sql(key: str) -> str:
    n = len(FIXTURE_MINISTRY_NAMES)
    whens = " ".join(f"WHEN {i} THEN {_q(name)}" for i, name in enumerate(FIXTURE_MINISTRY_NAMES))
    return f"CASE ({key}) % {n} {whens} END"


def file_stem_sql(r: str) -> str:
    return f"concat('database', CAST({r} AS STRING), CASE WHEN {r} IN (2018, 2019) THEN '_220427' ELSE '' END)"


# --- orders -> review sheets -------------------------------------------------------

ORDERS_BASE_SQL = {
    "R": "year(o_orderdate) + 19",
    "grp": ("CASE WHEN o_orderstatus = 'F' THEN 'segment' "
            "WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'review_b' ELSE 'review_a' END"),
}


def budget_value_sql(k: int) -> str:
    return (f"CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN '-' "
            f"ELSE CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) + {(k + 3) * 7} AS STRING) END")


def _y(r_off: int) -> str:
    return f"CAST(R {'+' if r_off >= 0 else '-'} {abs(r_off)} AS STRING)"


def _h15(item: str, r_off: int) -> str:
    return f"concat('予算額-', {_y(r_off)}, '年度{item}')"


def _h14(item: str, r_off: int, tail: str = "") -> str:
    return f"concat('予算額・執行額(単位:百万円)-{item}-', {_y(r_off)}, '年度{tail}')"


# (header for review year 2015+, header for 2014, cell value)
ORDERS_SHEET = [
    ("'府省庁'", "'府省'", ministry_name_sql("o_custkey")),
    ("'事業名'", "'事業名'", "concat('事業', CAST(o_orderkey AS STRING))"),
    ("'事業番号-1'", "'事業番号'", "CAST(o_custkey AS STRING)"),
    ("'事業番号-2'", "'事業番号-2'", "CAST(o_orderkey % 100 AS STRING)"),
    ("'事業概要'", "'事業概要(200字程度)'", "o_orderpriority"),
    ("'事業概要URL'", "'事業概要URL'", "concat('http://example.org/p/', CAST(o_orderkey AS STRING))"),
    ("'事業開始・終了(予定)年度'", "'事業開始年度'",
     "CASE WHEN R = 2014 THEN CAST(year(o_orderdate) AS STRING) WHEN o_orderstatus = 'O' THEN '' "
     "ELSE concat(CAST(year(o_orderdate) AS STRING), '-', CAST(year(o_orderdate) + 1 AS STRING)) END"),
    ("'主要政策・施策'", "'事業終了(予定)年度'",
     "CASE WHEN R = 2014 THEN CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(year(o_orderdate) + 2 AS STRING) END "
     "ELSE o_orderstatus END"),
    ("'主要施策'", "'政策・施策名'",
     "CASE WHEN R = 2014 THEN o_orderstatus ELSE concat('施策', CAST(o_custkey % 10 AS STRING)) END"),
    ("CASE WHEN grp = 'segment' THEN 'セグメント名' ELSE '備考' END",
     "CASE WHEN grp = 'segment' THEN 'セグメント名' ELSE '備考' END", "'x'"),
    ("'担当部局庁'", "'担当部局庁'",
     "CASE WHEN o_orderkey % 5 = 0 THEN 'NA' ELSE concat('局', CAST(o_custkey % 7 AS STRING)) END"),
    ("'事業の目的(何のために)'", "'事業の目的'", "concat('目的', CAST(o_orderkey % 13 AS STRING))"),
    ("'根拠法令(具体的な条項も記載)'", "'根拠法令'", "'なし'"),
    (_h15("予算の状況当初予算", -3), _h14("予算の状況当初予算", -3), budget_value_sql(-3)),
    (_h15("予算の状況当初予算", -2), _h14("予算の状況当初予算", -2), budget_value_sql(-2)),
    (_h15("予算の状況当初予算", -1), _h14("予算の状況当初予算", -1), budget_value_sql(-1)),
    (_h15("予算の状況当初予算", 0), _h14("予算の状況当初予算", 0), budget_value_sql(0)),
    (_h15("要求予算の状況当初予算", 1), _h14("要求予算の状況当初予算", 1, "要求"),
     "CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(CAST(floor(o_totalprice / 900) AS BIGINT) AS STRING) END"),
    (_h15("執行額", -3), _h14("執行額", -3), "CAST(CAST(floor(o_totalprice / 100) AS BIGINT) % 3000 AS STRING)"),
    (_h15("執行額", -1), _h14("執行額", -1), "CAST(CAST(floor(o_totalprice / 1100) AS BIGINT) AS STRING)"),
    (_h15("当初予算+補正予算に対する執行額の割合(%)", -1), _h14("当初予算+補正予算に対する執行額の割合(%)", -1),
     "CASE WHEN o_orderkey % 4 = 0 THEN '95.5' ELSE '' END"),
    (_h15("執行額", -6), _h14("執行額", -6), "'OLD'"),
    (_h15("予算の状況計", 1), _h14("予算の状況計", 1, "要求"), "CAST(o_custkey % 50 AS STRING)"),
    (_h15("予算の状況計", 0), _h14("予算の状況計", 0),
     "CASE WHEN o_orderkey % 6 = 0 THEN 'NA' ELSE CAST(o_custkey % 70 AS STRING) END"),
    ("'府省'", "'府省庁'", "'dup'"),
]


# --- lineitem -> cost-table and payee-list sheets -----------------------------------

LINEITEM_BASE_SQL = {"R": "year(l_shipdate) + 19", "grp": "'lines'"}
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

_P = K.EXPENDITURE_PREFIX


def _pay15(n: int, item: str) -> str:
    return f"'{_P}-A.支払先-{n}-{item}'"


def _pay14(n: int, item: str) -> str:
    return f"'{_P}-グループ-{item}-{n}'"


LINEITEM_SHEET = [
    ("'府省庁'", "'府省'", ministry_name_sql("l_suppkey")),
    ("'事業名'", "'事業名'", "concat('L', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))"),
    ("'事業番号-1'", "'事業番号'", "CAST(l_partkey AS STRING)"),
    ("'費目・使途-A.支払先費目-1'",) * 2 + ("l_returnflag",),
    ("'費目・使途-A.支払先使途-1'",) * 2 + ("l_linestatus",),
    ("'費目・使途-A.支払先金額(百万円)-1'",) * 2 + ("CAST(CAST(l_quantity AS BIGINT) AS STRING)",),
    ("'費目・使途-A.支払先計'",) * 2 + ("CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING)",),
    ("'費目・使途-B.支払先費目-01'",) * 2 + ("CASE WHEN l_discount > 0.05 THEN concat(' ', l_returnflag, ' ') ELSE '' END",),
    ("'費目・使途-B.支払先金額(百万円)-1'",) * 2 + ("CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)",),
    ("'費目・使途-A.その他-1'",) * 2 + ("'x'",),
    ("'費目・使途-C.支払先使途-2'",) * 2 + ("concat(l_returnflag, l_linestatus)",),
    ("'費目・使途(再掲)-C.支払先使途-2'",) * 2 +
    ("CASE WHEN l_linenumber % 2 = 1 THEN concat('再', CAST(l_linenumber AS STRING)) ELSE '' END",),
    ("'費目・使途-D.支払先費目-3'",) * 2 +
    ("CASE WHEN l_linenumber = 3 THEN '　' WHEN l_linenumber = 4 THEN 'NA' ELSE '' END",),
    (_pay15(1, "支出先"), _pay14(1, "支出先"), "concat('S', CAST(l_suppkey AS STRING))"),
    (_pay15(1, "支出額"), _pay14(1, "支出額"), "CAST(CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS STRING)"),
    (_pay15(1, "入札者数(応募者数)"), _pay14(1, "入札者数(応募者数)"), "CAST(l_linenumber AS STRING)"),
    (_pay15(1, "契約方式-1"), _pay14(1, "契約方式"),
     "CASE WHEN l_returnflag = 'R' THEN '一般競争入札' ELSE '随意契約' END"),
    (_pay15(1, "一者応札・一者応募又は競争性のない随意契約となった理由及び改善策"),
     _pay14(1, "一者応札・一者応募又は競争性のない随意契約となった理由及び改善策"),
     "CASE WHEN l_discount < 0.03 THEN concat('一者応札のため', CAST(l_partkey % 10 AS STRING)) ELSE '' END"),
    (_pay15(2, "業務概要"), _pay14(2, "業務概要"), "concat('業務', CAST(l_partkey % 100 AS STRING))"),
    (_pay15(2, "支出先"), _pay14(2, "支出先"),
     "CASE WHEN l_linenumber % 2 = 0 THEN concat('T', CAST(l_suppkey AS STRING)) ELSE '' END"),
]


def _with_files(base: DataFrame, base_sql: dict) -> DataFrame:
    b = base
    for name, expr in base_sql.items():
        b = b.withColumn(name, F.expr(expr))
    return b.withColumn("source_file", F.concat(F.expr(file_stem_sql("R")), F.lit("_"), F.col("grp")))


def _workbook(base: DataFrame, base_sql: dict, spec: list, order_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sheet rows, header rows).  Rows are numbered on the narrow base
    columns; the wide ``cells`` arrays are built after, so the range shuffle
    and the checkpoint never carry them."""
    b = _with_files(base, base_sql)
    numbered = dense_ordinal(b, "source_file", order_cols)
    cells = F.array(*[F.expr(v) for _, _, v in spec])
    data = numbered.select("source_file", F.col("grp").alias("sheet"), "row_ordinal", cells.alias("cells"))
    # the header rows are a tiny table of their own (files x 1 row), cheap to
    # recompute from the base: stored, so every consumer (gate, layouts,
    # normalization) reads a few rows instead of re-deriving them
    heads = stored(_heads(b, spec), "heads")
    return heads.unionByName(data), heads


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def orders_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the sheet file each one lands in."""
    return _with_files(_orders(spark, sf_dir), ORDERS_BASE_SQL)


def orders_workbook(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sheet rows, header rows) of the review sheets encoded from ``orders``."""
    return _workbook(_orders(spark, sf_dir), ORDERS_BASE_SQL, ORDERS_SHEET, ["o_orderkey"])


def lineitem_workbook(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sheet rows, header rows) of the cost/payee sheets encoded from ``lineitem``."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_ORDER)
    return _workbook(li, LINEITEM_BASE_SQL, LINEITEM_SHEET, LINEITEM_ORDER)


def orders_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows only of the orders review sheets (one per file present)."""
    b = _with_files(_orders(spark, sf_dir), ORDERS_BASE_SQL)
    return _heads(b, ORDERS_SHEET)


def lineitem_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_ORDER)
    return _heads(_with_files(li, LINEITEM_BASE_SQL), LINEITEM_SHEET)


def _heads(b: DataFrame, spec: list) -> DataFrame:
    head_cells = F.array(*[F.expr(f"CASE WHEN R = 2014 THEN {h14} ELSE {h15} END") for h15, h14, _ in spec])
    return (b.select("source_file", "grp", "R").distinct()
            .select("source_file", F.col("grp").alias("sheet"), F.lit(0).alias("row_ordinal"), head_cells.alias("cells")))


# --- sheets -> workbook files -----------------------------------------------------------

_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/>'
                           '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>',
}
_BOOK = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _crc_shift(n: int) -> list[int]:
    """Where each bit of a CRC-32 goes when ``n`` zero bytes follow."""
    times = lambda m, v: reduce(xor, (m[i] for i in range(32) if v >> i & 1), 0)
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        step = [times(step, x) for x in step]
    out = [1 << i for i in range(32)]
    while n:
        if n & 1:
            out = [times(step, x) for x in out]
        step, n = [times(step, x) for x in step], n >> 1
    return out


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings after one another, from theirs and the second's length."""
    return reduce(xor, (m for i, m in enumerate(_crc_shift(length)) if first >> i & 1), second)


_ROWS_BEGIN, _ROWS_END = f'<worksheet xmlns="{_BOOK}"><sheetData>'.encode(), b"</sheetData></worksheet>"
#: rows of a sheet that one task compresses
ROWS_PER_PIECE = 8192


def _deflated(text: bytes) -> bytes:
    """A deflate piece that others may follow."""
    z = zlib.compressobj(wbits=-15)
    return z.compress(text) + z.flush(zlib.Z_FULL_FLUSH)


class _Book:
    """One ``.xlsx`` written into a stream from compressed pieces; alone or inside a zip."""

    def __init__(self, sink):
        self.zip, self.sheets, self.part = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED), [], None

    def piece(self, sheet: str, data: bytes, crc: int, size: int) -> None:
        if not self.sheets or self.sheets[-1] != sheet:
            self._end_sheet()
            self.sheets.append(sheet)
            self.part = zipfile.ZipInfo(f"xl/worksheets/sheet{len(self.sheets)}.xml")
            self.part.compress_type, self.part.flag_bits, self.part.header_offset = zipfile.ZIP_DEFLATED, 8, self.zip.fp.tell()
            self.part.CRC = self.part.compress_size = self.part.file_size = 0
            self.zip.fp.write(self.part.FileHeader(zip64=True))
            self._append(_deflated(_ROWS_BEGIN), zlib.crc32(_ROWS_BEGIN), len(_ROWS_BEGIN))
        self._append(data, crc, size)

    def _append(self, data: bytes, crc: int, size: int) -> None:
        self.zip.fp.write(data)
        p = self.part
        p.CRC, p.compress_size, p.file_size = crc_joined(p.CRC, crc, size), p.compress_size + len(data), p.file_size + size

    def _end_sheet(self) -> None:
        if p := self.part:
            self._append(_deflated(_ROWS_END) + b"\x03\x00", zlib.crc32(_ROWS_END), len(_ROWS_END))  # an empty last block
            self.zip.fp.write(struct.pack("<4sLQQ", b"PK\x07\x08", p.CRC, p.compress_size, p.file_size))
            self.zip.filelist.append(p)
            self.zip.NameToInfo[p.filename] = p
            self.zip.start_dir = self.zip.fp.tell()

    def close(self) -> None:
        self._end_sheet()
        n = range(1, len(self.sheets) + 1)
        sheets = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="r{i}"/>' for i, s in zip(n, self.sheets, strict=True))
        links = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        for name, xml in {**_PARTS, "xl/workbook.xml": f'<workbook xmlns="{_BOOK}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>',
                          "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}">{links}</Relationships>'}.items():
            self.zip.writestr(name, xml)
        self.zip.close()


def _compress_rows(batches):
    """mapInArrow body: rows of xml in order -> compressed runs of them, with CRC and length."""
    schema = pa.schema([("book", pa.string()), ("sheet", pa.string()), ("piece", pa.int64()), ("k", pa.int64()),
                        ("data", pa.binary()), ("crc", pa.int64()), ("size", pa.int64())])
    for n, b in enumerate(batches):
        key = pa.StructArray.from_arrays([b.column(i) for i in range(3)], ["book", "sheet", "piece"])
        changes = np.zeros(b.num_rows, bool)
        for c in key.flatten():
            changes[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(changes).tolist(), b.num_rows]
        for at, to in itertools.pairwise(starts):
            if at < to:
                xml = b.column(3)[at:to].cast(pa.large_binary())
                ends = np.frombuffer(xml.buffers()[1], "int64")[xml.offset:xml.offset + to - at + 1]
                text = memoryview(xml.buffers()[2])[ends[0]:ends[-1]]
                values = (*key[at].as_py().values(), n, _deflated(text), zlib.crc32(text), len(text))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def write_workbooks(rows: DataFrame, folder: str, zipped: bool = False) -> int:
    """Sheet rows with the ``book`` they belong to -> one workbook file per book,
    sheets and rows in order; with ``zipped`` each inside a ``.zip`` of its own name.
    All tasks write and compress pieces of a sheet; a file is one stream from one
    task that puts compressed pieces after one another; a repeated task writes
    the same file again.  Returns the number of files."""

    def files(batches):
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root)
        name, book, stack = None, None, []

        def end():
            if book:
                book.close()
                for s in reversed(stack):
                    s.close()
                return pa.RecordBatch.from_pydict({"book": [name]})

        for b in batches:
            for i in range(b.num_rows):
                at, sheet, data, crc, size = (c[i] for c in b.columns)
                if at.as_py() != name:
                    if book:
                        yield end()
                    name = at.as_py()
                    out = store.open_output_stream(f"{root}/{name}.{'zip' if zipped else 'xlsx'}")
                    stack = [out]
                    if zipped:
                        outer = zipfile.ZipFile(out, "w")
                        inner = outer.open(f"{name}.xlsx", "w", force_zip64=True)
                        stack += [outer, inner, io.BufferedWriter(inner)]
                    book = _Book(stack[-1])
                book.piece(sheet.as_py(), data.as_py(), crc.as_py(), size.as_py())
        if book:
            yield end()

    def cell(c):
        for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(plain), F.lit(reference))
        return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), F.coalesce(c, F.lit("")), F.lit("</t></is></c>"))

    xml = F.concat(F.lit("<row>"), F.array_join(F.transform("cells", cell), ""), F.lit("</row>"))
    places = rows.select("book", "sheet", F.floor(F.col("row_ordinal") / ROWS_PER_PIECE).alias("piece"), "row_ordinal", "cells").repartition("book", "sheet", "piece")
    pieces = places.sortWithinPartitions("book", "sheet", "row_ordinal").select("book", "sheet", "piece", xml.alias("xml"))
    pieces = pieces.mapInArrow(_compress_rows, "book string, sheet string, piece long, k long, data binary, crc long, size long")
    in_order = pieces.repartition("book").sortWithinPartitions("book", "sheet", "piece", "k").select("book", "sheet", "data", "crc", "size")
    with shuffles_released(rows.sparkSession):
        return in_order.mapInArrow(files, "book string").count()


# --- customers -> one header-only sheet each (gate and header catalogues) -------------

def _bit(i: int) -> str:
    return f"(CAST(floor(c_custkey / {2 ** i}) AS BIGINT) % 2 = 1)"


CUSTOMER_FILE_SQL = "concat('database', CAST(2014 + c_custkey % 6 AS STRING), '_c', CAST(c_custkey AS STRING))"
COST_LETTER_SQL = "CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END"
SEQ_SQL = "CAST(c_custkey % 5 + 1 AS STRING)"
COST_ITEM_SQL = ("CASE c_nationkey % 6 WHEN 0 THEN '支払先費目' WHEN 1 THEN '支払先使途' "
                 "WHEN 2 THEN '支払先金額(百万円)' WHEN 3 THEN '支払先計' WHEN 4 THEN ' その他 ' ELSE c_mktsegment END")
PAYEE_ITEM_SQL = ("CASE c_custkey % 4 WHEN 0 THEN '入札者数(応募者数)' WHEN 1 THEN '契約方式-1' "
                  "WHEN 2 THEN c_mktsegment ELSE '支出額' END")
PAYEE_ITEM_2014_SQL = "CASE c_nationkey % 3 WHEN 0 THEN '支出先' WHEN 1 THEN '業務概要(注)' ELSE lower(c_mktsegment) END"

CUSTOMER_HEADERS = [
    f"CASE WHEN {_bit(0)} THEN '府省' ELSE 'x0' END",
    f"CASE WHEN {_bit(1)} THEN CASE WHEN c_custkey % 4 = 0 THEN ' 府省庁' ELSE '府省庁' END ELSE 'x1' END",
    f"CASE WHEN {_bit(2)} THEN CASE WHEN c_custkey % 3 = 0 THEN concat('事業', chr(10), '名') ELSE '事業名' END ELSE 'x2' END",
    f"CASE WHEN {_bit(3)} THEN '事業番号' ELSE 'x3' END",
    f"CASE WHEN {_bit(4)} THEN '事業番号-1' ELSE 'x4' END",
    "CASE WHEN c_custkey % 7 = 0 THEN 'セグメント名' ELSE 'x5' END",
    f"CASE WHEN {_bit(2)} AND c_custkey % 5 = 0 THEN '事業名' ELSE 'x6' END",
    f"concat('費目・使途-', {COST_LETTER_SQL}, '.', {COST_ITEM_SQL}, '-', {SEQ_SQL})",
    f"concat('{_P}-', {COST_LETTER_SQL}, '.支払先-', {SEQ_SQL}, '-', {PAYEE_ITEM_SQL})",
    f"CASE WHEN c_custkey % 2 = 0 THEN concat('{_P}-グループ-', {PAYEE_ITEM_2014_SQL}, '-', {SEQ_SQL}) ELSE 'x9' END",
]


def customer_header_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    return c.select(F.expr(CUSTOMER_FILE_SQL).alias("source_file"), F.lit("c").alias("sheet"),
                    F.lit(0).alias("row_ordinal"), F.array(*[F.expr(h) for h in CUSTOMER_HEADERS]).alias("cells"))


# --- strings for the normalization queries ---------------------------------------------

ERA_NAMES = ["明治", "大正", "昭和", "平成", "令和"]
ERA_LETTERS = ["M", "T", "S", "H", "R"]
CIRCLED = "".join(a for a, _ in K.CIRCLED_DIGITS)
HYPHENS = "".join(chr(cp) for cp in K.HYPHEN_CODEPOINTS)


def _pick(values: list[str], idx: str) -> str:
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


def _fw(num_sql: str) -> str:
    """Digits of a number, full-width when the order key says so."""
    return (f"CASE WHEN o_orderkey % 3 = 0 THEN translate(CAST({num_sql} AS STRING), '0123456789', '０１２３４５６７８９') "
            f"ELSE CAST({num_sql} AS STRING) END")


WAREKI_TEXT_SQL = (
    f"concat(substring('{CIRCLED}', CAST(o_orderkey % 20 + 1 AS INT), 1), '目的、', "
    f"{_pick(ERA_NAMES, 'o_orderkey % 5')}, CASE WHEN o_orderkey % 7 = 0 THEN '元' ELSE {_fw('o_orderkey % 30 + 1')} END, '年、', "
    f"{_pick(ERA_LETTERS, 'CAST(floor(o_orderkey / 5) AS BIGINT) % 5')}, CAST(o_orderkey % 30 + 1 AS STRING), '、', "
    f"'平成', CAST(o_orderkey % 20 + 1 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN ' ～ ' ELSE '〜' END, "
    f"CAST(o_orderkey % 20 + 1 + o_orderkey % 5 AS STRING), '年度、', CAST(o_orderkey % 40 + 1 AS STRING), '年度')"
)

HYPHEN_TEXT_SQL = (
    "concat('コンピュ', {h}, 'タ、東京', {h}, '大阪、事業番号', {h}, CAST(p_partkey % 10 AS STRING), "
    "'、リスト', {h}, 'グル', {h}, 'プ', {h}, '支出先、リスト', {h}, 'グループ')"
).format(h=f"substring('{HYPHENS}', CAST(p_partkey % 9 + 1 AS INT), 1)")
