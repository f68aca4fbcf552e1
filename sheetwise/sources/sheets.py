"""Sheet rows: the physical form of a wide report sheet.

``sheet_rows(source_file STRING, sheet STRING, row_ordinal BIGINT, cells ARRAY<STRING>)``
with ``row_ordinal = 0`` the header row and data rows numbered from 1 within
``source_file`` (one sheet file = one ``{workbook}_{sheet}`` stem).  A wide
row never becomes thousands of Spark columns: it stays one array, and every
job picks the positions it needs through a small per-file layout.

The header dimension ``sheet_headers(source_file, sheet, col_idx, name, raw_name)``
is derived from the header rows only (a tiny table: files x columns).
"""

from __future__ import annotations

import csv
import io
import posixpath
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetwise import constants as K
from sheetwise.session import join_per_file, shuffles_released, stored
from sheetwise.sources import csv_lines

SHEET_ROWS_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType(), False),
    T.StructField("sheet", T.StringType(), True),
    T.StructField("row_ordinal", T.LongType(), False),
    T.StructField("cells", T.ArrayType(T.StringType(), True), True),
])


def header_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row_ordinal") == 0)


def data_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row_ordinal") > 0)


def sheet_headers(rows: DataFrame) -> DataFrame:
    """Header dimension, with the column names a CSV reader would give.

    Like ``pandas.read_csv``: an empty header cell is named ``Unnamed: {i}``
    and the n-th repeat of a name gets ``.n`` appended, passing over numbers
    that would give the name of another header cell, so grammars that anchor at
    the end reject repeated columns (SURVEY Q13).
    """
    h = header_rows(rows).select("source_file", "sheet", F.posexplode("cells").alias("col_idx", "raw_name"))
    base = F.when(F.coalesce(F.col("raw_name"), F.lit("")) == "",
                  F.concat(F.lit("Unnamed: "), F.col("col_idx").cast("string"))).otherwise(F.col("raw_name"))
    return h.withColumn("_base", base).transform(_numbered_repeats)


#: a name that numbering its stem could give
_NUMBERED = r"(?s)^(.*)\.([1-9][0-9]*)\z"


def _numbered_repeats(h: DataFrame) -> DataFrame:
    """Names from ``_base``.  The k-th repeat of a name takes the k-th number that
    is free.  With the taken numbers t_1 < t_2 < ... of a name, t_i - i numbers are
    free below t_i; so the k-th free one is k plus the number of i with t_i - i < k.

    Every header stands under its own name; one that ends in ``.n`` stands under
    its stem as well, as a taken number.  Both counts are running sums inside a name,
    so the work is that of sorting the headers, however many a file has.
    """
    number = F.regexp_extract("_base", _NUMBERED, 2).try_cast("long")
    own = F.struct(F.col("_base").alias("key"), F.lit(0).alias("role"), F.col("col_idx").cast("long").alias("place"))
    taken = F.struct(F.regexp_extract("_base", _NUMBERED, 1).alias("key"), F.lit(1).alias("role"), number.alias("place"))
    each = h.withColumn("_r", F.explode(F.when(number.isNotNull(), F.array(own, taken)).otherwise(F.array(own))))
    each = each.select("source_file", "sheet", "col_idx", "raw_name", "_base", "_r.*").repartition("source_file", "key")
    in_order = Window.partitionBy("source_file", "key").orderBy("role", "place")
    new = F.when((F.col("role") == 0) | ~F.lag("place").over(in_order).eqNullSafe(F.col("place")) | (F.lag("role").over(in_order) == 0), 1).otherwise(0)
    each = each.withColumn("_new", new)
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("_k", F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).over(running) - 1)
    each = each.withColumn("_i", F.sum(F.when(F.col("role") == 1, F.col("_new")).otherwise(0)).over(running))
    each = each.withColumn("_free", F.when(F.col("role") == 0, F.col("_k")).otherwise(F.col("place") - F.col("_i")))
    up_to = Window.partitionBy("source_file", "key").orderBy("_free", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("_passed", F.sum(F.when(F.col("role") == 1, F.col("_new")).otherwise(0)).over(up_to)).where("role = 0")
    name = F.when(F.col("_k") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("."), (F.col("_k") + F.col("_passed")).cast("string")))
    return each.select("source_file", "sheet", F.col("col_idx").cast("int").alias("col_idx"), name.alias("name"), "raw_name")


def review_year(file_col) -> F.Column:
    """The first key of the year map contained in the file name, else NULL."""
    expr = None
    for key, year in K.FILENAME_YEAR_KEYS:
        cond = F.instr(file_col, key) > 0
        expr = F.when(cond, F.lit(year)) if expr is None else expr.when(cond, F.lit(year))
    return expr.otherwise(F.lit(None).cast("int"))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """File names matching a glob (driver-side listing, as Spark's own file index does)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hpath) or []
    return sorted(st.getPath().toString() for st in found if st.isFile())


CSV_ROWS_PER_BATCH = 2000
#: bytes of CSV text that Arrow's reader parses at once; longer rows are left to Python's
CSV_BLOCK_BYTES = 4 << 20


def _python_rows(part: BinaryIO) -> Iterator[list[str]]:
    """CSV rows without truly blank lines; a BOM is dropped, undecodable bytes become U+FFFD."""
    csv.field_size_limit(1 << 30)
    return (cells for cells in csv.reader(io.TextIOWrapper(part, encoding="utf-8-sig", errors="replace", newline="")) if cells)


def _csv_columns(open_part: Callable[[], BinaryIO], first_only: bool = False) -> Iterator[list[pa.Array] | list[list[str]]]:
    """The rows of a CSV part, a batch at a time: as columns (``first_only``: the
    first one alone) while all rows are as wide as the first, as Arrow's reader wants
    them; from where it stops, as lists of cells by Python's."""
    done, first = 0, next(_python_rows(open_part()), None)
    if first is None:
        return
    names = [f"f{i}" for i in range(len(first))]
    try:
        reader = pacsv.open_csv(open_part(), pacsv.ReadOptions(use_threads=False, block_size=CSV_BLOCK_BYTES, column_names=names), pacsv.ParseOptions(newlines_in_values=True),
                                pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, include_columns=names[:1] if first_only else names))
        for batch in reader:
            yield batch.columns
            done += batch.num_rows
    except pa.ArrowInvalid:
        rows = islice(_python_rows(open_part()), done, None)
        while some := list(islice(rows, CSV_ROWS_PER_BATCH)):
            yield some


def _cells(rows: list[pa.Array] | list[list[str]]) -> pa.ListArray:
    if isinstance(rows[0], list):
        return pa.array(rows, pa.list_(pa.string()))
    n, width = len(rows[0]), len(rows)
    by_row = np.arange(n * width).reshape(width, n).T.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, "int32")), pa.concat_arrays(rows).take(pa.array(by_row)))


def _n_rows(rows: list[pa.Array] | list[list[str]]) -> int:
    return len(rows) if isinstance(rows[0], list) else len(rows[0])


def _opener(path: str, content: pa.Scalar) -> Callable[[], BinaryIO]:
    """Opens a part's text; each call begins anew."""
    plain = lambda: pa.BufferReader(content.as_buffer())
    return (lambda: pa.CompressedInputStream(plain(), "gzip")) if path.endswith(".gz") else plain


def _sheet_file(path: str) -> str:
    return unquote(posixpath.basename(posixpath.dirname(path)).removeprefix("source_file="))


def read_sheet_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """Sheet CSVs (``{stem}_{sheet}.csv``, first row = header) -> sheet rows.

    Files of any size: Spark's text source splits them at line feeds, and the
    parity of the quotes before a line tells whether it begins a row
    (``csv_lines``).  Widths may differ per file and year -- every row is one
    ``cells`` array -- and the row position in the file is the ordinal.  A BOM is
    dropped, undecodable bytes become U+FFFD and truly blank lines are skipped
    (SURVEY Q14).  Quotes stand around whole fields and are doubled inside, as
    every CSV writer does; rows end in LF or CRLF.
    """
    return csv_lines.sheet_rows(spark, pattern, SHEET_ROWS_SCHEMA)


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            n = sum(map(_n_rows, _csv_columns(_opener(path, content), first_only=True)))
            yield pa.RecordBatch.from_pydict({"path": [path], "source_file": [_sheet_file(path)], "_part": [posixpath.basename(path)], "n": [n]})


def _parse_parts(heads: bool):
    """mapInArrow body: (path, content, rows before) -> sheet rows, or the first one alone."""
    arrow = to_arrow_schema(SHEET_ROWS_SCHEMA)

    def run(batches):
        for b in batches:
            for path, content, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                stem = _sheet_file(path)
                sheet = stem.rsplit("_", 1)[1] if "_" in stem else ""
                for rows in _csv_columns(_opener(path, content)):
                    cells = _cells(rows)[:1] if heads else _cells(rows)
                    n = len(cells)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(stem), n), pa.repeat(pa.scalar(sheet), n), pa.array(np.arange(at, at + n)), cells], schema=arrow)
                    at += n
                    if heads:
                        break

    return run


def read_sheet_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet rows from what ``write_sheet_csv`` wrote: a sheet file is a folder
    of part files in order; each part is parsed by a task of its own, and rows
    are numbered on from the parts before."""
    return read_parts_and_heads(spark, folder)[0]


def read_parts_and_heads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(sheet rows, header rows).  Parts are read twice: once their rows are counted,
    which gives each part its first row number; then they are parsed whenever the rows
    are used, and nothing but the counts is stored.  Header rows are in parts with
    nothing before them, the only ones read for these."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    n = stored(files.mapInArrow(_count_parts, "path string, source_file string, _part string, n long"), "part-rows").where("n > 0")
    before = Window.partitionBy("source_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # stored: its size is known, so the parts need not be shuffled to meet it
    offsets = stored(n.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "part-offsets")
    first = [r["path"] for r in offsets.where("before = 0").select("path").collect()]
    head_files = files.where(F.col("path").isin(first))
    return (files.join(offsets, "path").mapInArrow(_parse_parts(False), SHEET_ROWS_SCHEMA),
            head_files.withColumn("before", F.lit(0).cast("long")).mapInArrow(_parse_parts(True), SHEET_ROWS_SCHEMA))


_LINES = pa.schema([("source_file", pa.string()), ("row_ordinal", pa.int64()), ("line", pa.string())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: lines with the slice they belong to -> compressed blocks of
    lines of one slice."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in batches:
        b = b.take(pc.sort_indices(b, sort_keys=[("slice", "ascending")]))
        slices = b.column("slice").to_numpy()
        edges = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(slices)]
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            if at < to:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _LINES, options=options) as out:
                    out.write_batch(b[at:to].select(_LINES.names).cast(_LINES))
                yield pa.RecordBatch.from_arrays([pa.array(slices[at:at + 1]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "lines"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lines in b.column("lines"):
            yield from pa.ipc.open_stream(lines.as_buffer())


def write_sheet_csv(rows: DataFrame, out_dir: str, compression: str = "none") -> None:
    """K1: all-quoted CSV lines, one folder per sheet file, rows in order;
    ``compression="gzip"`` for files that are read back by ``read_sheet_parts``.

    Each part file is a contiguous, ordered slice, so no single task has to hold a
    whole sheet.  Slices are even shares of the places (file, row), known from the
    first and last row numbers of the files, so no pass over the cells is needed to
    find them.  Lines are shuffled in compressed blocks.
    """
    spark, text = rows.sparkSession, F.array_join("cells", '","', "")
    escaped = F.array_join(F.transform("cells", lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""'))), '","')
    quoted = F.concat(F.lit('"'), F.when(F.instr(F.array_join("cells", ",", ""), '"') > 0, escaped).otherwise(text), F.lit('"'))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = rows.groupBy("source_file").agg(F.min("row_ordinal").alias("_first"), (F.max("row_ordinal") - F.min("row_ordinal") + 1).alias("_span"))
    up_to = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    files = files.withColumn("_start", F.sum("_span").over(up_to) - F.col("_span") - F.col("_first")).withColumn("_all", F.sum("_span").over(Window.partitionBy()))
    placed = join_per_file(rows, files.select("source_file", "_start", "_all"))
    slice_ = F.floor((F.col("_start") + F.col("row_ordinal")) * n / F.col("_all")).cast("int")
    lines = placed.select(slice_.alias("slice"), "source_file", "row_ordinal", F.when(F.size("cells") > 0, quoted).otherwise("").alias("line"))
    blocks = lines.mapInArrow(_packed, "slice int, lines binary").repartitionById(n, F.col("slice"))
    in_order = blocks.mapInArrow(_unpacked, "source_file string, row_ordinal long, line string").sortWithinPartitions("source_file", "row_ordinal")
    with shuffles_released(spark):
        in_order.select("source_file", "line").write.mode("overwrite").option("compression", compression).partitionBy("source_file").text(out_dir)
