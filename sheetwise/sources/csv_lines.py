"""Quoted CSV files of any size, cut at line feeds and put together by quotes.

Spark's text source splits a file into lines and reads its splits in parallel.
A line begins a CSV row exactly if the number of quotes before it in the file is
even.  A task does not know how many quotes the splits before its own hold, so it
notes for each line what follows from either parity; once the quotes of all
splits are counted, a running sum over the splits of a file (a small table) tells
which of the two holds, how many rows came before, and where a row that is open at
a split's edge began.

* a line that begins and ends a row is that row;
* the lines of a row with line feeds in its fields are gathered by the place where
  it begins -- only these are shuffled, and a row may run over any number of splits.

The lines are stored once in the shared folder, so both steps see the same splits
whatever becomes of the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.session import stored

#: Per line: place, its quotes' parity and that of the split's lines before it;
#: under an even (0) or odd (1) number of quotes before the split: the line where
#: its row begins (null: in an earlier split) and the rows that began before it.
LINES = "path string, block long, idx long, quotes int, before int, row_0 long, row_1 long, n_0 long, n_1 long, text string"
_NAMES = [x.split()[0] for x in LINES.split(", ")]


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, idx, before, row, n = None, 0, 0, [None, None], [0, 0]
    for batch in batches:
        out = [[] for _ in _NAMES]
        values = batch.column("value").to_pylist()
        for path, block, line in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), values, strict=True):
            if (path, block) != at:
                at, idx, before, row, n = (path, block), 0, 0, [None, None], [0, 0]
            if not block and not idx:
                line = line.removeprefix(b"\xef\xbb\xbf")
            quotes, blank, counted = line.count(b'"') & 1, line in (b"", b"\r"), list(n)
            for odd in (0, 1):
                if before == odd:  # an even number of quotes stands before: a row begins
                    row[odd] = idx
                    n[odd] += not blank
            for column, v in zip(out, (path, block, idx, quotes, before, *row, *counted, line.decode("utf-8", "replace")), strict=True):
                column.append(v)
            before, idx = before ^ quotes, idx + 1
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=_NAMES)


def _splits(lines: DataFrame) -> DataFrame:
    """Per split: the parity before it, rows before it, and where the row that is
    open at its beginning began."""
    blank = F.col("text").isin("", "\r")
    rows = lambda odd: F.sum(F.when((F.col("before") == odd) & ~blank, 1).otherwise(0)).alias(f"rows_{odd}")
    each = lines.groupBy("path", "block").agg((F.sum("quotes") % 2).alias("quotes"), rows(0), rows(1), F.max("row_0").alias("last_0"), F.max("row_1").alias("last_1"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("odd", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).cast("int"))
    of = lambda name: F.when(F.col("odd") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))
    begun = F.when(of("last").isNotNull(), F.struct(F.col("block").alias("b"), of("last").alias("i")))
    return each.select("path", "block", "odd", F.coalesce(F.sum(of("rows")).over(earlier), F.lit(0)).alias("rows_before"), F.last(begun, ignorenulls=True).over(earlier).alias("open"))


def _name(path: str) -> tuple[str, str]:
    """(stem, sheet) of a sheet file's path."""
    import posixpath
    from urllib.parse import unquote
    name = posixpath.basename(unquote(path))
    stem = name[:-4] if name.lower().endswith(".csv") else name
    return stem, stem.rsplit("_", 1)[1] if "_" in stem else ""


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import csv
    import io
    csv.field_size_limit(1 << 30)
    for pdf in batches:
        names = {p: _name(p) for p in pdf["path"].unique()}
        out = []
        for path, ordinal, text in zip(pdf["path"], pdf["row_ordinal"], pdf["text"], strict=True):
            rows = list(csv.reader(io.StringIO(text, newline="")))
            if len(rows) != 1:
                raise ValueError(f"{path}, row {ordinal}: rows must end in LF or CRLF")
            out.append((*names[path], ordinal, rows[0]))
        yield pd.DataFrame(out, columns=["source_file", "sheet", "row_ordinal", "cells"])


def numbered_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, row_ordinal, text): the CSV rows of every file, from 0."""
    raw = spark.read.option("lineSep", "\n").text(pattern).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    lines = stored(raw.mapInArrow(_noted, LINES), "csv-lines")
    d = lines.join(stored(_splits(lines), "csv-splits"), ["path", "block"])
    of = lambda name: F.when(F.col("odd") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))
    begins = F.col("before") == F.col("odd")
    ends = (F.col("before") + F.col("quotes")) % 2 == F.col("odd")
    d = d.withColumn("row_ordinal", F.col("rows_before") + of("n"))
    whole = d.where(begins & ends & ~F.col("text").isin("", "\r")).select("path", "row_ordinal", "text")
    parts = d.where(~(begins & ends)).withColumn("at", F.when(of("row").isNotNull(), F.struct(F.col("block").alias("b"), of("row").alias("i"))).otherwise(F.col("open")))
    lists = parts.groupBy("path", "at").agg(F.min(F.when(begins, F.col("row_ordinal"))).alias("row_ordinal"), F.sort_array(F.collect_list(F.struct("block", "idx", "text"))).alias("l"))
    return whole.unionByName(lists.select("path", "row_ordinal", F.array_join(F.col("l.text"), "\n").alias("text")))


def sheet_rows(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    return numbered_rows(spark, pattern).mapInPandas(_parsed, schema)
