"""The regroup's cheap tests of cells decide as the plain ones do, and its stages get compiled."""
import csv
import gzip
import io
import os
from urllib.parse import unquote, urlparse

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheetwise.functions.regex import PY_SPACES, begins_visibly, strip_plain
from sheetwise.operators.reshape import is_blank, regroup_rows
from sheetwise.plans.tables import business_id
from sheetwise.sources.sheets import read_parts_and_heads, read_sheet_parts, write_sheet_csv

_EDGES = [*PY_SPACES, "", "a", "~", "!", "\x7f", "\x00", "​", "é", "再", "\U0001F600", "、", "　x"]


def test_cheap_tests_agree_with_python(spark):
    values = [a + m + b for a in _EDGES for m in ("", "x 再") for b in _EDGES] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(2)
    for v, blank, stripped, seen in df.select("v", is_blank(F.col("v")), strip_plain(F.col("v")), begins_visibly(F.col("v"))).collect():
        if v is None:
            assert blank and stripped is None and not seen
        else:
            assert (blank, stripped) == (v.strip() == "", v.strip()), repr(v)
            assert not seen or v[:1].strip()


def test_one_and_several_columns_of_an_item(spark):
    rows = spark.createDataFrame([("f", "s", 1, ["a", " ", None, "d"]), ("f", "s", 2, ["", "b", "c"]), ("f", "s", 3, ["", "", "　", ""])],
                                 "source_file string, sheet string, row_ordinal long, cells array<string>")
    parsed = spark.createDataFrame([("f", "k", "x", 0), ("f", "k", "x", 1), ("f", "k", "y", 3), ("f", "m", "x", 2)],
                                   "source_file string, key string, item string, col_idx int")
    got = lambda **kw: sorted(tuple(r)[1:] for r in regroup_rows(rows, parsed, ["key"], "item", ["x", "y", "z"], **kw).collect())
    assert got() == [(1, "k", "a", "d", None), (2, "k", "b", None, None), (2, "m", "c", None, None)]
    assert got(rule="first") == got()
    assert len(got(keep_empty=True)) == 6


def test_ids_of_any_width(spark):
    df = spark.createDataFrame([(2016, 1), (2016, 99_999), (2016, 100_000), (2016, 1_234_567)], "y int, n long")
    assert [r[0] for r in df.select(business_id(F.col("y"), F.col("n"))).collect()] == ["2016-00001", "2016-99999", "2016-100000", "2016-1234567"]


def test_methods_stay_within_what_hotspot_compiles(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_parts_meet_their_offsets_without_a_shuffle(spark, tmp_path):
    rows = spark.range(1, 50).selectExpr("'f_s' source_file", "'s' sheet", "id row_ordinal", "array(string(id)) cells")
    write_sheet_csv(rows, f"{tmp_path}/out")
    back = read_sheet_parts(spark, f"{tmp_path}/out")
    assert "Exchange hashpartitioning" not in back._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.row_ordinal, r.cells[0]) for r in back.collect()) == [(i - 1, str(i)) for i in range(1, 50)]


def _sheets(spark, n):
    """Two sheets out of order; quotes, separators, line breaks, empty and missing cells; rows of several widths."""
    odd = F.when(F.col("id") % 7 == 0, F.lit('a"b')).when(F.col("id") % 7 == 1, F.lit('","')).when(F.col("id") % 7 == 2, F.lit('x\r\n"\n')).when(F.col("id") % 7 == 3, F.lit("")).when(F.col("id") % 7 == 4, F.lit("語"))
    cells = F.array(F.col("id").cast("string"), odd, F.lit(""))
    cells = F.when((F.col("id") % 1000 == 999) & (F.col("id") % 2 == 0), F.array(odd)).otherwise(cells)
    rows = spark.range(n).withColumn("source_file", F.when(F.col("id") % 3 == 0, "database2016_T (2)").otherwise("database2015_S=%"))
    rows = rows.withColumn("row_ordinal", F.row_number().over(Window.partitionBy("source_file").orderBy("id")) - 1).withColumn("cells", cells)
    return rows.orderBy(F.xxhash64("id")).select("source_file", F.lit("S").alias("sheet"), "row_ordinal", "cells")


def test_sheets_are_written_in_order_and_read_as_they_were(spark, tmp_path):
    rows = _sheets(spark, 9000)
    want = {}
    for r in rows.orderBy("row_ordinal").collect():
        want.setdefault(r["source_file"], []).append([c or "" for c in r["cells"]])
    for compression, opened in (("none", open), ("gzip", gzip.open)):
        write_sheet_csv(rows, f"{tmp_path}/{compression}", compression)
        folders = [x for x in os.listdir(f"{tmp_path}/{compression}") if x.startswith("source_file=")]
        for folder in folders:
            parts = sorted(x for x in os.listdir(f"{tmp_path}/{compression}/{folder}") if x.startswith("part-"))
            text = b"".join(opened(f"{tmp_path}/{compression}/{folder}/{x}", "rb").read() for x in parts).decode()
            out = io.StringIO()
            csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(want[unquote(folder.removeprefix("source_file="))])
            assert text == out.getvalue()
        assert len(folders) == 2
        back, heads = read_parts_and_heads(spark, f"{tmp_path}/{compression}")
        got = {}
        for r in back.orderBy("row_ordinal").collect():
            assert r["row_ordinal"] == len(got.setdefault(r["source_file"], []))
            got[r["source_file"]].append(r["cells"])
        assert got == want
        assert {(r["source_file"], r["row_ordinal"], *r["cells"]) for r in heads.collect()} == {(f, 0, *x[0]) for f, x in want.items()}


def test_csv_parts_by_either_reader():
    import pyarrow as pa

    from sheetwise.sources import sheets as S
    cases = [[[""], ["a"], [""]], [["a", "b"], ["", "x\ny"], ['q"', '","'], ["NA", "null"], ["1", "\r\n"], ["\0", "﻿"]], [["a", "b"]] * 5 + [["c"]] + [["d", "e", "f"]] * 3,
             [["x" * 100, "y\n" * 10]] * 50000 + [["z"]], [], [["a", "b"], ["x" * (S.CSV_BLOCK_BYTES + 9), "y"], ["c", "d"]]]
    for rows in cases:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
        for path, data in (("p.txt", out.getvalue().encode()), ("p.txt.gz", gzip.compress(out.getvalue().encode()))):
            part = S._opener(path, pa.scalar(data, pa.binary()))
            assert [r for x in S._csv_columns(part) for r in S._cells(x).to_pylist()] == rows
            assert sum(map(S._n_rows, S._csv_columns(part, first_only=True))) == len(rows)
    part = S._opener("p.txt", pa.scalar(b'\xef\xbb\xbf"a","b"\n\n"\xff","c"\r\n', pa.binary()))
    assert [r for x in S._csv_columns(part) for r in S._cells(x).to_pylist()] == [["a", "b"], ["�", "c"]]


def test_a_round_trip_through_csv_leaves_little_on_disk(spark, tmp_path):
    """The sheets themselves, compressed, and the number of rows of the parts: no parsed rows, no shuffle files."""
    size = lambda top: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)
    cells = F.array(*[F.sha2((F.col("id") * 99 + k).cast("string"), 256) for k in range(9)])
    rows = spark.range(30000).select(F.lit("database2016_S").alias("source_file"), F.lit("S").alias("sheet"), F.col("id").alias("row_ordinal"), cells.alias("cells"))
    scratch = urlparse(spark.sparkContext.getCheckpointDir()).path
    shuffles = lambda: size(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before, kept = shuffles(), size(scratch)
    write_sheet_csv(rows, f"{tmp_path}/out", "gzip")
    back, _ = read_parts_and_heads(spark, f"{tmp_path}/out")
    assert back.count() == 30000
    assert shuffles() - before < 1 << 20 and size(scratch) - kept < 1 << 20
    assert size(f"{tmp_path}/out") < 30000 * 9 * 64 * 0.7
