"""Features made for size: header names, CSV ranges, published sets, paging by key, hot files, budgets."""

import csv
import io
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from explain_plans import plan_counts
from sheetwise.operators import analytics as A
from sheetwise.operators.matrix import header_matrix, header_presence
from sheetwise.plans import tables as TB
from sheetwise.session import join_per_file
from sheetwise.sinks import versions
from sheetwise.sources.derived import orders_workbook
from sheetwise.sources.sheets import read_sheet_csv, sheet_headers


def _tmp():
    return tempfile.mkdtemp(prefix="sheetwise-scale-")


# --- S6 ------------------------------------------------------------------------------

def heads(spark, files):
    return spark.createDataFrame([(f, "S", 0, names) for f, names in files.items()], "source_file string, sheet string, row_ordinal int, cells array<string>")


def plain_names(names):
    base = [n if n else f"Unnamed: {i}" for i, n in enumerate(names)]
    taken, seen, out = set(base), {}, []
    for b in base:
        k = seen[b] = seen.get(b, -1) + 1
        n, left = 0, k
        while left:
            n += 1
            left -= f"{b}.{n}" not in taken
        out.append(b if not k else f"{b}.{n}")
    return out


def test_header_names_pass_over_taken_numbers(spark):
    r = random.Random(1)
    files = {"a": ["x", "x", "x.1", "x", "x.3", "x.3", "x"], "b": ["", "", None, "Unnamed: 1"], "c": ["y.01", "y", "y", "y.1.1", "y.1", "y.1", "y\n.2", "y"],
             "d": [], "e": [r.choice(["p", "q", "p.1", "p.2", "p.5", "q.1", "q.1.1", "p.2.1", "p.99999999999999999999"]) for _ in range(200)]}
    got = {f: {} for f in files}
    for x in sheet_headers(heads(spark, files)).collect():
        got[x["source_file"]][x["col_idx"]] = x["name"]
    for f, names in files.items():
        assert [got[f][i] for i in range(len(names))] == plain_names(names), f


def test_wide_headers_take_linear_time(spark):
    def seconds(n):
        names = ["same"] * (n // 2) + [f"same.{2 * i + 1}" for i in range(n // 4)] + [f"other {i}" for i in range(n // 4)]
        df = sheet_headers(heads(spark, {"wide": names}))
        df.collect()
        start = time.time()
        assert len({x["name"] for x in df.collect()}) == len(names)
        return time.time() - start
    seconds(1000)
    small, large = seconds(4000), seconds(12000)
    assert large < 4 * small + 2


# --- S4 ------------------------------------------------------------------------------

def csv_text(rows, end="\r\n", bom=False):
    out = io.StringIO(newline="")
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end).writerows(rows)
    return ("﻿" if bom else "") + out.getvalue()


@pytest.mark.parametrize("size", ["600b", "64m"])
def test_csv_ranges_equal_one_reader(spark, size):
    r = random.Random(3)
    pieces = ["plain", "", " ", 'say "hi"', "two\nlines", "\n\n", 'a","b', "cr\r\nlf", '"', '""\n""', "漢字\n\"仮名\"", "\n" * 20, "x" * 700]
    d = _tmp()
    files = {}
    for name, end, bom in (("database2016_S", "\r\n", True), ("database2016_T", "\n", False), ("one_row", "\n", False)):
        rows = [["h1", "h2", "h3"]] + ([] if name == "one_row" else [[r.choice(pieces) for _ in range(r.randint(1, 4))] for _ in range(40)])
        text = csv_text(rows, end, bom)
        if name == "database2016_T":
            text = text.replace(end, end + "\n", 1) + "\n\n"  # blank lines, also at the end
        files[name] = [x for x in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if x]
        with open(os.path.join(d, name + ".csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        got = {}
        for x in read_sheet_csv(spark, d + "/*.csv").collect():
            got.setdefault(x["source_file"], {})[x["row_ordinal"]] = x["cells"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {n: dict(enumerate(rows)) for n, rows in files.items()}


def test_csv_undecodable_and_empty(spark):
    d = _tmp()
    with open(d + "/a_b.csv", "wb") as f:
        f.write(b'"x\xff\xfey","z"\n')
    open(d + "/empty_c.csv", "w").close()
    assert [(x["source_file"], x["sheet"], x["row_ordinal"], x["cells"]) for x in read_sheet_csv(spark, d + "/*.csv").collect()] == [("a_b", "b", 0, ["x��y", "z"])]


# --- K7 ------------------------------------------------------------------------------

def test_published_sets_change_at_once(spark):
    d = _tmp() + "/tables"
    assert versions.current(spark, d) == {} and versions.manifest(spark, d).count() == 0
    a, b = spark.range(5), spark.range(7).toDF("k")
    assert versions.write_set({"a": a, "b": b}, d) == {"a": 5, "b": 7}
    old = versions.read_set(spark, d)
    # a failed build leaves the set as it was
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.write_set({"a": spark.range(1), "b": broken}, d)
    assert {x["table_name"]: x["row_count"] for x in versions.manifest(spark, d).collect()} == {"a": 5, "b": 7}
    # an empty table replaces the older one, or leaves it, as asked; the table read may be the one replaced
    assert versions.write_set({"a": old["a"].where("id < 0")}, d, keep_if_empty=True) == {"a": 0}
    assert versions.read_set(spark, d)["a"].count() == 5
    versions.write_set({"a": versions.read_set(spark, d)["a"].where("id > 2"), "new": spark.range(0)}, d, keep_if_empty=True)
    assert {x["table_name"]: x["row_count"] for x in versions.manifest(spark, d).collect()} == {"a": 2, "b": 7, "new": 0}
    assert old["a"].count() == 5  # a reader of the old set is not disturbed
    versions.drop_old(spark, d, keep=1)
    assert {t: x.count() for t, x in versions.read_set(spark, d).items()} == {"a": 2, "b": 7, "new": 0}
    assert len(os.listdir(d + "/data")) == 2  # of b, and of a and new
    assert len([n for n in os.listdir(d + "/pointers") if n.endswith(".json") and not n.startswith(".")]) == 1


def test_a_taken_pointer_is_not_overwritten(spark, monkeypatch):
    d = _tmp() + "/tables"
    versions.write_set({"a": spark.range(1)}, d)
    seen, stale = versions._pointers, [True]

    def behind(spark, folder):  # another writer publishes between the look and the rename
        names = seen(spark, folder)
        if stale and folder == d and stale.pop():
            versions._point(spark, d, {"b": {"path": "data/x/b", "rows": 2}})
        return names

    monkeypatch.setattr(versions, "_pointers", behind)
    versions._point(spark, d, {"c": {"path": "data/y/c", "rows": 3}})
    assert {t: v["rows"] for t, v in versions.current(spark, d).items()} == {"a": 1, "b": 2, "c": 3}


# --- T5 ------------------------------------------------------------------------------

@pytest.mark.parametrize("descending", [True, False])
def test_pages_by_key_are_the_pages_by_number(spark, descending):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 2]), r.choice([None, "a", "b"]), r.choice([None, 0.5])) for _ in range(60)]
    df = spark.createDataFrame(rows, "n int, s string, d double")
    end, page = None, 0
    while True:
        got = A.browse_after(df, sort_by="s", descending=descending, after=end, page_size=7).collect()
        assert [tuple(x) for x in got] == [tuple(x) for x in A.browse(df, sort_by="s", descending=descending, page=page, page_size=7).collect()]
        if not got:
            break
        end, page = A.page_end(got, end), page + 1
    assert page == 9 and A.page_end([]) is None


# --- U7 ------------------------------------------------------------------------------

def test_matrix_over_many_files(spark):
    r = random.Random(5)
    files = {f"f{i:03d}": [n for n in ("支出先上位", "予算額", "支出先・費目", "別") if r.random() < 0.4] + ["x"] for i in range(150)}
    h = sheet_headers(heads(spark, files))
    m = header_matrix(h)
    have = {(x["column_name"], x["source_file"]) for x in header_presence(h).collect()}
    assert m.columns == ["column_name", *sorted(files)]
    got = {(x["column_name"], f) for x in m.collect() for f in files if x[f]}
    assert got == have and have
    some = header_matrix(h, ["f003", "missing"])
    assert some.columns == ["column_name", "f003", "missing"] and {x["missing"] for x in some.collect()} == {0}


# --- J6 ------------------------------------------------------------------------------

def test_a_hot_file_is_split(spark):
    rows = spark.range(60000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("f"), (F.col("id") % 50).cast("string"))).alias("source_file"),
                                     F.col("id").alias("row_ordinal"), F.array_repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("cells")).repartition(8)
    per_file = rows.select("source_file").distinct().withColumn("width", F.length("source_file"))
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        d = _tmp() + "/joined"
        join_per_file(rows, per_file).write.parquet(d)  # a task writes a file
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    joined = spark.read.parquet(d)
    assert joined.where(F.col("width") == F.length("source_file")).count() == 60000
    assert joined.where("source_file = 'hot'").groupBy("_metadata.file_path").count().agg(F.max("count")).first()[0] <= 20000 / 4


# --- U5 ------------------------------------------------------------------------------

def test_budgets_shuffle_once_and_sort_nothing(spark, sf_dir):
    rows, hd = orders_workbook(spark, sf_dir)
    df = TB.budgets(rows, header_rows=hd)
    df.write.format("noop").mode("overwrite").save()
    c = plan_counts(df)
    assert c["shuffles"] <= 1, c
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "SortMergeJoin" not in text and "Sort [" not in text.split("Initial Plan")[0]
    # one review file a year: no shuffle at all
    single = rows.where(F.col("source_file").contains("review_a") & ~F.col("source_file").contains("220427"))
    df = TB.budgets(single, drop_absent=False, header_rows=hd.where(F.col("source_file").contains("review_a") & ~F.col("source_file").contains("220427")))
    df.write.format("noop").mode("overwrite").save()
    assert plan_counts(df)["shuffles"] == 0


def test_budgets_of_some_ids_and_columns(spark, sf_dir):
    rows, hd = orders_workbook(spark, sf_dir)
    whole = TB.budgets(rows, header_rows=hd)
    column = "予算の状況当初予算"
    want = {x["business_id"]: x[column] for x in whole.collect()}
    ids = spark.createDataFrame([(k,) for k in sorted(want)[::7]] + [("none",)], "business_id string")
    part = TB.budgets(rows, drop_absent=False, header_rows=hd, columns=[column], only=ids)
    assert part.columns == ["business_id", column]
    assert {x["business_id"]: x[column] for x in part.collect()} == {k: want[k] for k in sorted(want)[::7]}
    empty = TB.budgets(rows.limit(0), header_rows=hd.limit(0))
    assert empty.columns == ["business_id"] and empty.count() == 0
