"""Sheet CSV ingest, the row ordinal, the run log, sinks and the stage job."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import catalog as C
from sheetwise.operators import runs as R
from sheetwise.operators.ordinal import dense_ordinal
from sheetwise.plans.job import run_job
from sheetwise.sinks.writers import selective_quote_lines, write_csv
from sheetwise.sinks import versions
from sheetwise.sources.sheets import read_sheet_csv, read_sheet_parts, write_sheet_csv


def _tmp():
    return tempfile.mkdtemp(prefix="sheetwise-test-")


def test_read_sheet_csv_bom_quotes_multiline(spark):
    d = _tmp()
    with open(os.path.join(d, "database2016_S.csv"), "w", encoding="utf-8-sig") as f:
        f.write('"府省庁","事業名","事業番号-1"\n"総務省","a, b","1"\n"財務省","line1\nline2","2"\n')
    with open(os.path.join(d, "database2015_T.csv"), "w", encoding="utf-8") as f:
        f.write('"府省庁","事業名","事業番号-1","x"\n"総務省","c","3","y"\n')
    rows = read_sheet_csv(spark, d + "/*.csv").orderBy("source_file", "row_ordinal").collect()
    s = [r for r in rows if r["source_file"] == "database2016_S"]
    assert [r["row_ordinal"] for r in s] == [0, 1, 2]
    assert s[0]["cells"] == ["府省庁", "事業名", "事業番号-1"]  # BOM dropped
    assert s[1]["cells"][1] == "a, b" and s[2]["cells"][1] == "line1\nline2"
    t = [r for r in rows if r["source_file"] == "database2015_T"]
    assert len(t[0]["cells"]) == 4 and t[0]["sheet"] == "T"


def test_write_sheet_csv_round_trip(spark):
    d = _tmp()
    df = spark.createDataFrame([("f_S", "S", 0, ["a", 'q"x']), ("f_S", "S", 1, ["1", "2"])],
                               "source_file string, sheet string, row_ordinal int, cells array<string>")
    write_sheet_csv(df, d + "/out")
    lines = [r[0] for r in spark.read.text(d + "/out/source_file=f_S").collect()]
    assert lines == ['"a","q""x"', '"1","2"']
    back = read_sheet_parts(spark, d + "/out").orderBy("row_ordinal").collect()
    assert [(r["source_file"], r["sheet"], r["row_ordinal"], r["cells"]) for r in back] == [("f_S", "S", 0, ["a", 'q"x']), ("f_S", "S", 1, ["1", "2"])]


def test_header_repeats_pass_over_taken_names(spark):
    from sheetwise.sources.sheets import sheet_headers
    d = spark.createDataFrame([("f_S", "S", 0, ["a", "a", "a.1", "", "a", "b", "b"])], "source_file string, sheet string, row_ordinal long, cells array<string>")
    assert [r["name"] for r in sheet_headers(d).orderBy("col_idx").collect()] == ["a", "a.2", "a.1", "Unnamed: 3", "a.3", "b", "b.1"]


def test_budgets_of_copied_sheets(spark):
    """The copy "X (2).csv" sorts before "X.csv", so the original wins."""
    from sheetwise.plans import tables as TB
    head = ["府省庁", "事業名", "事業番号-1", "予算額-2016年度予算の状況当初予算"]
    rows = [(f, "S", i, c) for f, v in (("database2016_S", "1"), ("database2016_S (2)", "2")) for i, c in enumerate([head, ["総務省", "p", "1", v]])]
    d = spark.createDataFrame(rows, "source_file string, sheet string, row_ordinal long, cells array<string>")
    assert [r["予算の状況当初予算"] for r in TB.budgets(d).collect()] == ["1"]


def test_listed_workbooks_are_replaced_and_others_stay(spark):
    d = _tmp()
    head = ["府省庁", "事業名", "事業番号-1"]

    def book(name, project):
        return spark.createDataFrame([(f"{name}_S", "S", 0, head, f"{name}.xlsx"), (f"{name}_S", "S", 1, ["総務省", project, "1"], f"{name}.xlsx")],
                                     "source_file string, sheet string, row_ordinal long, cells array<string>, workbook string")

    run_job(spark, d, book("database2016", "a").unionByName(book("database2017", "b")))
    run_job(spark, d, book("database2016", "c").unionByName(book("database2017", "x")), target_files=["database2016.xlsx"])
    assert sorted(r["事業名"] for r in versions.read_set(spark, d + "/tables")["business"].collect()) == ["b", "c"]


def test_long_sequences_do_not_stop_the_job(spark):
    from sheetwise.plans.tables import sequence_number
    d = spark.createDataFrame([("3000000000",), ("1" * 30,), ("x",)], "s string")
    assert [r[0] for r in d.select(sequence_number(F.col("s"))).collect()] == [3000000000, None, None]


def test_dense_ordinal_matches_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") % 3).cast("string").alias("f"), (F.col("id") * 7 % 5003).alias("k"))
    got = dense_ordinal(df.repartition(7), "f", ["k"], num_partitions=5)
    want = df.withColumn("row_ordinal", F.row_number().over(Window.partitionBy("f").orderBy("k")))
    assert sorted(map(tuple, got.select("f", "k", "row_ordinal").collect())) == \
        sorted(map(tuple, want.select("f", "k", "row_ordinal").collect()))


def test_run_log_fold_delete_stats_import_export(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    ex = spark.createDataFrame([
        (1, 1, t0, "q1", "select 1", "success", json.dumps({"columns": ["a"], "data": [[1], [2]]}), 5, 1),
        (1, 2, t0 + dt.timedelta(seconds=5), "q1b", "select 2", "error", json.dumps({"error": "boom"}), 7, 1),
        (2, 3, t0 + dt.timedelta(seconds=1), "q2", "select 3", "success", json.dumps({"columns": [], "data": []}), 1, None),
    ], R.EXECUTION_SCHEMA)
    folded = R.fold_reruns(ex)
    one = folded.where("id = 1").collect()[0]
    assert one["execution_count"] == 2 and one["sql_query"] == "select 2" and one["status"] == "error"
    assert [r["id"] for r in R.latest_runs(folded).collect()] == [1, 2]
    assert [r["id"] for r in R.delete_runs(folded, spark.createDataFrame([(1,)], "id long")).collect()] == [2]
    stats = {r["id"]: r for r in R.run_stats(folded).collect()}
    assert stats[1]["error"] == "boom" and stats[2]["row_count"] == 0
    d = _tmp()
    path = os.path.join(d, "runs.json")
    with open(path, "w") as f:
        json.dump([{"id": 5, "question": "q", "sql_query": "s", "status": "success", "result_json": "{}",
                    "duration_ms": 3}], f)
    imp = R.read_run_log(spark, path).collect()
    assert imp[0]["execution_count"] == 1 and imp[0]["id"] == 5
    R.export_runs(folded.repartition(3), d + "/export")
    back = R.read_run_log(spark, d + "/export")
    assert sorted(map(tuple, back.select(*folded.columns).collect())) == sorted(map(tuple, folded.collect()))
    # an imported record stands for its count: a later rerun adds one
    again = spark.createDataFrame([(1, 9, t0 + dt.timedelta(days=1), "q1c", "select 9", "success", "{}", 2, 1)], R.EXECUTION_SCHEMA)
    refolded = {r["id"]: r for r in R.fold_reruns(R.append_run(R.as_executions(back), again)).collect()}
    assert refolded[1]["execution_count"] == 3 and refolded[1]["sql_query"] == "select 9" and refolded[2]["execution_count"] == 1
    assert [r["id"] for r in R.missing_ids(folded, spark.createDataFrame([(1,), (7,)], "id long")).collect()] == [7]
    assert [(r["id"], r["row_count"], r["error"]) for r in R.run_history(folded, 1).collect()] == [(1, None, "boom")]
    with open(d + "/notalist.json", "w") as f:
        f.write(' {"id": 5}')
    with pytest.raises(ValueError):
        R.import_runs(spark, d + "/notalist.json", ex)


def _runs(spark, rows):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, s, None if t is None else t0 + dt.timedelta(seconds=t), q, f"sql {q}", "success", "{}", 1, n) for i, s, t, q, n in rows], R.EXECUTION_SCHEMA)


def test_fold_gives_one_row_per_id_on_ties(spark):
    ex = _runs(spark, [(1, 0, 5, "a", 2), (1, 0, 5, "b", 2), (1, 0, 5, "b", 2), (2, 0, None, "c", None), (2, 0, None, "c", 3), (None, 1, 1, "d", 1)])
    got = {r["id"]: (r["question"], r["execution_count"]) for r in R.fold_reruns(ex).collect()}
    assert got == {1: ("b", 6), 2: ("c", 4), None: ("d", 1)}
    assert R.fold_reruns(ex).count() == 3


def test_imported_records_get_new_ids(spark):
    d = _tmp()
    ex = _runs(spark, [(3, 1, 1, "a", 1), (3, 2, 2, "b", 1), (7, 3, 3, "c", 1), (12, 4, 1, "deleted", 1)])
    R.export_runs(R.delete_runs(R.fold_reruns(ex), spark.createDataFrame([(12,)], "id long")).repartition(2), d + "/log")
    log = ex
    for _ in range(2):
        log = R.append_run(log, R.import_runs(spark, d + "/log", log))
    got = [(r["id"], r["question"], r["execution_count"]) for r in R.fold_reruns(log).orderBy("id").collect()]
    # ids of deleted entries are not given again
    assert got == [(3, "b", 2), (7, "c", 1), (12, "deleted", 1), (13, "b", 2), (14, "c", 1), (15, "b", 2), (16, "c", 1)]
    with open(d + "/empty.json", "w") as f:
        f.write("[]")
    assert R.import_runs(spark, d + "/empty.json", ex).count() == 0
    assert [r["history_id"] for r in R.import_runs(spark, d + "/log", ex.limit(0)).orderBy("history_id").collect()] == [1, 2]


def test_large_import_is_numbered_in_order(spark):
    d = _tmp()
    with open(d + "/many.json", "w") as f:
        json.dump([{"question": f"q{i}", "sql_query": "s", "status": "success", "duration_ms": i} for i in range(5000)], f)
    got = R.import_runs(spark, d + "/many.json", _runs(spark, [(100, 0, 0, "x", 1)]))
    assert [(r["history_id"], r["duration_ms"]) for r in got.orderBy("history_id").collect()] == [(101 + i, i) for i in range(5000)]


def test_deletes_count_in_the_order_of_events(spark):
    import datetime as dt
    ex = _runs(spark, [(1, 1, 1, "a", 1), (1, 5, 5, "rerun after its delete", 1), (2, 2, 2, "b", 1), (2, 6, 6, "b2", 1), (3, 9, 9, "after all were deleted", 1), (4, 3, 3, "cleared", 1), (4, 8, 8, "rerun", 1), (5, 7, 7, "e", 1)])
    t0 = dt.datetime(2024, 1, 1)
    deletes = lambda rows: spark.createDataFrame([(i, t0 + dt.timedelta(seconds=t), s) for i, t, s in rows], R.DELETE_SCHEMA)
    ids = lambda rows: sorted(r["id"] for r in R.fold_log(ex, deletes(rows)).collect())
    assert ids([]) == [1, 2, 3, 4, 5]
    assert ids([(1, 3, 3), (2, 1, 1), (99, 4, 4)]) == [2, 3, 4, 5]  # 2 did not exist yet
    assert ids([(None, 4, 4)]) == [3, 5]
    assert ids([(None, 4, 4), (5, 7, 7), (3, 8, 8)]) == [3]  # at one position the run comes first
    got = {r["id"]: r for r in R.fold_log(ex, deletes([(1, 3, 3)])).collect()}
    assert got[2]["execution_count"] == 2 and got[2]["question"] == "b2"


def test_selective_quote_and_csv(spark):
    df = spark.createDataFrame([("2016-00001", 2016, 'a"b'), ("2016-00002", None, None)], "business_id string, y long, n string")
    lines = [r[0] for r in selective_quote_lines(df, ["business_id", "y"]).collect()]
    assert lines == ['2016-00001,2016,"a""b"', '2016-00002,,""']
    d = _tmp()
    write_csv(spark.createDataFrame([("  lead and trail  ", "")], "v string, e string"), d + "/spaces")
    assert spark.read.text(d + "/spaces").where("value <> 'v,e'").first()[0] == "  lead and trail  ,"
    write_csv(df, d + "/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(d + "/csv").orderBy("business_id").collect()
    assert back[0]["n"] == 'a"b'


def test_catalog_infer_and_markdown(spark):
    df = spark.createDataFrame([("1", "1.5", "x", None), (" 2 ", "inf", "3", None)], "a string, b string, c string, d string")
    t = {r["column_name"]: r["inferred_type"] for r in C.infer_types(df, "t").collect()}
    assert t == {"a": "BIGINT", "b": "DOUBLE", "c": "VARCHAR", "d": "VARCHAR"}
    md = C.schema_markdown(C.describe_tables(spark, {"t": df})).collect()[0]["markdown"]
    assert md == ("# データベーススキーマ\n**テーブル一覧:** `t`\n\n## テーブル: `t`\n\n| カラム名 | データ型 |\n|---|---|\n"
                  "| `a` | `VARCHAR` |\n| `b` | `VARCHAR` |\n| `c` | `VARCHAR` |\n| `d` | `VARCHAR` |\n\n")
    asked = spark.createDataFrame([("say {{schema}}.",), ("nothing",), (None,)], "template string")
    assert [r[0] for r in C.prompt(asked, C.schema_markdown(C.describe_tables(spark, {"t": df}))).collect()] == [f"say {md}.", "nothing", None]


def test_run_job_stages(spark):
    d = _tmp()
    header = ["府省庁", "事業名", "事業番号-1", "費目・使途-A.支払先費目-1", "予算額-2016年度予算の状況当初予算"]
    rows = spark.createDataFrame([("database2016_S", "S", 0, header), ("database2016_S", "S", 1, ["総務省", "Ｐ１", "1", "委託", "10"])],
                                 "source_file string, sheet string, row_ordinal int, cells array<string>")
    m = {r["table_name"]: r["row_count"] for r in run_job(spark, d, rows).collect()}
    assert m == {"ministries": 24, "business": 1, "budgets": 1, "fund_flow": 1, "expenditure": 0}
    b = versions.read_set(spark, d + "/tables")["business"].collect()[0]
    assert b["事業名"] == "P1"  # normalized (NFKC) before building
    again = {r["table_name"]: r["row_count"] for r in run_job(spark, d, start_stage=7).collect()}
    assert again == m
    # a rerun from stage 5 whose fund-flow result is empty keeps the older table (Q12)
    empty = spark.createDataFrame([("database2016_S", "S", 0, ["府省庁", "事業名", "事業番号-1"])],
                                  "source_file string, sheet string, row_ordinal int, cells array<string>")
    run_job(spark, d, empty, start_stage=1)
    kept = {r["table_name"]: r["row_count"] for r in run_job(spark, d, start_stage=5).collect()}
    assert kept["fund_flow"] == 1


def test_melt(spark):
    from sheetwise.operators.reshape import melt
    df = spark.createDataFrame([("b1", "x", None), ("b2", None, "y")], "business_id string, c1 string, c2 string")
    got = sorted(tuple(r) for r in melt(df, ["business_id"], ["c1", "c2"]).collect())
    assert got == [("b1", "c1", "x"), ("b2", "c2", "y")]


def test_nan_to_null_and_safe_double(spark):
    from sheetwise.functions.casts import nan_to_null, safe_double
    df = spark.createDataFrame([("1", float("nan")), ("1d", 2.0), ("1_000", 3.0), (" 12 ", 4.0), ("nan", 5.0)], "s string, d double")
    got = nan_to_null(df.select(safe_double(F.col("s")).alias("v"), "d")).collect()
    assert [r["v"] for r in got] == [1.0, None, None, 12.0, None]
    assert got[0]["d"] is None


def test_register_list_tables_and_item_list(spark):
    from sheetwise.sinks.writers import write_item_list
    a = spark.createDataFrame([("支出額",), ("入札者数",), ("支出額",)], "item string")
    names = C.register_tables(spark, {"items_view": a})
    assert names == ["items_view"] and "items_view" in C.list_tables(spark)
    assert spark.sql("SELECT count(*) AS n FROM items_view").collect()[0]["n"] == 3
    assert C.column_present(a, "item") and not C.column_present(a, "x")
    d = _tmp()
    write_item_list(a, d + "/items")
    lines = [r[0] for r in spark.read.text(d + "/items").collect()]
    assert sorted(lines) == lines == sorted({"支出額", "入札者数"})


def test_read_sheet_csv_ragged_and_blank_lines(spark):
    d = _tmp()
    with open(os.path.join(d, "database2017_R.csv"), "w", encoding="utf-8") as f:
        f.write('"a","b","c"\n\n"1","2"\n"x","y","z","w"\n')
    rows = read_sheet_csv(spark, d + "/*.csv").orderBy("row_ordinal").collect()
    assert [r["row_ordinal"] for r in rows] == [0, 1, 2]
    assert rows[1]["cells"] == ["1", "2"] and rows[2]["cells"] == ["x", "y", "z", "w"]


def test_dense_ordinal_hot_file_and_ties(spark):
    """One file holds a third of all rows (spread over several range
    partitions); duplicate full keys get distinct, dense ordinals."""
    from pyspark.sql import Window
    hot = spark.range(0, 4000).select(F.lit("hot").alias("f"), (F.col("id") % 1500).alias("k"))
    cold = spark.range(0, 8000).select((F.col("id") % 40).cast("string").alias("f"), F.col("id").alias("k"))
    df = hot.unionByName(cold)
    got = dense_ordinal(df, "f", ["k"], num_partitions=9)
    per_file = got.groupBy("f").agg(F.min("row_ordinal").alias("lo"), F.max("row_ordinal").alias("hi"),
                                    F.count(F.lit(1)).alias("n"), F.countDistinct("row_ordinal").alias("d"))
    assert per_file.where("lo != 1 OR hi != n OR d != n").count() == 0
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy("k")))
    # equal keys are interchangeable: compare (file, key, ordinal) multisets
    assert sorted(map(tuple, got.select("f", "k", "row_ordinal").collect())) == \
        sorted(map(tuple, want.select("f", "k", "r").collect()))


def test_read_sheet_csv_short_rows_are_blank_not_nan(spark):
    d = _tmp()
    with open(os.path.join(d, "database2018_220427_S.csv"), "w", encoding="utf-8") as f:
        f.write('"a","b","c"\n"1","2"\n')
    rows = read_sheet_csv(spark, d + "/*.csv").orderBy("row_ordinal").collect()
    assert rows[1]["cells"][:2] == ["1", "2"] and all(c == "" for c in rows[1]["cells"][2:])


def test_concat_tables(spark):
    from sheetwise.operators.reshape import concat_tables
    a = spark.createDataFrame([("1", "x")], "id string, a string")
    b = spark.createDataFrame([("2", "y")], "id string, b string")
    got = {r["id"]: (r["a"], r["b"]) for r in concat_tables([a, b]).collect()}
    assert got == {"1": ("x", None), "2": (None, "y")}


def test_write_selective_quoted_parts_have_header(spark):
    import glob
    from sheetwise.sinks.writers import write_selective_quoted
    df = spark.createDataFrame([(f"2016-{i:05d}", i, f'n"{i}') for i in range(10)], "business_id string, y long, n string")
    d = _tmp()
    write_selective_quoted(df.repartition(3), d + "/k3", ["business_id", "y"])
    lines = []
    for part in sorted(glob.glob(d + "/k3/part-*")):
        with open(part, encoding="utf-8") as f:
            got = f.read().splitlines()
        assert got[0] == "business_id,y,n"
        lines += got[1:]
    assert sorted(lines) == sorted(f'2016-{i:05d},{i},"n""{i}"' for i in range(10))
