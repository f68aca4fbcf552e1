"""Worked sheet and header cases (FIXTURES.md sections 3 and 4)."""

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import headers as H
from sheetwise.plans import tables as TB
from sheetwise.sources.sheets import sheet_headers

FF = ["府省庁", "事業名", "事業番号-1", "費目・使途-A.支払先費目-1", "費目・使途-A.支払先金額(百万円)-1",
      "費目・使途-A.支払先計", "費目・使途-B.支払先計"]


def sheet(spark, file, header, rows):
    data = [(file, "S", 0, header)] + [(file, "S", i + 1, r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "source_file string, sheet string, row_ordinal int, cells array<string>")


@pytest.fixture(scope="module")
def review_sheet(spark):
    rows = [["総務省", "P1", "1", " 委託 ", "12", "12", "0"],
            ["原子力規制員会", "P2", "2", "", "", "", ""],
            ["不明省", "P3", "3", "", "", "", ""]]
    return sheet(spark, "database2016_S", FF, rows)


def test_fund_flow_sheet_case(review_sheet):
    got = sorted((tuple(r) for r in TB.fund_flow(review_sheet).collect()), key=repr)
    assert got == sorted([("2016-00001", "A", 1, "委託", "", "12", ""),
                          ("2016-00001", "A", None, "", "", "", "12")], key=repr)


def test_business_sheet_case(review_sheet):
    got = {r["business_id"]: r for r in TB.business(review_sheet).collect()}
    assert got["2016-00001"]["ministry_id"] == 13
    assert got["2016-00002"]["ministry_id"] == 23 and got["2016-00002"]["府省庁"] == "原子力規制員会"
    assert got["2016-00003"]["ministry_id"] is None
    assert got["2016-00001"]["source_year"] == 2016


def test_gate(spark):
    def gate(header):
        df = sheet(spark, "database2016_X", header, [["a"] * len(header)])
        return H.review_sheet_gate(sheet_headers(df)).collect()[0]["is_review_sheet"]
    assert gate(["府省庁", "事業名", "事業番号-1"])
    assert not gate(["府省庁", "事業名"])
    assert not gate(["府省庁", "事業名", "事業番号-1", "セグメント名"])
    assert gate(["府省 庁", "事業\n名", "事業番号"])  # cleaned names count


def test_unknown_year_file_is_skipped(spark):
    df = sheet(spark, "database2030_S", FF, [["総務省", "P1", "1", "x", "1", "1", "1"]])
    assert TB.business(df).count() == 0 and TB.fund_flow(df).count() == 0


def test_period_rules(spark):
    header = ["府省庁", "事業名", "事業番号-1", "事業開始・終了(予定)年度", "事業開始年度", "事業終了(予定)年度"]
    rows = [["総務省", "a", "1", "2010-2015", "", ""], ["総務省", "b", "2", "", "2010", "2015"],
            ["総務省", "c", "3", "", "2010", ""]]
    got = [r["事業開始終了年度"] for r in TB.business(sheet(spark, "database2016_S", header, rows)).orderBy("business_id").collect()]
    assert got == ["2010-2015", "2010-2015", ""]


def test_collision_budgets_merge(spark):
    header = ["府省庁", "事業名", "事業番号-1", "予算額-2016年度予算の状況当初予算", "予算額-2015年度予算の状況当初予算"]
    s = sheet(spark, "database2016_S", header, [["総務省", "a", "1", "10", "5"]])
    t = sheet(spark, "database2016_T", header, [["総務省", "b", "1", "20", ""]])
    rows = s.unionByName(t)
    assert TB.business(rows).count() == 2
    b = TB.budgets(rows).collect()
    assert len(b) == 1
    assert b[0]["予算の状況当初予算"] == "20" and b[0]["予算の状況当初予算_py1"] == "5"


BUDGET_CASES = [
    ("database2016_S", "予算額-2015年度予算の状況当初予算", "予算の状況当初予算_py1"),
    ("database2014_S", "予算額・執行額(単位:百万円)-予算の状況計-2014年度", "予算の状況計"),
    ("database2016_S", "予算額-2017年度要求予算の状況計", "要求予算の状況計_req"),
    ("database2016_S", "予算額-2017年度予算の状況計", "予算の状況計_req"),
    ("database2016_S", "予算額-2015年度当初予算+補正予算に対する執行額の割合(%)", "執行額_py1"),
    ("database2014_S", "予算額・執行額(単位:百万円)-予算の状況計-2015年度要求", None),
    ("database2016_S", "予算額-2010年度執行額", None),
]


@pytest.mark.parametrize("file,name,expected", BUDGET_CASES)
def test_budget_headers(spark, file, name, expected):
    df = sheet(spark, file, [name], [])
    got = H.explain_budget_headers(sheet_headers(df)).collect()[0]["out_col"]
    assert got == expected


def test_fund_flow_and_payee_grammars(spark):
    names = ["費目・使途-A.支払先費目-1", "費目・使途-B.支払先計", "費目・使途-A.その他-1",
             "支出先上位10者リスト-A.支払先-1-入札者数(応募者数)", "支出先上位10者リスト-A.支払先-2-契約方式-1",
             "支出先上位10者リスト-グループ-支出先-3"]
    hdr = sheet_headers(sheet(spark, "database2016_S", names, []))
    ff = sorted(tuple(r) for r in H.parse_fund_flow(hdr).select("block_id", "item", "seq_text").collect())
    assert ff == [("A", "支払先費目", "1"), ("B", "支払先計", "")]
    ex = sorted(tuple(r) for r in H.parse_expenditure(hdr).select("block_id", "seq_text", "item").collect())
    assert ex == sorted([("A", "1", "入札者数"), ("A", "2", "契約方式"), ("グループ", "3", "支出先")])


def test_duplicate_headers_are_renamed(spark):
    hdr = sheet_headers(sheet(spark, "f", ["a", "a", "", "a"], []))
    assert [r["name"] for r in hdr.orderBy("col_idx").collect()] == ["a", "a.1", "Unnamed: 2", "a.2"]


def test_line_items_first_wins_and_numeric_filter(spark):
    header = ["費目・使途-A.支払先費目-01", "費目・使途-A.支払先金額-01", "費目・使途(再)-A.支払先費目-01",
              "費目・使途-B.支払先金額(百万円)-01", "費目・使途-C.支払先金額-02"]
    rows = [["first", "12", "second", "7", "abc"]]
    got = sorted((tuple(r) for r in TB.line_items(sheet(spark, "database2016_S", header, rows)).collect()), key=repr)
    # B's amount header cannot reach its id (Q7) -> item 00; C's amount is not numeric
    assert got == [("2016-00001", "A", "01", "first", None, "12"), ("2016-00001", "B", "00", None, None, "7")]


def test_budgets_keep_rows_of_files_without_budget_columns(spark):
    s = sheet(spark, "database2016_S", ["府省庁", "事業名", "事業番号-1"], [["総務省", "a", "1"], ["総務省", "b", "2"]])
    t = sheet(spark, "database2016_T", ["府省庁", "事業名", "事業番号-1", "予算額-2016年度執行額"],
              [["総務省", "c", "1", "7"], ["総務省", "d", "2", " "], ["総務省", "e", "3", ""]])
    got = {r["business_id"]: r["執行額"] for r in TB.budgets(s.unionByName(t)).collect()}
    assert got == {"2016-00001": "7", "2016-00002": None, "2016-00003": None}


def test_longest_match_opt_in_keeps_the_ratio_apart(spark):
    header = ["府省庁", "事業名", "事業番号-1", "予算額-2015年度執行額", "予算額-2015年度当初予算+補正予算に対する執行額の割合(%)"]
    rows = sheet(spark, "database2016_S", header, [["総務省", "a", "1", "100", "95.5"]])
    compat = TB.budgets(rows).collect()[0].asDict()
    assert compat["執行額_py1"] == "95.5"  # Q2: the ratio overwrites the amount
    opt = TB.budgets(rows, longest_match=True).collect()[0].asDict()
    assert opt["執行額_py1"] == "100"
    assert opt.get("当初予算+補正予算に対する執行額の割合(%)_py1") == "95.5"


def test_na_policies(spark):
    df = spark.createDataFrame([("NA",), ("",), ("x",), (None,)], "v string")
    got = {p: [r[0] for r in df.select(TB.na_to_null(F.col("v"), p)).collect()] for p in ("default", "empty", "none")}
    assert got["default"] == [None, None, "x", None]
    assert got["empty"] == ["NA", None, "x", None]
    assert got["none"] == ["NA", "", "x", None]
