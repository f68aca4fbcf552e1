"""Worked text-normalization cases (FIXTURES.md section 5 and the semantics notes)."""

import pytest
from pyspark.sql import functions as F

from sheetwise.functions.text import normalize_text
from sheetwise.plans.job import normalize_sheet_rows

CASES = [
    ("①目的", "1. 目的"),
    ("ＡＢＣ　１２３", "ABC 123"),
    ("㈱", "(株)"),
    ("令和元年", "2019年"),
    ("H26", "2014"),
    ("S63", "1988"),
    ("平成25～29年度", "2013～2017年度"),
    ("平成元～5年度", "1989～1993年度"),
    ("平成25年度 ～ 29年度", "2013年度～2017年度"),
    ("R2～R4", "2020～2022"),
    ("平成25〜29", "2013〜29"),
    ("3年度", "2021年度"),
    ("5年度", "2023年度"),
    ("6年度", "1994年度"),
    ("29年度", "2017年度"),
    ("2016年度", "2016年度"),
    ("M365", "19035"),
    ("コンピュ-タ", "コンピュータ"),
    ("東京—大阪", "東京大阪"),
    ("事業番号−1", "事業番号-1"),
    ("予算の状況-当初予算", "予算の状況当初予算"),
    ("リスト-グル-プ-支出先-1", "リスト-グループ-支出先-1"),
    ("リスト‐グループ", "リスト‐グループ"),
    ("", ""),
    (None, None),
    ("  全角　空白  ", "全角 空白"),
    ("平成25年度とH元年、29年度", "2013年度と1989年、2017年度"),
    ("ア-リスト-グループ-イ", "ア-リスト-グループ-イ"),
    ("東-京-都", "東京都"),
    ("ア-イ-ウ", "アーイーウ"),
    ("plain ascii ~ text", "plain ascii～text"),
]


@pytest.fixture(scope="module")
def normalized(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    return {r["i"]: r["n"] for r in df.select("i", normalize_text(F.col("t")).alias("n")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_normalize_text(normalized, i):
    assert normalized[i] == CASES[i][1], CASES[i][0]


def test_normalize_cells_matches_scalar(spark):
    vals = [c[0] for c in CASES]
    df = spark.createDataFrame([(vals,), (None,), ([],)], "cells array<string>")
    rows = normalize_sheet_rows(df).select(F.col("cells").alias("n")).collect()
    assert rows[0]["n"] == [c[1] for c in CASES]
    assert rows[1]["n"] is None
    assert rows[2]["n"] == []


def test_nfkc_prefilter_is_sound():
    """Every character that NFKC changes alone is in the prefilter set."""
    import unicodedata
    from sheetwise.functions.text import NFKC_UNSTABLE
    s = set(NFKC_UNSTABLE)
    for cp in list(range(0x3000, 0x3100)) + list(range(0xFF00, 0xFFF0)) + list(range(0x2460, 0x24FF)):
        c = chr(cp)
        if unicodedata.normalize("NFKC", c) != c:
            assert c in s
    assert "あ" not in s and "漢" not in s and "ア" not in s


def test_stable_blocks_and_strip():
    import re
    import unicodedata

    from sheetwise.functions import regex, text
    assert not set(re.findall("[" + text.NFKC_STABLE + "]", text.nfkc_unstable()))
    assert len(text._NARROW) == len(text._WIDE) and text._NARROW.isascii()
    # (a wide space would otherwise send a value to Python)
    assert all(unicodedata.normalize("NFKC", "か" + w + "\u3099") == unicodedata.normalize("NFKC", "か" + n + "\u3099") for w, n in zip(text._WIDE, text._NARROW))
    assert [c for c in map(chr, range(0x110000)) if c.isspace()] == list(regex.PY_SPACES)


def test_wide_digits_and_edges_stay_in_the_jvm(spark):
    """Cells with full-width digits and white space at the ends send nothing to Python."""
    from sheetwise.functions.text import nfkc_sent, pre_cells
    cells = [" \u3000１２ー３、金額（円）\u3000 ", "ｶﾞ", None, "", "\u2028 H25 ～ 26\u3000", "\x85〜 平成２５年～２７年 \x1f", "\u3000a ~", "漢-字 ", "\u3000"]
    df = spark.createDataFrame([(cells[:1],), (cells,)], "cells array<string>").withColumn("pre", pre_cells(F.col("cells")))
    one, many = (r["s"] for r in df.withColumn("s", nfkc_sent(F.col("pre"))).select("s").collect())
    assert one is None and many[1] == "ガ"
    got = [r["cells"] for r in normalize_sheet_rows(df.select("cells")).collect()][1]
    assert got == ["12ー3、金額(円)", "ガ", None, "", "2013～2014", "〜 2013年～27年", "a～", "漢字", ""]
