"""Whole-text normalization against a brute-force Python statement of the
same rules (SURVEY 2.7), on every document of the small fixture.

DuckDB has no NFKC, so the registered ``normalize_documents`` query only gets
a row-count check from the driver; this test checks its values.
"""

import re
import unicodedata

from pyspark.sql import functions as F

from sheetwise.functions.text import normalize_text

_ERA = {"明治": 1867, "M": 1867, "大正": 1911, "T": 1911, "昭和": 1925, "S": 1925,
        "平成": 1988, "H": 1988, "令和": 2018, "R": 2018}
_E = "(" + "|".join(_ERA) + ")"
_HY = "[\\-‐‑‒–—―−－]"


def _year(era, y):
    return _ERA[era] + (1 if y == "元" else int(y))


def brute_normalize(t):
    if t is None or t == "":
        return t
    t = re.sub("[①-⑳]", lambda m: f"{ord(m.group()) - 0x245F}. ", t)
    t = unicodedata.normalize("NFKC", t)
    t = re.sub(r"\s*[~～]\s*", "～", t)
    t = re.sub(_E + r"([0-9]{1,2}|元)\s*～\s*([0-9]{1,2})", lambda m: f"{_year(m[1], m[2])}～{_year(m[1], m[3])}", t)
    t = re.sub(_E + r"([0-9]{1,2}|元)", lambda m: str(_year(m[1], m[2])), t)
    t = re.sub(r"(?<![0-9])([0-9]{1,2})年度",
               lambda m: f"{2018 + int(m[1]) if int(m[1]) <= 5 else 1988 + int(m[1])}年度", t)
    t = re.sub("リスト" + _HY + "グル" + _HY + "プ", "リスト-グループ", t)
    parts = re.split("(リスト" + _HY + "グループ)", t)

    def hyphens(p):
        p = re.sub("([ァ-ヴ])" + _HY + "(?=[ァ-ヴ])", r"\1ー", p)
        p = re.sub(_HY, "-", p)
        return re.sub("([ぁ-んァ-ヴ一-龠])-(?=[ぁ-んァ-ヴ一-龠])", r"\1", p)

    t = "".join(p if i % 2 else hyphens(p) for i, p in enumerate(parts))
    return t.strip()


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = docs.select("doc_id", "text", normalize_text(F.col("text")).alias("n")).collect()
    bad = [r["doc_id"] for r in got if r["n"] != brute_normalize(r["text"])]
    assert len(got) > 0 and bad == []


def test_japanese_samples_match_brute_force(spark):
    samples = ["①平成25年度～令和2年度の事業", "Ｈ３０年　～　Ｒ２年", "リスト－グル－プ－支出先－３",
               "カ‐リスト‐グループ‐ア", "東京—大阪～名古屋", "昭和元年、明治5年度", "M1ー2", "  ㈱テスト－コ－ド  ",
               "平成25～29年度と6年度", "S63~H2", "⑳⑲", "ア－イ－ウ", "事業番号－１２３"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r["n"] for r in df.select(normalize_text(F.col("t")).alias("n")).collect()]
    assert got == [brute_normalize(s) for s in samples]
