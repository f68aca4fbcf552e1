"""Incremental normalization: only new files are processed, results equal the batch job."""

import tempfile

from sheetwise.plans.job import normalize_sheet_rows
from sheetwise.streaming.incremental import run_incremental_normalize


def test_incremental_normalize(spark):
    d = tempfile.mkdtemp(prefix="sheetwise-stream-")
    schema = "source_file string, sheet string, row_ordinal int, cells array<string>"
    first = spark.createDataFrame([("a_S", "S", 0, ["事業番号−1"]), ("a_S", "S", 1, ["平成25年度"])], schema)
    first.write.mode("append").parquet(d + "/rows")
    run_incremental_normalize(spark, d + "/rows", d + "/out", d + "/ckpt")
    assert spark.read.parquet(d + "/out").count() == 2
    second = spark.createDataFrame([("b_S", "S", 1, ["ＡＢＣ"])], schema)
    second.write.mode("append").parquet(d + "/rows")
    run_incremental_normalize(spark, d + "/rows", d + "/out", d + "/ckpt")
    got = sorted(tuple(r["cells"]) for r in spark.read.parquet(d + "/out").collect())
    want = sorted(tuple(r["cells"]) for r in normalize_sheet_rows(first.unionByName(second)).collect())
    assert got == want == sorted([("事業番号-1",), ("2013年度",), ("ABC",)])
