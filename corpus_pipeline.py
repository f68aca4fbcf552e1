"""The training-corpus pipeline: quality rules, near duplicates, benchmark
decontamination, secret redaction, packing.

``run`` applies STAGES to ``documents``; every stage's rows are written to the
shared folder as Parquet and reread by the next.  All but the last stage return
the columns of ``documents`` (and any further columns that the table has).

* quality_rules: documents whose verdict is not *kept* go;
* near_duplicates: of each component (five-word shingles, similarity 0.8) the
  document with the smallest id stays;
* decontamination: documents that hold a copy of a benchmark item go;
* secrets: spans become ``[SECRET]`` and ``n_chars`` follows the text;
* packing: one row per piece with its sequence and place.

Clean documents pass every filter unchanged.  Null texts have no words and fail
the quality rules; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetwise.llm import common as C
from sheetwise.llm import decontaminate, neardup, packing, quality, secrets

SHINGLE = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return quality.filter_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return neardup.drop_near_duplicates(docs, SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return decontaminate.drop_contaminated(docs, C.table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return secrets.redact(docs, secrets.fit(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Trained models and the tokenizer are outside SQL; the tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), name)
    return docs
