"""The stage job: sheets -> normalized sheets -> five tables -> published set.

Stages (``start_stage`` picks up from a saved stage table instead of
rebuilding it; 7 = publish only):

1. ingest workbooks / sheet CSVs into ``sheet_rows`` (optionally only ``target_files``)
2. normalize every header and data cell
3. business + ministries, 4. budgets, 5. fund_flow, 6. expenditure
7. publish: write the tables that exist and a row-count manifest

Every stage output is a Parquet table in ``work_dir`` -- the boundary between
stages is durable, so a lost executor costs at most the running stage.  Stage
tables and published tables are versions behind a pointer (``sinks.versions``):
readers see a whole set, the old one until the new one is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions.text import nfkc_sent, post_cells, pre_cells
from sheetwise.plans import tables as TB
from sheetwise.sinks import versions


def normalize_sheet_rows(rows: DataFrame) -> DataFrame:
    """Normalize all header and data cells of every sheet.

    Three projections (native pre-step, Arrow NFKC for the few sensitive
    cells, native post-steps); each intermediate is a column, computed once.
    """
    cols = [c for c in rows.columns if c != "cells"]
    return (rows.withColumn("_pre", pre_cells(F.col("cells")))
            .withColumn("_sent", nfkc_sent(F.col("_pre")))
            .select(*cols, post_cells(F.col("_pre"), F.col("_sent")).alias("cells")))


def publish(tables: dict[str, DataFrame], out_dir: str, keep_if_empty: bool = False) -> DataFrame:
    """Write the tables as one new set (business partitioned by year) and
    return the manifest (table_name, row_count) of the set that readers see then.
    Rows are counted while they are written."""
    spark = next(iter(tables.values())).sparkSession
    versions.write_set(tables, out_dir, {"business": ["source_year"]}, keep_if_empty)
    return versions.manifest(spark, out_dir)


def _workbook_of(rows: DataFrame):
    """The workbook's file name; rows without one (sheet CSVs) go by their stem."""
    return F.coalesce(F.col("workbook"), F.concat(F.regexp_extract("source_file", "^(.*)_[^_]*$", 1), F.lit(".xlsx")))


TABLE_STAGE = {"ministries": 3, "business": 3, "budgets": 4, "fund_flow": 5, "expenditure": 6}


def run_job(spark: SparkSession, work_dir: str, source: DataFrame | None = None, start_stage: int = 1,
            target_files: list[str] | None = None) -> DataFrame:
    """Run stages ``start_stage``..7 and return the manifest of what is published.

    ``source`` is the stage-1 ``sheet_rows`` (e.g. ``ingest_workbooks`` or
    ``read_sheet_csv``).  ``target_files`` names workbook files: stage 1 then
    replaces the sheets of those workbooks only and keeps all others, and the
    later stages read everything.  Stages 3-6 each build their table(s) from the
    saved stage-2 table; an empty result leaves an older table published
    (SURVEY Q12).  ``start_stage=7`` only publishes the manifest.
    """
    stages, out_path = f"{work_dir}/stages", f"{work_dir}/tables"
    if start_stage <= 1:
        rows = source if "workbook" in source.columns else source.withColumn("workbook", F.lit(None).cast("string"))
        if target_files:
            rows = rows.where(_workbook_of(rows).isin(*target_files))
            before = versions.read_set(spark, stages).get("sheet_rows")
            if before is not None:
                rows = rows.unionByName(before.where(~_workbook_of(before).isin(*target_files)))
        versions.write_set({"sheet_rows": rows}, stages)
        # header rows as their own small table: later stages find every
        # file's header without scanning the data rows
        versions.write_set({"header_rows": versions.read_set(spark, stages)["sheet_rows"].where(F.col("row_ordinal") == 0)}, stages)
    if start_stage <= 2:
        raw = versions.read_set(spark, stages)
        versions.write_set({"normalized": normalize_sheet_rows(raw["sheet_rows"]), "normalized_header_rows": normalize_sheet_rows(raw["header_rows"])}, stages)
    if start_stage <= 6:
        saved = versions.read_set(spark, stages)
        normalized, heads = saved["normalized"], saved["normalized_header_rows"]
        builders = {
            "ministries": lambda: TB.ministries(spark),
            "business": lambda: TB.business(normalized, header_rows=heads),
            "budgets": lambda: TB.budgets(normalized, header_rows=heads),
            "fund_flow": lambda: TB.fund_flow(normalized, header_rows=heads),
            "expenditure": lambda: TB.expenditure(normalized, header_rows=heads),
        }
        publish({name: build() for name, build in builders.items() if TABLE_STAGE[name] >= start_stage}, out_path, keep_if_empty=True)
    return versions.manifest(spark, out_path)
