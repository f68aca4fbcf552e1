"""Stage 2 as an incremental job: normalize sheet rows as new files land.

The source system processes a folder in batch, and reruns reprocess
everything.  The same stage on Structured Streaming reads the ``sheet_rows``
Parquet folder as a file stream, normalizes every cell (the same column
expression as the batch job) and appends to the normalized folder.  The
streaming checkpoint records which input files are done, so a rerun -- or a
restart after a lost driver or executor -- only takes new files, exactly
once.  ``availableNow`` processes what is there and stops, so it schedules
like a batch job.

There are no windows, watermarks or state: the step is row-by-row, so the
query is append-only and stateless.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from sheetwise.plans.job import normalize_sheet_rows
from sheetwise.sources.sheets import SHEET_ROWS_SCHEMA


def start_incremental_normalize(spark: SparkSession, rows_path: str, out_path: str,
                                checkpoint: str, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """``checkpoint`` names this stream's own folder in shared storage; it must
    outlive the application.  Start (and, with ``availableNow``, finish) normalizing new sheet-row files."""
    reader = spark.readStream.schema(SHEET_ROWS_SCHEMA).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    normalized = normalize_sheet_rows(reader.load(rows_path))
    return (normalized.writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def run_incremental_normalize(spark: SparkSession, rows_path: str, out_path: str, checkpoint: str) -> None:
    q = start_incremental_normalize(spark, rows_path, out_path, checkpoint)
    q.awaitTermination()
