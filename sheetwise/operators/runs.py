"""The query-run log as an append-only table plus folds.

Each execution appends one record; a re-run of an existing history id
replaces the question, SQL, status, result, duration and timestamp and adds
one to the count.  Instead of updating rows in place, the log keeps every
execution and ``fold_reruns`` derives the current state.  An execution carries
the number of runs it stands for (1, or an imported record's count), so imported
logs fold together with later reruns.  ``(timestamp, seq)`` is the position of an
execution in the log; deletes have one too, so that their order counts.  Imported
records become entries of their own, under ids that were never given before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.operators.ordinal import dense_ordinal

LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("question", T.StringType()),
    T.StructField("sql_query", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("result_json", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("execution_count", T.LongType()),
])

EXECUTION_SCHEMA = T.StructType([
    T.StructField("history_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("question", T.StringType()),
    T.StructField("sql_query", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("result_json", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("execution_count", T.LongType()),
])

DELETE_SCHEMA = T.StructType([
    T.StructField("history_id", T.LongType()),  # null: all entries
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])

_FIELDS = ["timestamp", "question", "sql_query", "status", "result_json", "duration_ms"]


def as_executions(records: DataFrame) -> DataFrame:
    """Log records (``LOG_SCHEMA``) as executions: each stands for its count."""
    return records.select(F.col("id").alias("history_id"), F.lit(0).cast("long").alias("seq"), *_FIELDS,
                          F.coalesce("execution_count", F.lit(1)).cast("long").alias("execution_count"))


def append_run(log: DataFrame, executions: DataFrame) -> DataFrame:
    """Add executions (``EXECUTION_SCHEMA``) to the execution log."""
    return log.unionByName(executions.select(*[f.name for f in EXECUTION_SCHEMA.fields]))


def _at() -> Column:
    """The position of an event in the log as one number: microseconds, then the
    sequence number (38 digits).  No time stands before all times."""
    micros = F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(-(1 << 62)))
    return (micros.cast("decimal(19,0)") * F.expr("CAST('10000000000000000000' AS DECIMAL(20,0))")
            + F.coalesce("seq", F.lit(0)).cast("decimal(19,0)"))


def _summary(executions: DataFrame) -> DataFrame:
    """(history_id, _first, _last, _n): a hash aggregate on numbers only."""
    return executions.groupBy("history_id").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"),
                                                F.sum(F.coalesce("execution_count", F.lit(1))).alias("_n"))


def _with_fields(summary: DataFrame, executions: DataFrame) -> DataFrame:
    """The latest execution's fields, joined back.  Executions at one position are
    told apart by their fields, so every id gives one row whatever the input."""
    last = executions.drop("execution_count").withColumnRenamed("history_id", "id").join(
        summary, (F.col("id").eqNullSafe(F.col("history_id"))) & (F.col("_at") == F.col("_last")))
    one = last.groupBy("id").agg(F.max(F.struct(*_FIELDS)).alias("w"), F.max("_n").alias("_n"))
    return one.select("id", *[F.col(f"w.{c}") for c in _FIELDS], F.col("_n").cast("long").alias("execution_count"))


def fold_reruns(executions: DataFrame) -> DataFrame:
    """R2: current state per history id -- latest execution's fields (by
    timestamp, then sequence, then the fields) and the sum of the execution counts.

    The latest execution is found by a hash aggregate on one number per row, so
    the wide log is not sorted; its fields are then joined back.
    """
    e = executions.withColumn("_at", _at())
    return _with_fields(_summary(e), e)


def _gone(deletes: DataFrame) -> tuple[DataFrame, Column]:
    d = deletes.select("history_id", _at().alias("_at"))
    own = d.where("history_id IS NOT NULL").groupBy(F.col("history_id").alias("_id")).agg(F.max("_at").alias("_gone"))
    return own, d.where("history_id IS NULL").agg(F.max("_at")).scalar()


def fold_log(executions: DataFrame, deletes: DataFrame) -> DataFrame:
    """R2 and R4 in the order of events: the entries that are left.

    ``deletes``: ``DELETE_SCHEMA``; a null id deletes everything there is at that
    time.  An id begins with its first execution.  A delete after that ends it for
    good: ids are never given twice, so a later rerun of it changes nothing.  A
    delete before the id begins finds nothing and has no effect.  At one position
    executions stand before deletes.
    """
    e = executions.withColumn("_at", _at())
    own, everything = _gone(deletes)
    alive = (_summary(e).join(own, F.col("history_id") == F.col("_id"), "left")
             .where("_gone IS NULL OR _gone < _first").where(F.coalesce(everything < F.col("_first"), F.lit(True))))
    return _with_fields(alive.drop("_id", "_gone"), e)


def latest_runs(folded: DataFrame, n: int | None = None) -> DataFrame:
    """R3/T4 (D7 with ``run_stats``): newest first, ties by id descending; ``n`` = page size."""
    out = folded.orderBy(F.desc("timestamp"), F.desc("id"))
    return out.limit(n) if n else out


def delete_runs(folded: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Drop history ids deleted after the last event (anti join against their
    ids); ``fold_log`` takes deletes among the events."""
    return folded.join(tombstones.select(F.col("id")).distinct(), "id", "left_anti")


def missing_ids(folded: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Ids asked to be deleted that the log does not have."""
    return tombstones.select("id").distinct().join(folded, "id", "left_anti")


def run_history(folded: DataFrame, n: int | None = None) -> DataFrame:
    """Newest first, with result size and error."""
    stats = run_stats(folded).select("id", "row_count", "error")
    return latest_runs(folded.join(stats, "id"), n)


def delete_all(folded: DataFrame) -> DataFrame:
    return folded.limit(0)


_RESULT = T.StructType([T.StructField("columns", T.ArrayType(T.StringType())),
                        T.StructField("data", T.ArrayType(T.ArrayType(T.StringType()))),
                        T.StructField("error", T.StringType())])


def run_stats(folded: DataFrame) -> DataFrame:
    """Per run, status, number of result rows, error text."""
    r = F.from_json(F.col("result_json"), _RESULT)
    rows = F.when(F.col("status") == "success", F.coalesce(F.size(r["data"]), F.lit(0)))
    err = F.when(F.col("status") == "error", F.coalesce(r["error"], F.lit("unknown error")))
    return folded.select("id", "status", rows.cast("long").alias("row_count"), err.alias("error"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold a JSON list of log records -> log rows; a missing
    count is 1; a file that holds anything but a list is an error, an empty one
    (a part without rows) no records."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.translate("value", "\n\r\t\ufeff", "")), 1, 1).alias("c"))
    if not first.where("c NOT IN ('[', '')").isEmpty():
        raise ValueError(f"{path}: a run log is a JSON list of records")
    df = spark.read.option("multiLine", True).schema(LOG_SCHEMA).json(path)
    return df.withColumn("execution_count", F.coalesce(F.col("execution_count"), F.lit(1).cast("long")))


def import_runs(spark: SparkSession, path: str, executions: DataFrame) -> DataFrame:
    """The records of an exported log as new executions.

    Every record gets an id of its own, whatever id it was exported with: the
    greatest id that ``executions`` ever gave, deleted entries included, plus
    1, 2, ... in the order of the records (by file name, then place in the file).
    The numbers come from a range partitioning, so a large import passes through
    no single task.  Importing a log twice therefore gives every record twice.
    """
    # a file with a list is one split: inside it the generated number follows the list
    records = read_run_log(spark, path).select(
        *_FIELDS, "execution_count", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place"))
    numbered = dense_ordinal(records.withColumn("_all", F.lit(0)), "_all", ["_file", "_place"], "_number")
    greatest = F.coalesce(executions.agg(F.max("history_id")).scalar(), F.lit(0).cast("long"))
    return as_executions(numbered.withColumn("id", greatest + F.col("_number")))


def export_runs(log: DataFrame, path: str) -> None:
    """K5: the log ordered by id; every part file is a JSON list, which is what
    ``read_run_log`` and ``import_runs`` read."""
    def listed(batches):
        import pandas as pd
        gap = "["
        for pdf in batches:
            out = []
            for v in pdf["value"]:
                out.append(gap + v)
                gap = ","
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["]" if gap == "," else "[]"]})

    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    (log.orderBy("id").select(F.to_json(F.struct("*"), exact).alias("value")).mapInPandas(listed, "value string")
     .write.mode("overwrite").text(path))


def executions_from_events(events: DataFrame) -> DataFrame:
    """Executions derived from the driver's event stream: one event = one run
    of the history entry ``user_id``; an ``error`` event is a failed run; the
    result table has one column ``k`` and ``k % 5`` rows."""
    k = F.get_json_object("props", "$.k").cast("long")
    ok = F.col("event_type") != "error"
    result = F.when(ok, F.to_json(F.struct(F.array(F.lit("k")).alias("columns"),
                                           F.array_repeat(F.array(k.cast("string")), (k % 5).cast("int")).alias("data"))))\
        .otherwise(F.to_json(F.struct(F.concat(F.lit("failed: "), F.col("event_type"), F.lit(" "), k.cast("string")).alias("error"))))
    return events.select(
        F.col("user_id").alias("history_id"), F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("question "), F.col("user_id").cast("string")).alias("question"),
        F.concat(F.lit("SELECT "), F.col("event_type")).alias("sql_query"),
        F.when(ok, F.lit("success")).otherwise(F.lit("error")).alias("status"),
        result.alias("result_json"),
        F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"), F.lit(1).cast("long").alias("execution_count"))


def deletes_from_events(events: DataFrame, one: Column, everything: Column) -> DataFrame:
    """Deletes (``DELETE_SCHEMA``) derived from the driver's event stream: events
    that satisfy ``one`` delete the entry of their user, those that satisfy
    ``everything`` all entries."""
    return events.where(one | everything).select(
        F.when(~everything, F.col("user_id")).alias("history_id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"))
