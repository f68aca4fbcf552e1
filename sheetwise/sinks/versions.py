"""K7: a set of tables that changes all at once.

    folder/data/<version>/<table>/part-*.parquet
    folder/pointers/0000000007.json    {"<table>": {"path": "data/...", "rows": 123}, ...}

A version is written beside all others; then one pointer file appears under the
next number by a rename that fails if the number is taken.  Readers follow the
greatest pointer, so they see the old set or the new one, whole, and a writer that
dies at any point leaves the old set in place.  Rows are counted by the write
itself (``Observation``), so nothing is built or read again for a manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 20


def _hadoop(spark: SparkSession, folder: str):
    """(file context, path class) of the folder's file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    context, path = _hadoop(spark, folder)
    if not context.util().exists(path(folder)):
        return []
    return sorted(s.getPath().getName() for s in context.util().listStatus(path(folder)))


def _pointers(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in _names(spark, f"{folder}/pointers") if n.endswith(".json") and not n.startswith((".", "_"))]


def _read_pointer(spark: SparkSession, folder: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/pointers/{name}", wholetext=True).first().value)


def current(spark: SparkSession, folder: str) -> dict[str, dict]:
    """table -> {"path", "rows"} of the newest set; empty if there is none."""
    names = _pointers(spark, folder)
    return _read_pointer(spark, folder, names[-1]) if names else {}


def read_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{v['path']}") for t, v in current(spark, folder).items()}


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, row_count) as counted when the tables were written."""
    return spark.createDataFrame([(t, v["rows"]) for t, v in current(spark, folder).items()], "table_name string, row_count long")


def write_counted(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write Parquet; the number of rows written, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*partition_by or []).parquet(path)
    return seen.get["rows"]


def _point(spark: SparkSession, folder: str, change: dict[str, dict]) -> None:
    """Publish ``change`` on top of the newest set.  Another writer that was
    faster took the number: then the change goes on top of its set."""
    context, path = _hadoop(spark, folder)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = jvm.org.apache.hadoop.fs.Options
    no_overwrite = gateway.new_array(getattr(options, "Rename"), 0)
    create = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    no_create_options = gateway.new_array(getattr(options, "CreateOpts"), 0)
    context.mkdir(path(f"{folder}/pointers"), None, True)
    for _ in range(ATTEMPTS):
        names = _pointers(spark, folder)
        whole = {**(_read_pointer(spark, folder, names[-1]) if names else {}), **change}
        aside = path(f"{folder}/pointers/_{uuid.uuid4().hex}")
        out = context.create(aside, create, no_create_options)
        out.write(bytearray(json.dumps(whole).encode()))
        out.close()
        number = int(names[-1].removesuffix(".json")) + 1 if names else 1
        try:
            context.rename(aside, path(f"{folder}/pointers/{number:010d}.json"), no_overwrite)
            return
        except Exception as e:
            context.delete(aside, False)
            if "FileAlreadyExists" not in str(e):
                raise
    raise RuntimeError(f"{folder}: {ATTEMPTS} other writers were faster")


def write_set(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None,
              keep_if_empty: bool = False) -> dict[str, int]:
    """Write the tables as one new version and point to it; tables that are not
    named stay as they are.  With ``keep_if_empty`` a table without rows leaves
    the older one in the set.  A table may be built from the set it replaces."""
    spark = next(iter(tables.values())).sparkSession
    version, before = f"data/{uuid.uuid4().hex}", current(spark, folder)
    rows = {t: write_counted(df, f"{folder}/{version}/{t}", (partition_by or {}).get(t)) for t, df in tables.items()}
    _point(spark, folder, {t: {"path": f"{version}/{t}", "rows": n} for t, n in rows.items() if n or not (keep_if_empty and t in before)})
    return rows


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Remove pointers but the last ``keep`` and every version none of these names
    (also what a writer that died has left).  Not while another one writes."""
    context, path = _hadoop(spark, folder)
    names = _pointers(spark, folder)
    used = {v["path"].split("/")[1] for n in names[-keep:] for v in _read_pointer(spark, folder, n).values()}
    for n in names[:-keep]:
        context.delete(path(f"{folder}/pointers/{n}"), False)
    for n in _names(spark, f"{folder}/data"):
        if n not in used:
            context.delete(path(f"{folder}/data/{n}"), True)
