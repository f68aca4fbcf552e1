"""Session set-up and the few cluster-level helpers every job shares."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, app: str = "sheetwise", shuffle_partitions: int | None = None,
                checkpoint_dir: str | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.caseSensitive", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          # checkpoint files of a finished query are removed once unreferenced
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
          .config("spark.driver.memory", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark, checkpoint_dir)
    return spark


_SHIPPED_KEY = "spark.sheetwise.pyfiles.shipped"


def ship_package(spark: SparkSession) -> None:
    """Make ``sheetwise`` importable in the Python workers (Arrow UDFs and
    ``mapInPandas`` functions are pickled by reference).

    Once per SparkContext the package is zipped and added with ``addPyFile``;
    Spark distributes it to every executor.  On a cluster you may instead
    deploy it with ``--py-files``; then set the key below to skip this.
    """
    import os
    import zipfile
    if spark.sparkContext.getConf().get(_SHIPPED_KEY, "") == "true" or spark.conf.get(_SHIPPED_KEY, "") == "true":
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="sheetwise-pyfiles-"), "sheetwise.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(out)
    spark.conf.set(_SHIPPED_KEY, "true")


def configure(spark: SparkSession, checkpoint_dir: str | None = None) -> SparkSession:
    """Session settings the library relies on (safe to call repeatedly)."""
    ship_package(spark)
    # Header names such as ``a`` and ``A`` are distinct columns of a sheet.
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # HotSpot never compiles a method of more than 8,000 bytes: stages with such a
    # method run operator by operator, in small methods, instead of interpreted
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, explicit: str | None = None) -> str:
    """Return the shared checkpoint folder, reading it from the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we use it.
    Only when nothing is configured *and* the master is local (tests, the
    bench) do we create a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = explicit or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder of the cluster")
        conf_dir = tempfile.mkdtemp(prefix="sheetwise-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_RELEASE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """For jobs whose result is a file: the shuffle files of each are removed when
    it ends, not when the driver happens to collect its garbage, so the steps of a
    query do not add up on disk."""
    before = spark.conf.get(_RELEASE_KEY)
    spark.conf.set(_RELEASE_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE_KEY, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back:
    later readers get pruned columns, and a lost executor recomputes nothing."""
    path = scratch_folder(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_per_file(rows: DataFrame, per_file: DataFrame) -> DataFrame:
    """Join rows with a table of one row per ``source_file``.

    No hint and no row count: the per-file table is stored first, so Spark knows
    its size in bytes and broadcasts it if that is below its own threshold.
    Beyond, both sides are shuffled by file, and Spark splits a file's rows over
    tasks in proportion to their bytes (skew join), each with the one row of the
    file: a file with a third of all rows costs no task more than any other.
    """
    return rows.join(stored(per_file, "per-file"), "source_file")
