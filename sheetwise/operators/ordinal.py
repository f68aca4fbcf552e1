"""Dense 1-based row ordinal per file, without a one-task window.

``row_number() OVER (PARTITION BY file ORDER BY ...)`` sends a whole file to
one task; a file may hold a large share of all rows.  Instead (the
``zipWithIndex`` idea, expressed with DataFrames):

1. range-partition on (file, order keys) and sort inside partitions, so each
   partition holds one contiguous key range;
2. number rows inside each partition with ``monotonically_increasing_id``
   (consecutive inside a partition) and write that numbering as Parquet to the
   shared checkpoint folder, so a lost executor cannot renumber rows;
3. count rows per (partition, file) -- at most partitions + files rows -- and
   turn the counts into per-file offsets with a window over that small table;
4. join the offsets back on (partition, file) and add (the stored offsets have a
   known size, by which Spark chooses the join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.session import stored


def dense_ordinal(df: DataFrame, file_col: str, order_cols: list[str], name: str = "row_ordinal",
                  num_partitions: int | None = None) -> DataFrame:
    keys = [file_col] + list(order_cols)
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    numbered = (ranged.sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    numbered = stored(numbered, "numbered")
    counts = numbered.groupBy("_pid", file_col).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(file_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = numbered.join(stored(offsets, "offsets"), ["_pid", file_col])
    return (out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first") + 1)
               .drop("_pid", "_mid", "_first", "_off"))
