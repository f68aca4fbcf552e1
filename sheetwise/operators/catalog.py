"""Catalog and profiling.

``infer_types`` plays the role of a CSV reader's type detection: per text
column, the narrowest of BIGINT / DOUBLE / VARCHAR that every non-null value
fits, computed in one aggregation pass (partial aggregates per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise import constants as K
from sheetwise.functions.casts import NUMERIC_TEXT

INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"

_SPARK_TO_SQL = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                 "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}


def register_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Every table becomes a temp view named by its key."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(tables)


def list_tables(spark: SparkSession) -> list[str]:
    """Sorted table/view names of the current catalog."""
    return sorted(t.name for t in spark.catalog.listTables())


def describe_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, data_type) from the schemas."""
    rows = [(t, i, f.name, _SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString().upper()))
            for t in sorted(tables) for i, f in enumerate(tables[t].schema.fields)]
    schema = "table_name string, position int, column_name string, data_type string"
    return spark.createDataFrame(rows, schema)


def schema_markdown(described: DataFrame) -> DataFrame:
    """The schema description as one Markdown document (one row)."""
    m = K.SCHEMA_DOCUMENT
    line = F.format_string(m["column"], F.col("column_name"), F.col("data_type"))
    per_table = described.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))).alias("lines"))
    block = F.concat(F.format_string(m["table"], F.col("table_name")), F.array_join(F.col("lines.l"), ""), F.lit("\n"))
    doc = per_table.agg(F.array_sort(F.collect_list(F.struct("table_name", block.alias("b")))).alias("t"))
    names = F.array_join(F.col("t.table_name"), "`, `")
    return doc.select(F.concat(F.lit(m["title"]), F.format_string(m["names"], names), F.array_join(F.col("t.b"), "")).alias("markdown"))


def prompt(template: DataFrame, markdown: DataFrame) -> DataFrame:
    """A template (column ``template``) with the schema document wherever it
    says ``{{schema}}``."""
    return template.select(F.replace("template", F.lit(K.SCHEMA_PLACE), markdown.scalar()).alias("prompt"))


def infer_types(df: DataFrame, table_name: str) -> DataFrame:
    """C4: (table_name, column_name, inferred_type) for every column of ``df``.

    Non-string columns keep their type.  A string column is BIGINT when every
    non-null value is integer text that fits, DOUBLE when every one is numeric
    text, else VARCHAR (also when it has no values at all).
    """
    aggs, kinds = [], {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            # one code per value: 0 integer, 1 number, 2 text; the largest decides
            is_int = c.rlike(INTEGER_TEXT) & F.trim(c).try_cast("bigint").isNotNull()
            aggs.append(F.max(F.when(c.isNull(), None).when(is_int, 0).when(c.rlike(NUMERIC_TEXT), 1).otherwise(2)).alias(f"k_{len(kinds)}"))
            kinds[f.name] = None
        else:
            kinds[f.name] = _SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
    stats = df.agg(*aggs) if aggs else df.sparkSession.range(1).select()
    out = []
    for i, (name, fixed) in enumerate(kinds.items()):
        if fixed is not None:
            t = F.lit(fixed)
        else:
            t = F.when(F.col(f"k_{i}") == 0, "BIGINT").when(F.col(f"k_{i}") == 1, "DOUBLE").otherwise("VARCHAR")
        out.append(F.struct(F.lit(table_name).alias("table_name"), F.lit(i).alias("position"),
                            F.lit(name).alias("column_name"), t.alias("inferred_type")))
    return stats.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def column_present(df: DataFrame, column: str) -> bool:
    """Guard -- run a dependent query only when the column exists."""
    return column in df.columns
