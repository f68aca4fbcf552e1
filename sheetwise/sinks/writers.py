"""Writers (K2-K4, K6).  K1 (all-quoted sheet CSV) lives with the sheet model,
K5 with the run log and K7 with the stage job.

Spark's CSV writer does not emit a byte-order mark; files are otherwise
byte-compatible with the quoting rules below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """K2/K4: header line, fields quoted only when they hold a comma, quote or
    line break, quotes doubled, NULL as an empty field."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"')
     # values are written as they are: no trimming
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("nullValue", "").option("emptyValue", "").csv(path))


def selective_quote_lines(df: DataFrame, unquoted: list[str]) -> DataFrame:
    """K3: one text line per row -- the ``unquoted`` columns as plain text,
    every other column quoted with doubled quotes; NULL -> empty (quoted
    ``""`` for quoted columns)."""
    parts = []
    for c in df.columns:
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        parts.append(v if c in unquoted else F.concat(F.lit('"'), F.regexp_replace(v, '"', '""'), F.lit('"')))
    return df.select(F.concat_ws(",", *parts).alias("value"))


def write_selective_quoted(df: DataFrame, path: str, unquoted: list[str]) -> None:
    """K3 written in parallel: every part file starts with the header line
    (the convention of Spark's own CSV writer with ``header=true``), so no
    task ever holds the whole table."""
    header = ",".join(df.columns)

    def with_header(batches):
        import pandas as pd
        yield pd.DataFrame({"value": [header]})
        yield from batches

    (selective_quote_lines(df, unquoted).mapInPandas(with_header, "value string")
     .write.mode("overwrite").text(path))


def write_item_list(items: DataFrame, path: str, column: str = "item") -> None:
    """K6 + T3: sorted distinct items, one per line (binary string order)."""
    (items.select(F.col(column).alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value")
     .write.mode("overwrite").text(path))
