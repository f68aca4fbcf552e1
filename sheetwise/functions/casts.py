"""Safe numeric casts with one meaning on every engine.

Spark accepts ``1d``/``1f`` and DuckDB accepts ``1_000``; pandas accepts
neither.  A regex guard in front of ``try_cast`` keeps only plain decimal or
scientific text, optionally signed and space-padded, plus ``inf``/``infinity``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_TEXT = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def is_numeric_text(v: Column) -> Column:
    """the text parses as a number (NaN text does not count)."""
    return F.coalesce(v.rlike(NUMERIC_TEXT), F.lit(False))


def safe_double(v: Column) -> Column:
    """``TRY_CAST(v AS DOUBLE)`` restricted to plain numeric text."""
    return F.when(is_numeric_text(v), F.trim(v).try_cast("double"))


def nan_to_null(df):
    """NaN in floating-point result columns becomes NULL (results are
    handed out with missing values as NULL only)."""
    from pyspark.sql import types as T
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name)
        out.append(c)
    return df.select(*out)
