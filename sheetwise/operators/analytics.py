"""Analytics over the built tables.

Joins to ``ministries`` broadcast it: the master is a fixed 24-row table.
Every top-k has a total order (value, then name) so ties cannot change the
answer; Spark plans ``orderBy(...).limit(k)`` as TakeOrderedAndProject
(per-partition top-k, then a k-row merge).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.casts import safe_double


def _with_ministry(business: DataFrame, ministries: DataFrame) -> DataFrame:
    return business.join(F.broadcast(ministries), "ministry_id")


def of_ministry(business: DataFrame, ministries: DataFrame, ministry: str) -> DataFrame:
    """The rows of one ministry's projects."""
    return business.join(F.broadcast(ministries.where(F.col("ministry_name") == ministry)), "ministry_id", "left_semi")


def top_count(business: DataFrame, ministries: DataFrame, n: int = 10) -> DataFrame:
    """Number of projects per ministry, most first."""
    return (_with_ministry(business, ministries).groupBy("ministry_name")
            .agg(F.count("business_id").alias("business_count"))
            .orderBy(F.desc("business_count"), F.asc("ministry_name")).limit(n))


def _with_budget(business, ministries, budgets, cols):
    b = _with_ministry(business, ministries)
    return b.join(budgets.select("business_id", *[F.col(f"`{c}`") for c in cols]), "business_id", "left")


def top_budget(business: DataFrame, ministries: DataFrame, budgets: DataFrame, ministry: str = "デジタル庁",
               n: int = 10, column: str = "予算の状況当初予算") -> DataFrame:
    """One ministry's projects by current initial budget; filter after the projection (Q18)."""
    j = _with_budget(business, ministries, budgets, [column]).where(F.col("ministry_name") == ministry)
    p = j.select(F.col("事業名"), safe_double(F.col(f"`{column}`")).alias("当初予算額_百万円"))
    return p.where(F.col("当初予算額_百万円").isNotNull()).orderBy(
        F.desc("当初予算額_百万円"), F.asc("事業名")).limit(n)


def top_sum(business: DataFrame, ministries: DataFrame, budgets: DataFrame, n: int = 5,
            column: str = "予算の状況当初予算") -> DataFrame:
    """D3/A2: total current initial budget per ministry."""
    j = _with_budget(business, ministries, budgets, [column])
    return (j.groupBy("ministry_name").agg(F.sum(safe_double(F.col(f"`{column}`"))).alias("total_budget"))
            .orderBy(F.desc_nulls_last("total_budget"), F.asc("ministry_name")).limit(n))


def cast_filter(business: DataFrame, ministries: DataFrame, budgets: DataFrame, ministry: str = "財務省",
                column: str = "執行額_py3", threshold: float = 1000) -> DataFrame:
    """A ministry's projects whose value in ``column`` exceeds ``threshold``."""
    j = _with_budget(business, ministries, budgets, [column]).where(F.col("ministry_name") == ministry)
    p = j.select("business_id", "事業名", safe_double(F.col(f"`{column}`")).alias(column))
    return p.where(F.col(column) > threshold)


def text_filter(table: DataFrame, column: str, word: str, keep: list[str]) -> DataFrame:
    """Rows whose ``column`` contains ``word``."""
    return table.where(F.col(f"`{column}`").contains(word)).select(*[F.col(f"`{c}`") for c in keep + [column]])


def _found(df: DataFrame, search: str | None) -> DataFrame:
    if not search:
        return df
    hits = [F.coalesce(F.col(f"`{c}`").cast("string").contains(search), F.lit(False)) for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def _sort_columns(df: DataFrame, sort_by: str | None, descending: bool) -> list[tuple[str, bool]]:
    """(column, descending); all columns at the end, so that a page is well defined."""
    return ([(sort_by, descending)] if sort_by else []) + [(c, False) for c in df.columns]


def _sorted(df: DataFrame, by: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*[F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_last() for c, down in by])


def browse(df: DataFrame, search: str | None = None, sort_by: str | None = None, descending: bool = False,
           page: int = 0, page_size: int = 50) -> DataFrame:
    """T5: search (any column contains the text), sort, page -- the result
    table widget as a query.  Pages by number: every page sorts all earlier ones too."""
    out = _found(df, search)
    return _sorted(out, _sort_columns(out, sort_by, descending)).offset(page * page_size).limit(page_size)


@dataclass(frozen=True)
class PageEnd:
    """Where a page ended: its last row, and how many rows equal to it have been
    shown (rows that agree in all columns have no order)."""
    row: tuple
    shown: int


def browse_after(df: DataFrame, search: str | None = None, sort_by: str | None = None, descending: bool = False,
                 after: PageEnd | None = None, page_size: int = 50) -> DataFrame:
    """T5 by key: the page behind ``after`` (None: the first).  Earlier rows are
    filtered in the scan, and what is sorted is a top-k of one page, however deep
    it lies.  Gives the rows of ``browse``."""
    out = _found(df, search)
    by = _sort_columns(out, sort_by, descending)
    if after is None:
        return _sorted(out, by).limit(page_size)
    last, types = dict(zip(df.columns, after.row, strict=True)), dict(df.dtypes)
    behind = F.lit(True)  # rows equal in all columns: some of them have been shown
    for c, down in reversed(by):
        x, v = F.col(f"`{c}`"), F.lit(last[c]).cast(types[c])
        behind = x.eqNullSafe(v) & behind
        if last[c] is not None:  # nulls stand last in both directions
            behind = x.isNull() | (x < v if down else x > v) | behind
    return _sorted(out.where(behind), by).offset(after.shown).limit(page_size)


def page_end(rows: list, before: PageEnd | None = None) -> PageEnd | None:
    """The end of a page from its collected rows."""
    if not rows:
        return before
    last = tuple(rows[-1])
    same = next((i for i, r in enumerate(reversed(rows)) if tuple(r) != last), len(rows))
    return PageEnd(last, same + (before.shown if before and same == len(rows) and before.row == last else 0))
