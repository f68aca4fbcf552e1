"""Header-dimension operators: cleaning, the review-sheet gate, and the grammars.

All of these run on ``sheet_headers`` (files x columns, a small table), once
per distinct header -- never per cell.  Their results are joined back to the
cells through per-file layouts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise import constants as K
from sheetwise.functions import regex as R
from sheetwise.sources.sheets import review_year


def clean_name(col: Column) -> Column:
    """Drop LF, CR and ASCII space from a header name."""
    return F.translate(col, "\n\r ", "")


def review_sheet_gate(headers: DataFrame) -> DataFrame:
    """F1/O2: per file, how many of the required names occur (as a set) and
    whether the exclusion name occurs; a review sheet has >= 3 and no exclusion."""
    c = clean_name(F.col("name"))
    flags = [F.max(F.when(c == n, 1).otherwise(0)) for n in K.REVIEW_SHEET_REQUIRED]
    n_req = flags[0]
    for f in flags[1:]:
        n_req = n_req + f
    g = headers.groupBy("source_file").agg(
        n_req.cast("int").alias("n_required"),
        (F.max(F.when(c == K.REVIEW_SHEET_EXCLUSION, 1).otherwise(0)) == 1).alias("has_exclusion"))
    return g.withColumn("is_review_sheet",
                        (F.col("n_required") >= K.REVIEW_SHEET_MIN_REQUIRED) & ~F.col("has_exclusion"))


def eligible_files(headers: DataFrame, require_review_sheet: bool = True) -> DataFrame:
    """Files with a known review year (and, by default, passing the gate)."""
    files = review_sheet_gate(headers).withColumn("review_year", review_year(F.col("source_file")))
    files = files.where(F.col("review_year").isNotNull())
    if require_review_sheet:
        files = files.where("is_review_sheet")
    return files.select("source_file", "review_year")


def _in(col: Column, values: list[str]) -> Column:
    return col.isin(*values)


# --- fund flow (H1, H2) ------------------------------------------------------------

def parse_fund_flow(headers: DataFrame) -> DataFrame:
    n = F.col("name")
    with_seq, no_seq = R.match(K.FUND_FLOW_RE_WITH_SEQ), R.match(K.FUND_FLOW_RE_NO_SEQ)
    h1 = n.rlike(with_seq)
    block = F.when(h1, F.regexp_extract(n, with_seq, 1)).otherwise(R.extract(n, no_seq, 1))
    item = F.when(h1, F.regexp_extract(n, with_seq, 2)).otherwise(R.extract(n, no_seq, 2))
    seq = F.when(h1, F.regexp_extract(n, with_seq, 3)).otherwise(F.when(n.rlike(no_seq), F.lit("")))
    out = headers.select("source_file", "col_idx", block.alias("block_id"), R.py_strip(item).alias("item"),
                         seq.alias("seq_text"))
    return out.where(_in(F.col("item"), K.FUND_FLOW_ITEMS))


# --- expenditure (H3, H4, H5) ------------------------------------------------------

def parse_expenditure(headers: DataFrame) -> DataFrame:
    n = F.col("name")
    p15, p14 = R.match(K.EXPENDITURE_RE_2015), R.match(K.EXPENDITURE_RE_2014)
    m15 = n.rlike(p15)
    block = F.when(m15, F.regexp_extract(n, p15, 1)).otherwise(F.when(n.rlike(p14), F.lit(K.EXPENDITURE_BLOCK_2014)))
    seq = F.when(m15, F.regexp_extract(n, p15, 2)).otherwise(R.extract(n, p14, 2))
    raw = F.when(m15, F.regexp_extract(n, p15, 3)).otherwise(R.extract(n, p14, 1))
    item = R.py_strip(F.regexp_replace(raw, R.search(K.EXPENDITURE_ITEM_CLEANUP), ""))
    out = (headers.where(n.startswith(K.EXPENDITURE_PREFIX))
           .select("source_file", "col_idx", block.alias("block_id"), seq.alias("seq_text"), item.alias("item")))
    return out.where((F.coalesce(F.col("seq_text"), F.lit("")) != "") & _in(F.col("item"), K.EXPENDITURE_ITEMS))


# --- budgets (H6-H10, F6) ----------------------------------------------------------

def standardize_budget_item(raw: Column, is_request: Column, longest_match: bool = False) -> Column:
    """H9: first listed item that is a substring of the raw item;
    ``longest_match=True`` prefers the longest such item instead."""
    def first_hit(items):
        ordered = sorted(items, key=len, reverse=True) if longest_match else items
        e = None
        for it in ordered:
            cond = F.instr(raw, it) > 0
            e = F.when(cond, F.lit(it)) if e is None else e.when(cond, F.lit(it))
        return e
    return F.when(is_request, first_hit(K.REQUEST_BUDGET_ITEMS)).otherwise(first_hit(K.PAST_BUDGET_ITEMS))


def parse_budget(headers: DataFrame, files: DataFrame, longest_match: bool = False) -> DataFrame:
    """Budget headers of eligible files -> (source_file, col_idx, out_col).

    ``files`` carries ``review_year`` per file.
    """
    n = F.col("name")
    p14, p15 = R.fullmatch(K.BUDGET_RE_2014), R.fullmatch(K.BUDGET_RE_2015)
    m14, m15 = n.rlike(p14), n.rlike(p15)
    raw = F.when(m14, F.regexp_extract(n, p14, 1)).when(m15, F.regexp_extract(n, p15, 2))
    year = F.when(m14, F.regexp_extract(n, p14, 2)).when(m15, F.regexp_extract(n, p15, 1)).cast("int")
    tail = F.when(m14, F.regexp_extract(n, p14, 3)).otherwise(F.lit(""))
    h = headers.join(files, "source_file").select("source_file", "col_idx", "review_year",
                                                  raw.alias("raw_item"), year.alias("target_year"), tail.alias("tail"))
    h = h.where(F.col("raw_item").isNotNull())
    is_req = (F.instr("raw_item", K.BUDGET_REQUEST_WORD) > 0) | (F.instr("tail", K.BUDGET_REQUEST_WORD) > 0)
    h = h.withColumn("is_request", is_req)
    h = h.withColumn("item", standardize_budget_item(F.col("raw_item"), F.col("is_request"), longest_match))
    rel = F.when(F.col("is_request"), F.lit(1)).otherwise(F.col("target_year") - F.col("review_year"))
    h = h.withColumn("rel", rel).where(F.col("item").isNotNull() & F.col("rel").between(-3, 1))
    suffix = F.element_at(F.create_map(*[F.lit(x) for pair in K.BUDGET_SUFFIXES for x in pair]), F.col("rel"))
    return h.select("source_file", "col_idx", F.concat(F.col("item"), suffix).alias("out_col"))


def budget_output_columns() -> list[str]:
    """Known budget columns in output order, then the +1-year past items (Q3)."""
    known = [it + sfx for rel, sfx in K.BUDGET_SUFFIXES if rel <= 0 for it in K.PAST_BUDGET_ITEMS]
    known += [it + "_req" for it in K.REQUEST_BUDGET_ITEMS]
    extra = [it + "_req" for it in K.PAST_BUDGET_ITEMS]
    return known + extra


# --- line items of the cost table (H11) ---------------------------------------------

def parse_line_items(headers: DataFrame) -> DataFrame:
    n = F.col("name")
    p = R.search(K.LINE_ITEM_RE)
    hit = n.rlike(p)
    item_id = F.regexp_extract(n, p, 3)
    return (headers.where(n.startswith(K.LINE_ITEM_PREFIX) & hit)
            .select("source_file", "col_idx", F.regexp_extract(n, p, 1).alias("group"),
                    F.regexp_extract(n, p, 2).alias("type"),
                    F.when(item_id == "", F.lit(K.LINE_ITEM_MISSING_ID)).otherwise(item_id).alias("item_id")))


# --- header catalogues (H12, H13, F8) -----------------------------------------------

def cost_item_catalog(headers: DataFrame) -> DataFrame:
    p = R.match(K.COST_ITEM_CATALOG_RE)
    return (headers.where(F.col("raw_name").rlike(p))
            .select(R.py_strip(F.regexp_extract("raw_name", p, 1)).alias("item")).distinct())


def payee_item_catalog(headers: DataFrame) -> DataFrame:
    n = F.col("raw_name")
    p15, p14 = R.match(K.PAYEE_ITEM_CATALOG_RE_2015), R.match(K.PAYEE_ITEM_CATALOG_RE_2014)
    raw = F.when(n.rlike(p15), F.regexp_extract(n, p15, 1)).when(n.rlike(p14), F.regexp_extract(n, p14, 1))
    item = R.py_strip(F.regexp_replace(raw, R.search(K.PAYEE_ITEM_PAREN), ""))
    return (headers.where(n.startswith(K.EXPENDITURE_PREFIX)).select(raw.alias("raw"), item.alias("item"))
            .where(F.coalesce(F.col("raw"), F.lit("")) != "").select("item").distinct())


def keyword_headers(headers: DataFrame) -> DataFrame:
    """F8: header names containing any keyword."""
    cond = None
    for kw in K.HEADER_MATRIX_KEYWORDS:
        c = F.instr(F.col("raw_name"), kw) > 0
        cond = c if cond is None else cond | c
    return headers.where(cond)


def explain_budget_headers(headers: DataFrame) -> DataFrame:
    """How each header of each file is read by the budget grammars:
    (source_file, col_idx, name, review_year, matched_rule, raw_item, target_year,
    is_request, item, relative_year, out_col, reject_reason)."""
    n = F.col("name")
    p14, p15 = R.fullmatch(K.BUDGET_RE_2014), R.fullmatch(K.BUDGET_RE_2015)
    m14, m15 = n.rlike(p14), n.rlike(p15)
    h = headers.select("source_file", "col_idx", "name", review_year(F.col("source_file")).alias("review_year"),
                       F.when(m14, "2014").when(m15, "2015+").alias("matched_rule"),
                       F.when(m14, F.regexp_extract(n, p14, 1)).when(m15, F.regexp_extract(n, p15, 2)).alias("raw_item"),
                       F.when(m14, F.regexp_extract(n, p14, 2)).when(m15, F.regexp_extract(n, p15, 1)).cast("int").alias("target_year"),
                       F.when(m14, F.regexp_extract(n, p14, 3)).otherwise(F.lit("")).alias("_tail"))
    req = (F.instr("raw_item", K.BUDGET_REQUEST_WORD) > 0) | (F.instr("_tail", K.BUDGET_REQUEST_WORD) > 0)
    h = h.withColumn("is_request", F.when(F.col("matched_rule").isNotNull(), req))
    h = h.withColumn("item", standardize_budget_item(F.col("raw_item"), F.col("is_request")))
    rel = F.when(F.col("is_request"), F.lit(1)).otherwise(F.col("target_year") - F.col("review_year"))
    h = h.withColumn("relative_year", F.when(F.col("item").isNotNull(), rel))
    suffix = F.element_at(F.create_map(*[F.lit(x) for pair in K.BUDGET_SUFFIXES for x in pair]), F.col("relative_year"))
    reason = (F.when(F.col("review_year").isNull(), "no review year in file name")
              .when(F.col("matched_rule").isNull(), "no budget grammar matches")
              .when(F.col("item").isNull(), "item not listed")
              .when(~F.col("relative_year").between(-3, 1), "relative year out of range"))
    return h.select("source_file", "col_idx", "name", "review_year", "matched_rule", "raw_item", "target_year",
                    "is_request", "item", "relative_year",
                    F.when(reason.isNull(), F.concat(F.col("item"), suffix)).alias("out_col"),
                    reason.alias("reject_reason"))
