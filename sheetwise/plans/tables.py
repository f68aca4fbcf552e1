"""The clean tables: ministries, business, budgets, fund_flow, expenditure, line_items.

Input is ``sheet_rows`` (normalized); every builder works from the header
dimension (small) plus one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise import constants as K
from sheetwise.functions.casts import is_numeric_text
from sheetwise.functions.regex import strip_plain
from sheetwise.operators import headers as H
from sheetwise.operators.reshape import regroup_rows
from sheetwise.session import join_per_file, stored
from sheetwise.sources.sheets import data_rows, review_year, sheet_headers


def business_id(year: Column, ordinal: Column) -> Column:
    """``{year}-{ordinal zero-padded to 5}``; wider ordinals keep all digits."""
    digits = ordinal.cast("string")
    padded = F.when(ordinal < 100_000, F.lpad(digits, 5, "0")).otherwise(digits)
    return F.when(ordinal >= 0, F.concat(year.cast("string"), F.lit("-"), padded)).otherwise(F.format_string("%d-%05d", year, ordinal))


def na_to_null(v: Column, policy: str = "default") -> Column:
    """S5: 'default' -> pandas' NA words become NULL; 'empty' -> only ''; 'none' -> nothing."""
    if policy == "default":
        return F.when(v.isin(*K.DEFAULT_NA_WORDS), F.lit(None).cast("string")).otherwise(v)
    if policy == "empty":
        return F.when(v == "", F.lit(None).cast("string")).otherwise(v)
    return v


def sequence_number(text: Column) -> Column:
    """Digits as a number; NULL for anything else and beyond 64 bits."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def _eligible(rows: DataFrame, header_rows: DataFrame | None = None, require_review_sheet: bool = True):
    """Header dimension + eligible files.  ``header_rows`` (the row-0 rows,
    e.g. a saved header table) spares a scan of all rows to find them."""
    # the header dimension is small (files x columns) and read three times
    hdr = stored(sheet_headers(rows if header_rows is None else header_rows), "headers")
    files = H.eligible_files(hdr, require_review_sheet)
    return hdr, files


# --- S9 ministries --------------------------------------------------------------

def ministries(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("ministry_id", T.LongType()), T.StructField("ministry_name", T.StringType())])
    return spark.createDataFrame(K.MINISTRY_MASTER, schema)


def ministry_lookup(name: Column) -> Column:
    """Spelling variants folded, then name -> id; unmatched -> NULL."""
    variants = F.create_map(*[F.lit(x) for kv in K.MINISTRY_NAME_VARIANTS.items() for x in kv])
    master = F.create_map(*[x for i, n in K.MINISTRY_MASTER for x in (F.lit(n), F.lit(i).cast("long"))])
    folded = F.coalesce(F.element_at(variants, name), name)
    return F.element_at(master, folded)


# --- U8 business -------------------------------------------------------------------

def alias_name(clean: Column) -> Column:
    """Ordered alias rules on a cleaned header name."""
    e = None
    for kind, pat, target in K.BUSINESS_ALIAS_RULES:
        cond = (clean == pat) if kind == "eq" else clean.startswith(pat)
        e = F.when(cond, F.lit(target)) if e is None else e.when(cond, F.lit(target))
    return e.otherwise(F.col("name"))


_BUSINESS_TARGETS = ([c for c in K.BUSINESS_COLUMNS if c not in ("business_id", "source_year", "ministry_id", K.PERIOD_OUTPUT)]
                     + [K.PERIOD_COMBINED, K.PERIOD_START, K.PERIOD_END])


def _pos_col(target: str) -> str:
    return f"_p{_BUSINESS_TARGETS.index(target)}"


def business_layout(hdr: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: one integer column per output/period target holding its
    position (P2 aliasing, P3 first duplicate wins); the period source
    columns are looked up by their uncleaned names.  Integer columns make
    each cell read an O(1) array index."""
    # the target is a column of its own, not 30 copies of the alias rules
    named = hdr.withColumn("_clean", H.clean_name(F.col("name"))).withColumn("_target", alias_name(F.col("_clean")))
    return named.join(files, "source_file").groupBy("source_file", "review_year").agg(
        *[F.min(F.when(F.col("_target") == target, F.col("col_idx"))).alias(_pos_col(target)) for target in _BUSINESS_TARGETS])


def business(rows: DataFrame, na_policy: str = "default", header_rows: DataFrame | None = None) -> DataFrame:
    hdr, files = _eligible(rows, header_rows)
    r = join_per_file(data_rows(rows), business_layout(hdr, files))

    def cell(target):
        v = F.try_element_at(F.col("cells"), F.col(_pos_col(target)) + 1)
        return na_to_null(v, na_policy)

    combined, start, end = cell(K.PERIOD_COMBINED), cell(K.PERIOD_START), cell(K.PERIOD_END)
    has_se = F.col(_pos_col(K.PERIOD_START)).isNotNull() & F.col(_pos_col(K.PERIOD_END)).isNotNull()
    s, e = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    from_se = F.when(has_se & (s != "") & (e != ""), F.concat(s, F.lit("-"), e)).otherwise(F.lit(""))
    # The combined column if non-empty, else start-end only if both present
    period = F.when(F.coalesce(combined, F.lit("")) != "", combined).otherwise(from_se)
    out = []
    for c in K.BUSINESS_COLUMNS:
        if c == "business_id":
            out.append(business_id(F.col("review_year"), F.col("row_ordinal")).alias(c))
        elif c == "source_year":
            out.append(F.col("review_year").cast("long").alias(c))
        elif c == "ministry_id":
            out.append(ministry_lookup(cell("府省庁")).alias(c))
        elif c == K.PERIOD_OUTPUT:
            out.append(period.alias(c))
        else:
            out.append(cell(c).alias(c))
    return r.select(*out)


# --- U3 fund flow -----------------------------------------------------------------

def fund_flow(rows: DataFrame, header_rows: DataFrame | None = None) -> DataFrame:
    hdr, files = _eligible(rows, header_rows)
    parsed = H.parse_fund_flow(hdr).join(files, "source_file")
    g = regroup_rows(rows, parsed, ["review_year", "block_id", "seq_text"], "item", K.FUND_FLOW_ITEMS, keep_empty=True)
    items = {x: F.coalesce(strip_plain(F.col(x)), F.lit("")) for x in K.FUND_FLOW_ITEMS}
    seq = sequence_number(F.col("seq_text"))
    primary = (items["支払先費目"] != "") | (items["支払先使途"] != "") | (items["支払先金額(百万円)"] != "")
    total = items["支払先計"]
    # also drops the records without any value
    keep = primary | ((total != "") & (total != "0"))
    return g.where(keep).select(
        business_id(F.col("review_year"), F.col("row_ordinal")).alias("business_id"),
        F.col("block_id"), seq.alias("sequence"),
        *[items[x].alias(x) for x in K.FUND_FLOW_OUTPUT_ITEMS])


# --- U4 expenditure ----------------------------------------------------------------

def expenditure(rows: DataFrame, header_rows: DataFrame | None = None) -> DataFrame:
    hdr, files = _eligible(rows, header_rows)
    parsed = H.parse_expenditure(hdr).join(files, "source_file")
    g = regroup_rows(rows, parsed, ["review_year", "block_id", "seq_text"], "item", K.EXPENDITURE_ITEMS, keep_empty=True)
    # also drops the records without any value
    keep = F.col("支出先").isNotNull() | F.col("支出額").isNotNull()
    return g.where(keep).select(
        business_id(F.col("review_year"), F.col("row_ordinal")).alias("business_id"),
        F.col("block_id"), sequence_number(F.col("seq_text")).alias("sequence"),
        *[F.coalesce(strip_plain(F.col(x)), F.lit("")).alias(x) for x in K.EXPENDITURE_ITEMS])


# --- U5 budgets --------------------------------------------------------------------

def _ranked(files: DataFrame) -> DataFrame:
    """Files with their place among the files of the year, ordered by their names
    with the extension (a copy "X (2).csv" comes before "X.csv"), and the number
    of these: rows of one year's files share ids (Q1)."""
    year = Window.partitionBy("review_year")
    name = F.concat("source_file", F.lit(".csv"))
    return files.withColumn("_rank", F.row_number().over(year.orderBy(name))).withColumn("_files", F.count("*").over(year))


def _merge_shared(per_row: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that share an id: the later file wins cell by cell.  One shuffle of
    (id, rank, values); an id has one row per file of its year, so its list is
    short, and it is merged inside the row -- nothing is sorted by id."""
    values = F.array(*[F.col(f"`{c}`") for c in cols])
    lists = per_row.groupBy("business_id").agg(F.collect_list(F.struct("_rank", values.alias("v"))).alias("_l"))
    later_first = F.sort_array("_l", asc=False)
    nothing = F.array_repeat(F.lit(None).cast("string"), len(cols))
    merged = F.aggregate(later_first, nothing, lambda won, x: F.zip_with(won, x["v"], lambda a, b: F.coalesce(a, b)))
    return lists.select("business_id", merged.alias("_v")).select("business_id", *[F.col("_v")[i].alias(c) for i, c in enumerate(cols)])


def budgets(rows: DataFrame, drop_absent: bool = True, longest_match: bool = False, header_rows: DataFrame | None = None,
            columns: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """One row per business id; every review row yields a record.  Within a
    file the last column wins, in the row itself; across files sharing an id (Q1)
    the later file wins cell by cell.  Values are kept unstripped.

    Years with one review file pass without a shuffle.  ``columns`` builds these
    columns alone, ``only`` (with ``business_id``) these ids alone, before the
    merge.  ``drop_absent`` leaves out columns without any value: they are noticed
    while the unmerged rows are stored, which builds them once.
    """
    hdr, files = _eligible(rows, header_rows)
    files = stored(_ranked(files), "files")
    cols = columns or H.budget_output_columns()
    keys = ["review_year", "_rank", "_files"]
    parsed = H.parse_budget(hdr, files, longest_match).where(F.col("out_col").isin(cols)).join(files, "source_file")
    # every eligible file gets a layout, also one without budget headers
    parsed = parsed.unionByName(files.select("source_file", F.lit(None).cast("int").alias("col_idx"),
                                             F.lit(None).cast("string").alias("out_col"), *keys))

    def rows_of(some: DataFrame) -> DataFrame:
        per_row = regroup_rows(rows, some, keys, "out_col", cols, keep_empty=True)
        per_row = per_row.withColumn("business_id", business_id(F.col("review_year"), F.col("row_ordinal")))
        per_row = per_row.select("business_id", "_rank", "_files", *[F.col(f"`{c}`") for c in cols])
        return per_row if only is None else per_row.join(only.select("business_id").distinct(), "business_id", "left_semi")

    fewest, most = files.agg(F.min("_files"), F.max("_files")).first()
    alone, shared = fewest == 1, (most or 0) > 1
    if drop_absent:
        seen = Observation()
        has = [F.coalesce(F.max(F.col(f"`{c}`").isNotNull()), F.lit(False)).alias(c) for c in cols]
        whole = stored(rows_of(parsed).observe(seen, *has), "budget-rows")
        cols = [c for c in cols if seen.get[c]]
        part = lambda x: whole.where(x)
    else:
        part = lambda x: rows_of(parsed.where(x))
    if not cols:
        return part("_files >= 1").select("business_id").distinct()
    single = lambda: part("_files = 1").select("business_id", *[F.col(f"`{c}`") for c in cols])
    merged = lambda: _merge_shared(part("_files > 1"), cols)
    return single().unionByName(merged()) if alone and shared else merged() if shared else single()


# --- line-item job (U2, U6, F5) ------------------------------------------------------

def line_items(rows: DataFrame, header_rows: DataFrame | None = None) -> DataFrame:
    """Cost lines in long form, first value per (business, group, item_id, type);
    only rows whose amount parses as a number.  No review-sheet gate (Q7)."""
    hdr = stored(sheet_headers(rows if header_rows is None else header_rows), "headers")
    files = hdr.select("source_file").distinct().withColumn("review_year", review_year(F.col("source_file"))) \
        .where(F.col("review_year").isNotNull())
    parsed = H.parse_line_items(hdr).join(files, "source_file")
    # a file without any amount column fails the amount filter as a whole (Q7)
    with_amount = parsed.where(F.col("type") == "金額").select("source_file").distinct()
    parsed = parsed.join(with_amount, "source_file", "left_semi")
    # melt drops missing values (NA words, ''); the pivot keeps the first per
    # (file, business, group, item_id, type) -- all inside one sheet row
    g = regroup_rows(rows, parsed, ["review_year", "group", "item_id"], "type", [t for t, _ in K.LINE_ITEM_TYPES],
                     rule="first", missing=lambda v: na_to_null(v, "default").isNull())
    g = g.withColumn("business_id", business_id(F.col("review_year"), F.col("row_ordinal")))
    g = g.select("business_id", "group", "item_id", *[F.col(t).alias(name) for t, name in K.LINE_ITEM_TYPES])
    return g.where(is_numeric_text(F.col("amount")))
