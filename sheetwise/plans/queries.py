"""Registered queries: name -> (Spark builder, oracle SQL or None).

Each builder takes ``(spark, sf_dir)``, reads the driver tables in full, runs the
small jobs that store headers, layouts and ordinals, and returns a DataFrame.  The
oracle is DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise import constants as K
from sheetwise.operators import analytics as A
from sheetwise.plans import oracle as O
from sheetwise.plans import tables as TB
from sheetwise.operators.reshape import concat_tables, melt
from sheetwise.session import configure, scratch_folder, stored
from sheetwise.sinks import versions
from sheetwise.sinks.writers import write_csv, write_item_list, write_selective_quoted
from sheetwise.functions.casts import nan_to_null
from sheetwise.functions.text import normalize_text
from sheetwise.operators import catalog as C
from sheetwise.operators import headers as H
from sheetwise.operators import runs as R
from sheetwise.operators.matrix import header_matrix, header_presence
from sheetwise.operators.ordinal import dense_ordinal
from sheetwise.plans.job import normalize_sheet_rows, publish
from sheetwise.sources.derived import (HYPHEN_TEXT_SQL, WAREKI_TEXT_SQL, customer_header_sheets, lineitem_headers,
                                       lineitem_workbook, orders_files, orders_headers, orders_workbook, write_workbooks)
from sheetwise.sources.sheets import read_parts_and_heads, read_sheet_csv, review_year, sheet_headers, write_sheet_csv
from sheetwise.sources.workbooks import ingest_workbooks

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = (run, oracle)
        return run
    return deco


def _build(fn, workbook, **kw):
    rows, heads = workbook
    return fn(rows, header_rows=heads, **kw)


def _with_budget(spark, sf_dir, column: str, ministry: str | None = None):
    """(business, ministries, budgets with one column).  For one ministry, its
    projects are found first, and only their budgets are built and merged."""
    rows, heads = orders_workbook(spark, sf_dir)
    business, ministries = TB.business(rows, header_rows=heads).select("business_id", "ministry_id", "事業名"), TB.ministries(spark)
    if ministry:
        business = stored(A.of_ministry(business, ministries, ministry), "projects")
    return business, ministries, TB.budgets(rows, drop_absent=False, header_rows=heads, columns=[column], only=business if ministry else None)


# --- tables -----------------------------------------------------------------------

@register("business", O.business_sql)
def q_business(spark, sf_dir):
    """U8 with P1-P8, F1, J3, J4: the business table from the review sheets."""
    return _build(TB.business, orders_workbook(spark, sf_dir))


@register("budgets", O.budgets_sql)
def q_budgets(spark, sf_dir):
    """U5 with H6-H10, F6, Q1-Q4: the budget table."""
    return _build(TB.budgets, orders_workbook(spark, sf_dir))


@register("fund_flow", O.fund_flow_sql)
def q_fund_flow(spark, sf_dir):
    """U3 with H1, H2, F2, F3, A3, Q5, Q6."""
    return _build(TB.fund_flow, lineitem_workbook(spark, sf_dir))


@register("expenditure", O.expenditure_sql)
def q_expenditure(spark, sf_dir):
    """U4 with H3-H5, F4, F7."""
    return _build(TB.expenditure, lineitem_workbook(spark, sf_dir))


@register("line_items", O.line_items_sql)
def q_line_items(spark, sf_dir):
    """U2/U6 with H11, F5, A4, Q7."""
    return _build(TB.line_items, lineitem_workbook(spark, sf_dir))


@register("business_key", O.business_key_sql)
def q_business_key(spark, sf_dir):
    """W1 + P7 + P8: dense row ordinal per file, year key, business id."""
    files = orders_files(spark, sf_dir).select("source_file", "o_orderkey")
    data = dense_ordinal(files, "source_file", ["o_orderkey"])
    data = data.withColumn("source_year", review_year(F.col("source_file"))).where(F.col("source_year").isNotNull())
    return data.select("source_file", "o_orderkey", "row_ordinal",
                       TB.business_id(F.col("source_year"), F.col("row_ordinal")).alias("business_id"),
                       F.col("source_year").cast("int").alias("source_year"))


# --- analytics ---------------------------------------------------------------------

@register("top_count", O.top_count_sql)
def q_top_count(spark, sf_dir):
    """Projects per ministry, top 10."""
    return A.top_count(_build(TB.business, orders_workbook(spark, sf_dir)), TB.ministries(spark), 10)


@register("top_budget", O.top_budget_sql)
def q_top_budget(spark, sf_dir):
    """A ministry's projects by current initial budget, top 10."""
    return A.top_budget(*_with_budget(spark, sf_dir, "予算の状況当初予算", "デジタル庁"), ministry="デジタル庁", n=10)


@register("top_sum", O.top_sum_sql)
def q_top_sum(spark, sf_dir):
    """D3: total current initial budget per ministry, top 5."""
    return A.top_sum(*_with_budget(spark, sf_dir, "予算の状況当初予算"), n=5)


@register("cast_filter", O.cast_filter_sql)
def q_cast_filter(spark, sf_dir):
    """A ministry's projects whose execution three years back exceeds 1000."""
    return A.cast_filter(*_with_budget(spark, sf_dir, "執行額_py3", "財務省"), ministry="財務省", column="執行額_py3", threshold=1000)


@register("text_filter", O.text_filter_sql)
def q_text_filter(spark, sf_dir):
    """Contracts whose reason is a single bid: work and payee."""
    e = _build(TB.expenditure, lineitem_workbook(spark, sf_dir))
    return A.text_filter(e, K.EXPENDITURE_ITEMS[-1], "一者応札", ["business_id", "業務概要", "支出先"])


# --- normalization ----------------------------------------------------------------

@register("wareki", O.wareki_sql)
def q_wareki(spark, sf_dir):
    """N1-N6 (+N2 on full-width digits, N10): era years, ranges, bare fiscal years, circled digits."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    t = o.select("o_orderkey", F.expr(WAREKI_TEXT_SQL).alias("text"))
    return t.select("o_orderkey", "text", normalize_text(F.col("text")).alias("normalized"))


@register("hyphens", O.hyphens_sql)
def q_hyphens(spark, sf_dir):
    """N7-N9 (+N2): label repair, protected label, katakana long vowel, dashes between kanji."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    t = p.select("p_partkey", F.expr(HYPHEN_TEXT_SQL).alias("text"))
    return t.select("p_partkey", "text", normalize_text(F.col("text")).alias("normalized"))


@register("business_normalized", O.business_sql)
def q_business_normalized(spark, sf_dir):
    """N11 at table scale: normalize every header and cell, then build business."""
    # headers come from their own small table, so the normalized data rows
    # have one consumer and stream straight into the build (the stage job,
    # ``run_job``, still writes stage 2 as a table)
    # cells and headers are made unclean first: full-width digits, spaces at the edges
    rows, heads = (x.withColumn("cells", F.transform("cells", lambda c: F.concat(F.lit(" \u3000"), F.translate(c, "0123456789", "０１２３４５６７８９"), F.lit("\u3000 "))))
                   for x in orders_workbook(spark, sf_dir))
    return TB.business(normalize_sheet_rows(rows), header_rows=normalize_sheet_rows(heads))


@register("normalize_documents")
def q_normalize_documents(spark, sf_dir):
    """N1-N11 over whole document texts (DuckDB has no NFKC: rows-only check)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", normalize_text(F.col("text")).alias("text"))


# --- headers ------------------------------------------------------------------------

@register("gate_sheets", O.gate_sql)
def q_gate_sheets(spark, sf_dir):
    """Review-sheet gate over one header-only sheet per customer."""
    return H.review_sheet_gate(sheet_headers(customer_header_sheets(spark, sf_dir)))


@register("item_catalog", O.item_catalog_sql)
def q_item_catalog(spark, sf_dir):
    """Distinct cost items and payee-list items over all headers."""
    hdr = sheet_headers(customer_header_sheets(spark, sf_dir))
    return (H.cost_item_catalog(hdr).select(F.lit("cost").alias("catalog"), "item")
            .unionByName(H.payee_item_catalog(hdr).select(F.lit("payee").alias("catalog"), "item")).distinct())


@register("header_matrix", O.header_matrix_sql)
def q_header_matrix(spark, sf_dir):
    """Keyword header names and the files that have them."""
    return header_presence(sheet_headers(orders_headers(spark, sf_dir).unionByName(lineitem_headers(spark, sf_dir))))


@register("header_matrix_wide", O.header_matrix_wide_sql)
def q_header_matrix_wide(spark, sf_dir):
    """The same as a matrix over all files, 1/0, from one bit set per name."""
    return header_matrix(sheet_headers(orders_headers(spark, sf_dir).unionByName(lineitem_headers(spark, sf_dir))))


@register("header_trace", O.header_trace_sql)
def q_header_trace(spark, sf_dir):
    """How every header of the review sheets is read by the budget grammars."""
    return H.explain_budget_headers(sheet_headers(orders_headers(spark, sf_dir)))


# --- catalog -------------------------------------------------------------------------

@register("infer_types", O.infer_types_sql)
def q_infer_types(spark, sf_dir):
    """C4 (and C2 via the schemas): narrowest type per column of business and budgets."""
    rows, heads = orders_workbook(spark, sf_dir)
    return (C.infer_types(TB.business(rows, header_rows=heads), "business")
            .unionByName(C.infer_types(TB.budgets(rows, header_rows=heads), "budgets")))


@register("publish_manifest", O.publish_manifest_sql)
def q_publish_manifest(spark, sf_dir):
    """The table set is published, and its manifest (rows counted by the writes) set beside what is read back."""
    (orows, oheads), (lrows, lheads) = orders_workbook(spark, sf_dir), lineitem_workbook(spark, sf_dir)
    folder = scratch_folder(spark, "published")
    counted = publish({"ministries": TB.ministries(spark), "business": TB.business(orows, header_rows=oheads),
                       "budgets": TB.budgets(orows, drop_absent=False, header_rows=oheads), "fund_flow": TB.fund_flow(lrows, header_rows=lheads),
                       "expenditure": TB.expenditure(lrows, header_rows=lheads)}, folder)
    back = [df.agg(F.count("*").alias("read_back")).select(F.lit(t).alias("table_name"), "read_back") for t, df in versions.read_set(spark, folder).items()]
    return counted.join(reduce(DataFrame.unionByName, back), "table_name")


@register("browse", O.browse_sql)
def q_browse(spark, sf_dir):
    """T5: search / sort / page over the business table; the second page by the key the first one ended with."""
    table = _build(TB.business, orders_workbook(spark, sf_dir))
    how = dict(search="事業1", sort_by="事業名", descending=True, page_size=20)
    return A.browse_after(table, **how, after=A.page_end(A.browse_after(table, **how).collect()))


@register("describe_tables", O.describe_tables_sql)
def q_describe_tables(spark, sf_dir):
    """The registered tables and their columns."""
    tables = {"business": _build(TB.business, orders_workbook(spark, sf_dir)), "ministries": TB.ministries(spark)}
    C.register_tables(spark, tables)
    found = [t for t in C.list_tables(spark) if t in tables]
    return C.describe_tables(spark, {t: spark.table(t) for t in found})


@register("schema_prompt", O.schema_prompt_sql)
def q_schema_prompt(spark, sf_dir):
    """The schema document of the business table, placed in a prompt per order priority."""
    document = C.schema_markdown(C.describe_tables(spark, {"business": _build(TB.business, orders_workbook(spark, sf_dir)), "ministries": TB.ministries(spark)}))
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority").distinct()
    return C.prompt(asked.select(F.concat(F.lit("{{schema}}---\n"), "o_orderpriority", F.lit("\n{{schema}}")).alias("template")), document)


@register("guarded_query", O.guarded_query_sql)
def q_guarded_query(spark, sf_dir):
    """A query on a column that is there, one on a column that is not (skipped), NaN results as null."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    def totals(column):
        v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col(column))
        return nan_to_null(e.groupBy("event_type").agg(F.max(v).alias("most"))).select(F.lit(column).alias("query"), "event_type", "most", F.lit("run").alias("outcome"))
    skipped = lambda c: spark.createDataFrame([(c, None, None, "skipped")], "query string, event_type string, most double, outcome string")
    return reduce(DataFrame.unionByName, [totals(c) if C.column_present(e, c) else skipped(c) for c in ("value", "no_such_column")])


# --- run log ---------------------------------------------------------------------------

def _folded(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return R.fold_reruns(R.executions_from_events(ev)), ev


_FOLD_OUT = ["id", "timestamp", "question", "sql_query", "status", "duration_ms", "execution_count"]


@register("fold_reruns", O.fold_reruns_sql)
def q_fold_reruns(spark, sf_dir):
    """The run log folded to one current row per history id."""
    return _folded(spark, sf_dir)[0].select(*_FOLD_OUT)


@register("latest_runs", O.latest_runs_sql)
def q_latest_runs(spark, sf_dir):
    """The 20 newest runs, ties by id."""
    return R.latest_runs(_folded(spark, sf_dir)[0], 20).select(*_FOLD_OUT)


@register("live_runs", O.live_runs_sql)
def q_live_runs(spark, sf_dir):
    """Runs left after deleting the ids named by the delete requests."""
    folded, ev = _folded(spark, sf_dir)
    tomb = ev.where((F.col("event_type") == "signup") & (F.col("value") > 250)).select(F.col("user_id").alias("id"))
    return R.delete_runs(folded, tomb).select(*_FOLD_OUT)


@register("run_stats", O.run_stats_sql)
def q_run_stats(spark, sf_dir):
    """Status, result row count and error text per run."""
    return R.run_stats(_folded(spark, sf_dir)[0])


@register("run_history", O.run_history_sql)
def q_run_history(spark, sf_dir):
    """The 50 newest runs with result size and error."""
    return R.run_history(_folded(spark, sf_dir)[0], 50).select(*_FOLD_OUT, "row_count", "error")


def _as_driver_table(folded):
    return folded.select(*_FOLD_OUT).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _exported(spark, sf_dir):
    """(the executions, a folder with their folded log exported)."""
    folded, ev = _folded(spark, sf_dir)
    path = scratch_folder(spark, "runs")
    R.export_runs(folded, path)
    return R.executions_from_events(ev.withColumn("ts", F.col("ts").cast("timestamp"))), path


@register("run_log_roundtrip", lambda: O.run_log_import_sql(1))
def q_run_log_roundtrip(spark, sf_dir):
    """The folded log is exported, imported (under new ids), appended to the executions and folded again."""
    log, path = _exported(spark, sf_dir)
    return _as_driver_table(R.fold_reruns(R.append_run(log, R.import_runs(spark, path, log))))


@register("run_log_import", lambda: O.run_log_import_sql(2))
def q_run_log_import(spark, sf_dir):
    """An exported log imported twice gives every record two new entries."""
    log, path = _exported(spark, sf_dir)
    for _ in range(2):
        log = R.append_run(log, R.import_runs(spark, path, log))
    return _as_driver_table(R.fold_reruns(log))


@register("run_log_deletes", O.run_log_deletes_sql)
def q_run_log_deletes(spark, sf_dir):
    """Deletes of one entry and of all entries among the runs; later reruns of a deleted id change nothing."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    one, everything = (F.col("event_type") == "signup") & (F.col("value") > 150), F.col("event_id") == 4
    executions = R.executions_from_events(ev.where(~(one | everything)))
    return R.fold_log(executions, R.deletes_from_events(ev, one, everything)).select(*_FOLD_OUT)


# --- sinks and sources read back ------------------------------------------------------------

@register("fund_flow_from_csv", O.fund_flow_sql)
def q_fund_flow_from_csv(spark, sf_dir):
    """The payee sheets as all-quoted CSV, read back, and the table built from them."""
    path = scratch_folder(spark, "sheets")
    write_sheet_csv(lineitem_workbook(spark, sf_dir)[0], path, compression="gzip")
    return _build(TB.fund_flow, read_parts_and_heads(spark, path))


@register("sheet_csv_lines", O.sheet_csv_lines_sql)
def q_sheet_csv_lines(spark, sf_dir):
    """S4 on files of another writer: quoted cells with line feeds, quotes and commas; rows in the order of the file."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('first\n\n"'), "o_orderpriority", F.lit('",\r\nlast'))).otherwise(F.col("o_orderpriority"))
    d = o.select(F.col("o_orderkey").cast("string").alias("key"), note.alias("note"), F.col("o_orderstatus").alias("status"))
    path = scratch_folder(spark, "foreign-csv")
    (d.repartitionByRange(4, F.col("key").cast("long")).sortWithinPartitions(F.col("key").cast("long"))
     .write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    rows = read_sheet_csv(spark, f"{path}/part-*.csv").where("row_ordinal > 0").select(
        "source_file", F.col("cells")[0].cast("long").alias("o_orderkey"), F.col("cells")[1].alias("note"), F.col("cells")[2].alias("status"), F.col("row_ordinal").alias("read_as"))
    return dense_ordinal(rows, "source_file", ["o_orderkey"]).select("o_orderkey", "note", "status", (F.col("read_as") == F.col("row_ordinal")).alias("in_order"))


@register("workbooks_business", O.business_sql)
def q_workbooks_business(spark, sf_dir):
    """The review sheets as workbooks -- some only zipped, some loose with an outdated zip of the same name beside them -- ingested, and the business table built from them."""
    rows = orders_workbook(spark, sf_dir)[0]
    rows = rows.withColumn("book", F.expr("left(source_file, length(source_file) - length(sheet) - 1)"))
    loose = F.regexp_extract("book", "[0-9]{4}", 0).cast("int") % 2 == 0
    outdated = F.when(loose & (F.col("row_ordinal") > 0), F.transform("cells", lambda c: F.concat(F.lit("旧"), c))).otherwise(F.col("cells"))
    folder = scratch_folder(spark, "workbooks")
    write_workbooks(rows.where(loose), folder)
    write_workbooks(rows.withColumn("cells", outdated), folder, zipped=True)
    return TB.business(ingest_workbooks(spark, folder))


@register("workbook_cells", O.workbook_cells_sql)
def q_workbook_cells(spark, sf_dir):
    """One target workbook of two; line breaks become <br>, carriage returns go, empty cells are empty text."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("book", F.when(F.col("o_orderkey") % 2 == 0, "database2016").otherwise("database2017"))
    cells = F.array(F.col("o_orderkey").cast("string"), F.concat("o_orderpriority", F.lit("\n"), "o_orderstatus", F.lit("\nend")), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")))
    folder = scratch_folder(spark, "workbooks")
    write_workbooks(o.select("book", F.lit("S").alias("sheet"), F.col("o_orderkey").alias("row_ordinal"), cells.alias("cells")), folder)
    rows = ingest_workbooks(spark, folder, target_files=["database2016.xlsx"])
    return rows.select("source_file", F.col("cells")[0].cast("long").alias("o_orderkey"), F.col("cells")[1].alias("text"), F.col("cells")[2].alias("status"), "workbook")


@register("selective_quotes", O.selective_quotes_sql)
def q_selective_quotes(spark, sf_dir):
    """K3: ids plain, other columns quoted with doubled quotes, null as an empty quoted field; written and read back as lines."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('a "q", '), "o_orderstatus")).alias("note"), "o_orderpriority")
    path = scratch_folder(spark, "selective")
    write_selective_quoted(d, path, ["o_orderkey", "o_custkey"])
    return spark.read.text(path).where(F.col("value") != ",".join(d.columns))


@register("csv_roundtrip", O.csv_roundtrip_sql)
def q_csv_roundtrip(spark, sf_dir):
    """K2, K4: minimal quoting, spaces kept, written and read back."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = o.select(F.col("o_orderkey").cast("string").alias("k"), F.concat(F.lit("  "), "o_orderpriority", F.lit("  ")).alias("padded"),
                 F.when(F.col("o_orderkey") % 3 == 0, 'a "q", b').otherwise(F.col("o_orderstatus")).alias("quoted"))
    path = scratch_folder(spark, "csv")
    write_csv(d, path)
    return spark.read.option("header", True).option("escape", '"').schema(d.schema).csv(path)


@register("item_list", O.item_list_sql)
def q_item_list(spark, sf_dir):
    """Sorted distinct items, one per line, read back."""
    path = scratch_folder(spark, "items")
    write_item_list(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("item")), path)
    return spark.read.text(path)


@register("melt", O.melt_sql)
def q_melt(spark, sf_dir):
    """Columns to rows, missing values dropped."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return melt(o, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@register("concat", O.concat_sql)
def q_concat(spark, sf_dir):
    """O1: frames with different columns, one under the other."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("nation"))
    return concat_tables([c, s])


@register("sql_views", O.sql_views_sql)
def q_sql_views(spark, sf_dir):
    """A SQL text over the registered tables."""
    C.register_tables(spark, {"business": _build(TB.business, orders_workbook(spark, sf_dir))})
    return spark.sql("SELECT ministry_id, count(*) AS n FROM business GROUP BY ministry_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1]() for k, v in QUERIES.items() if v[1] is not None}
