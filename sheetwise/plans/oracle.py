"""Independent SQL (DuckDB dialect) for the expected results of the registered queries.

The oracle never parses a header: it knows, from the way the derived sheets
encode each table row, which value lands in which output record, and states
that directly.  Only the *cell value* expressions of ``sources.derived`` are
reused, because they are the input, not the logic under test.
"""

from __future__ import annotations

from sheetwise import constants as K
from sheetwise.sources.derived import (LINEITEM_ORDER, LINEITEM_SHEET, ORDERS_BASE_SQL, ORDERS_SHEET,
                                       FIXTURE_MINISTRY_NAMES, budget_value_sql, file_stem_sql, ministry_name_sql)



def ministry_id_sql(key: str) -> str:
    ids = dict((n, i) for i, n in K.MINISTRY_MASTER)
    whens = []
    for i, name in enumerate(FIXTURE_MINISTRY_NAMES):
        mid = ids.get(K.MINISTRY_NAME_VARIANTS.get(name, name))
        whens.append(f"WHEN {i} THEN {'NULL' if mid is None else mid}")
    return f"CAST(CASE ({key}) % {len(FIXTURE_MINISTRY_NAMES)} {' '.join(whens)} END AS BIGINT)"


def ministries_sql() -> str:
    rows = ", ".join(f"({i}, '{n}')" for i, n in K.MINISTRY_MASTER)
    return f"SELECT CAST(ministry_id AS BIGINT) AS ministry_id, ministry_name FROM (VALUES {rows}) t(ministry_id, ministry_name)"


ORDER_ROWS = f"""
ob AS (SELECT *, {ORDERS_BASE_SQL['R']} AS R, {ORDERS_BASE_SQL['grp']} AS grp FROM orders),
o AS (SELECT *, concat({file_stem_sql('R')}, '_', grp) AS source_file FROM ob),
orows AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY o_orderkey) AS rn FROM o),
review AS (SELECT *, printf('%d-%05d', R, rn) AS business_id FROM orows WHERE grp <> 'segment' AND R <= 2019)
"""

LINE_ROWS = f"""
lb AS (SELECT *, year(l_shipdate) + 19 AS R FROM lineitem),
l AS (SELECT *, concat({file_stem_sql('R')}, '_lines') AS source_file FROM lb),
lrows AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY {', '.join(LINEITEM_ORDER)}) AS rn FROM l),
lines AS (SELECT *, printf('%d-%05d', R, rn) AS business_id FROM lrows WHERE R <= 2019)
"""

_NULL = "CAST(NULL AS VARCHAR)"


def business_select() -> str:
    y = "CAST(year(o_orderdate) AS VARCHAR)"
    period = (f"CASE WHEN R = 2014 THEN CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat({y}, '-', CAST(year(o_orderdate) + 2 AS VARCHAR)) END "
              f"WHEN o_orderstatus = 'O' THEN '' ELSE concat({y}, '-', CAST(year(o_orderdate) + 1 AS VARCHAR)) END")
    cols = {
        "business_id": "business_id",
        "source_year": "CAST(R AS BIGINT)",
        "ministry_id": ministry_id_sql("o_custkey"),
        "府省庁": ministry_name_sql("o_custkey"),
        "事業番号-1": "CAST(o_custkey AS VARCHAR)",
        "事業番号-2": "CAST(o_orderkey % 100 AS VARCHAR)",
        "事業名": "concat('事業', CAST(o_orderkey AS VARCHAR))",
        "担当部局庁": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('局', CAST(o_custkey % 7 AS VARCHAR)) END",
        "事業開始終了年度": period,
        "根拠法令（具体的な条項も記載）": "'なし'",
        "政策": "o_orderstatus",
        "施策": f"CASE WHEN R = 2014 THEN {_NULL} ELSE concat('施策', CAST(o_custkey % 10 AS VARCHAR)) END",
        "事業の目的": "concat('目的', CAST(o_orderkey % 13 AS VARCHAR))",
        "事業概要": "o_orderpriority",
        "事業概要URL": "concat('http://example.org/p/', CAST(o_orderkey AS VARCHAR))",
    }
    return ",\n  ".join(f'{cols.get(c, _NULL)} AS "{c}"' for c in K.BUSINESS_COLUMNS)


def business_sql() -> str:
    return f"WITH {ORDER_ROWS} SELECT {business_select()} FROM review"


# --- budgets ----------------------------------------------------------------------

def _nz(v: str) -> str:
    return f"NULLIF({v}, '')"


def budget_columns_sql() -> dict[str, str]:
    req = "CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(CAST(floor(o_totalprice / 900) AS BIGINT) AS VARCHAR) END"
    ratio = "CASE WHEN o_orderkey % 4 = 0 THEN '95.5' ELSE '' END"
    return {
        "予算の状況当初予算_py3": _nz(budget_value_sql(-3)),
        "執行額_py3": "CAST(CAST(floor(o_totalprice / 100) AS BIGINT) % 3000 AS VARCHAR)",
        "予算の状況当初予算_py2": _nz(budget_value_sql(-2)),
        "予算の状況当初予算_py1": _nz(budget_value_sql(-1)),
        # the ratio column stands later and also standardizes to 執行額 (Q2)
        "執行額_py1": f"coalesce({_nz(ratio)}, CAST(CAST(floor(o_totalprice / 1100) AS BIGINT) AS VARCHAR))",
        "予算の状況当初予算": _nz(budget_value_sql(0)),
        "予算の状況計": "CASE WHEN o_orderkey % 6 = 0 THEN 'NA' ELSE CAST(o_custkey % 70 AS VARCHAR) END",
        "要求予算の状況当初予算_req": _nz(req),
        # a +1-year past item becomes _req (Q3); the 2014 request form is dropped (Q4)
        "予算の状況計_req": "CASE WHEN R = 2014 THEN NULL ELSE CAST(o_custkey % 50 AS VARCHAR) END",
    }


def budgets_sql() -> str:
    cols = budget_columns_sql()
    per_row = ", ".join(f'{v} AS "{k}"' for k, v in cols.items())
    agg = ", ".join(f"""arg_max("{k}", source_file || '.csv') FILTER (WHERE "{k}" IS NOT NULL) AS "{k}\"""" for k in cols)
    return (f"WITH {ORDER_ROWS}, brow AS (SELECT business_id, source_file, {per_row} FROM review) "
            f"SELECT business_id, {agg} FROM brow GROUP BY business_id")


# --- fund flow / expenditure / line items ---------------------------------------------

def fund_flow_sql() -> str:
    def rec(block, seq, fee="''", use="''", amt="''", tot="''", where="TRUE"):
        s = "CAST(NULL AS INTEGER)" if seq is None else f"CAST({seq} AS INTEGER)"
        return (f"SELECT business_id, '{block}' AS block_id, {s} AS sequence, {fee} AS \"支払先費目\", {use} AS \"支払先使途\", "
                f"{amt} AS \"支払先金額(百万円)\", {tot} AS \"支払先計\" FROM lines WHERE {where}")

    tax = "CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR)"
    parts = [
        rec("A", 1, "l_returnflag", "l_linestatus", "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"),
        rec("A", None, tot=tax, where=f"{tax} <> '0'"),
        rec("B", 1, fee="l_returnflag", where="l_discount > 0.05"),
        rec("B", 1, amt="CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)"),
        rec("C", 2, use="CASE WHEN l_linenumber % 2 = 1 THEN concat('再', CAST(l_linenumber AS VARCHAR)) "
                        "ELSE concat(l_returnflag, l_linestatus) END"),
        rec("D", 3, fee="'NA'", where="l_linenumber = 4"),
    ]
    return f"WITH {LINE_ROWS} " + " UNION ALL ".join(parts)


def expenditure_sql() -> str:
    items = K.EXPENDITURE_ITEMS
    block = "CASE WHEN R = 2014 THEN 'グループ' ELSE 'A' END"

    def rec(seq, vals, where="TRUE"):
        sel = ", ".join(f"{vals.get(it, chr(39) * 2)} AS \"{it}\"" for it in items)
        return f"SELECT business_id, {block} AS block_id, CAST({seq} AS INTEGER) AS sequence, {sel} FROM lines WHERE {where}"

    one = {
        "支出先": "concat('S', CAST(l_suppkey AS VARCHAR))",
        "支出額": "CAST(CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS VARCHAR)",
        "入札者数": "CAST(l_linenumber AS VARCHAR)",
        "契約方式": "CASE WHEN l_returnflag = 'R' THEN '一般競争入札' ELSE '随意契約' END",
        items[-1]: "CASE WHEN l_discount < 0.03 THEN concat('一者応札のため', CAST(l_partkey % 10 AS VARCHAR)) ELSE '' END",
    }
    two = {"業務概要": "concat('業務', CAST(l_partkey % 100 AS VARCHAR))", "支出先": "concat('T', CAST(l_suppkey AS VARCHAR))"}
    return f"WITH {LINE_ROWS} " + rec(1, one) + " UNION ALL " + rec(2, two, "l_linenumber % 2 = 0")


def line_items_sql() -> str:
    return (f"WITH {LINE_ROWS} "
            "SELECT business_id, 'A' AS \"group\", '00' AS item_id, l_returnflag AS expense_item, l_linestatus AS purpose, "
            "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS amount FROM lines "
            "UNION ALL SELECT business_id, 'B', '00', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), "
            "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) FROM lines")


def business_key_sql() -> str:
    keys = " ".join(f"WHEN instr(source_file, '{k}') > 0 THEN {y}" for k, y in K.FILENAME_YEAR_KEYS)
    return (f"WITH {ORDER_ROWS}, k AS (SELECT source_file, o_orderkey, CAST(rn AS BIGINT) AS row_ordinal, "
            f"CASE {keys} END AS source_year FROM orows) "
            "SELECT source_file, o_orderkey, row_ordinal, printf('%d-%05d', source_year, row_ordinal) AS business_id, "
            "CAST(source_year AS INTEGER) AS source_year FROM k WHERE source_year IS NOT NULL")


# --- analytics on the built tables --------------------------------------------------

def _review_budget(column: str = "予算の状況当初予算") -> str:
    """Straight from the numbers: id, ministry, project name and one budget column
    of every review order, budgets merged over ids (the later file wins)."""
    value = budget_columns_sql()[column]
    return (f"WITH {ORDER_ROWS}, rv AS (SELECT {business_select()}, source_file, {value} AS v FROM review), "
            "merged AS (SELECT business_id AS i, arg_max(v, source_file || '.csv') FILTER (WHERE v IS NOT NULL) AS v FROM rv GROUP BY business_id), "
            "p AS (SELECT merged.i, rv.ministry_id AS mid, rv.\"事業名\" AS project, TRY_CAST(merged.v AS DOUBLE) AS amount FROM rv, merged WHERE merged.i = rv.business_id)")


def _ministry_name(key: str) -> str:
    return f"(SELECT list_extract([{', '.join(chr(39) + n + chr(39) for _, n in K.MINISTRY_MASTER)}], list_position([{', '.join(str(i) for i, _ in K.MINISTRY_MASTER)}], {key})))"


def top_count_sql(n: int = 10) -> str:
    return (f"{_review_budget()}, c AS (SELECT mid, count(*) AS business_count FROM p WHERE mid IS NOT NULL GROUP BY mid) "
            f"SELECT {_ministry_name('mid')} AS ministry_name, business_count FROM c "
            f"QUALIFY row_number() OVER (ORDER BY business_count DESC, {_ministry_name('mid')}) <= {n}")


def top_budget_sql(ministry: str = "デジタル庁", n: int = 10) -> str:
    number = next(i for i, name in K.MINISTRY_MASTER if name == ministry)
    return (f'{_review_budget()} SELECT project AS "事業名", amount AS "当初予算額_百万円" FROM p WHERE mid = {number} AND amount IS NOT NULL '
            f"QUALIFY row_number() OVER (ORDER BY amount DESC, project) <= {n}")


def top_sum_sql(n: int = 5) -> str:
    return (f"{_review_budget()}, s AS (SELECT mid, sum(amount) AS total_budget FROM p WHERE mid IS NOT NULL GROUP BY mid) "
            f"SELECT {_ministry_name('mid')} AS ministry_name, total_budget FROM s "
            f"QUALIFY row_number() OVER (ORDER BY total_budget DESC NULLS LAST, {_ministry_name('mid')}) <= {n}")


def cast_filter_sql(ministry: str = "財務省", threshold: float = 1000) -> str:
    number = next(i for i, name in K.MINISTRY_MASTER if name == ministry)
    return (f"{_review_budget('執行額_py3')} SELECT i AS business_id, project AS \"事業名\", amount AS \"執行額_py3\" FROM p "
            f"WHERE mid = {number} AND amount > {threshold}")


def text_filter_sql(word: str = "一者応札") -> str:
    reason = K.EXPENDITURE_ITEMS[-1]
    return (f"SELECT business_id, \"業務概要\", \"支出先\", \"{reason}\" FROM ({expenditure_sql()}) e "
            f"WHERE contains(\"{reason}\", '{word}')")


# --- normalization ------------------------------------------------------------------

from sheetwise.sources.derived import (CUSTOMER_FILE_SQL, COST_ITEM_SQL, HYPHENS,  # noqa: E402
                                       HYPHEN_TEXT_SQL, LINEITEM_BASE_SQL, WAREKI_TEXT_SQL, _bit)

_ERA_OFF = [1867, 1911, 1925, 1988, 2018]


def _off(idx: str) -> str:
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(_ERA_OFF)) + " END"


def _bare(n: str) -> str:
    return f"CAST(CASE WHEN {n} <= 5 THEN 2018 + {n} ELSE 1988 + {n} END AS VARCHAR)"


def wareki_sql() -> str:
    k = "o_orderkey"
    a, b = f"({k} % 20 + 1)", f"({k} % 20 + 1 + {k} % 5)"
    y = f"CASE WHEN {k} % 7 = 0 THEN 1 ELSE {k} % 30 + 1 END"
    expected = (
        f"concat(CAST({k} % 20 + 1 AS VARCHAR), '. 目的、', CAST({_off(f'{k} % 5')} + {y} AS VARCHAR), '年、', "
        f"CAST({_off(f'CAST(floor({k} / 5) AS BIGINT) % 5')} + {k} % 30 + 1 AS VARCHAR), '、', "
        f"CASE WHEN {k} % 2 = 0 THEN concat(CAST(1988 + {a} AS VARCHAR), '～', CAST(1988 + {b} AS VARCHAR)) "
        f"ELSE concat(CAST(1988 + {a} AS VARCHAR), '〜', {_bare(b)}) END, '年度、', {_bare(f'({k} % 40 + 1)')}, '年度')")
    src = WAREKI_TEXT_SQL.replace("AS STRING", "AS VARCHAR")
    return f"SELECT o_orderkey, {src} AS text, {expected} AS normalized FROM orders"


def hyphens_sql() -> str:
    idx = "p_partkey % 9"
    kept = (f"CASE {idx} WHEN {K.HYPHEN_CODEPOINTS.index(0xFF0D)} THEN '-' "
            f"WHEN {K.HYPHEN_CODEPOINTS.index(0x2011)} THEN '{chr(0x2010)}' "
            f"ELSE substring('{HYPHENS}', CAST({idx} + 1 AS INT), 1) END")
    expected = (f"concat('コンピュータ、東京大阪、事業番号-', CAST(p_partkey % 10 AS VARCHAR), "
                f"'、リスト-グループ-支出先、リスト', {kept}, 'グループ')")
    return f"SELECT p_partkey, {HYPHEN_TEXT_SQL.replace('AS STRING', 'AS VARCHAR')} AS text, {expected} AS normalized FROM part"


# --- gate and header catalogues -----------------------------------------------------

def gate_sql() -> str:
    n = " + ".join(f"CAST({_bit(i)} AS INTEGER)" for i in range(5))
    return (f"SELECT {CUSTOMER_FILE_SQL.replace('AS STRING', 'AS VARCHAR')} AS source_file, CAST({n} AS INTEGER) AS n_required, "
            f"(c_custkey % 7 = 0) AS has_exclusion, ({n} >= 3 AND NOT (c_custkey % 7 = 0)) AS is_review_sheet FROM customer")


def item_catalog_sql() -> str:
    cost = f"trim({COST_ITEM_SQL}, ' ')"
    payee = ("CASE c_custkey % 4 WHEN 0 THEN '入札者数' WHEN 1 THEN '契約方式' WHEN 2 THEN c_mktsegment ELSE '支出額' END")
    payee14 = "CASE c_nationkey % 3 WHEN 0 THEN '支出先' WHEN 1 THEN '業務概要' ELSE lower(c_mktsegment) END"
    return (f"SELECT DISTINCT 'cost' AS catalog, {cost} AS item FROM customer "
            f"UNION SELECT DISTINCT 'payee', {payee} FROM customer "
            f"UNION SELECT DISTINCT 'payee', {payee14} FROM customer WHERE c_custkey % 2 = 0")


def _workbook_header_sql(table: str, base: dict, spec: list) -> str:
    files = (f"SELECT DISTINCT concat({file_stem_sql('R')}, '_', grp) AS source_file, R, grp FROM "
             f"(SELECT {base['R']} AS R, {base['grp']} AS grp FROM {table})")
    parts = [f"SELECT source_file, CASE WHEN R = 2014 THEN {h14} ELSE {h15} END AS name FROM f"
             for h15, h14, _ in spec]
    return f"WITH f AS ({files}) " + " UNION ALL ".join(p.replace("AS STRING", "AS VARCHAR") for p in parts)


def header_matrix_sql() -> str:
    names = (f"SELECT * FROM ({_workbook_header_sql('orders', ORDERS_BASE_SQL, ORDERS_SHEET)}) "
             f"UNION ALL SELECT * FROM ({_workbook_header_sql('lineitem', LINEITEM_BASE_SQL, LINEITEM_SHEET)})")
    kw = " OR ".join(f"contains(name, '{w}')" for w in K.HEADER_MATRIX_KEYWORDS)
    return f"SELECT DISTINCT name AS column_name, source_file, 1 AS present FROM ({names}) h WHERE {kw}"


def header_matrix_wide_sql() -> str:
    """Every name with every file, then one column per file there is."""
    cells = (f"SELECT n.column_name, f.source_file, CAST(p.source_file IS NOT NULL AS INTEGER) AS mark FROM (SELECT DISTINCT column_name FROM p0) n, "
             "(SELECT DISTINCT source_file FROM files) f LEFT JOIN p0 p ON p.column_name = n.column_name AND p.source_file = f.source_file")
    files = (f"SELECT source_file FROM ({_workbook_header_sql('orders', ORDERS_BASE_SQL, ORDERS_SHEET)}) "
             f"UNION SELECT source_file FROM ({_workbook_header_sql('lineitem', LINEITEM_BASE_SQL, LINEITEM_SHEET)})")
    return f"WITH p0 AS ({header_matrix_sql()}), files AS ({files}), cells AS ({cells}) SELECT * FROM (PIVOT cells ON source_file USING max(mark) GROUP BY column_name)"


# --- catalog --------------------------------------------------------------------------

INT_RE = r"^\s*[+-]?[0-9]+\s*$"


def infer_types_sql() -> str:
    from sheetwise.functions.casts import NUMERIC_TEXT
    parts = []
    specs = [("business", f"({business_sql()})", K.BUSINESS_COLUMNS, {"source_year": "BIGINT", "ministry_id": "BIGINT"}),
             ("budgets", f"({budgets_sql()})", ["business_id"] + list(budget_columns_sql()), {})]
    for tname, src, cols, fixed in specs:
        for i, c in enumerate(cols):
            if c in fixed:
                parts.append(f"SELECT '{tname}' AS table_name, CAST({i} AS INTEGER) AS position, '{c}' AS column_name, "
                             f"'{fixed[c]}' AS inferred_type")
                continue
            q = f'"{c}"'
            parts.append(
                f"SELECT '{tname}' AS table_name, CAST({i} AS INTEGER) AS position, '{c}' AS column_name, "
                f"CASE WHEN count({q}) = 0 THEN 'VARCHAR' "
                f"WHEN count(CASE WHEN regexp_matches({q}, '{INT_RE}') AND TRY_CAST(trim({q}) AS BIGINT) IS NOT NULL THEN 1 END) = count({q}) THEN 'BIGINT' "
                f"WHEN count(CASE WHEN regexp_matches({q}, '{NUMERIC_TEXT}') THEN 1 END) = count({q}) THEN 'DOUBLE' "
                f"ELSE 'VARCHAR' END AS inferred_type FROM {src} t")
    return " UNION ALL ".join(parts)


# --- run log ----------------------------------------------------------------------------

RUNS_LATEST = """
ex AS (SELECT user_id AS id, event_id, ts AS "timestamp", event_type, value,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r,
              count(*) OVER (PARTITION BY user_id) AS n FROM events),
folded AS (SELECT id, "timestamp", concat('question ', CAST(id AS VARCHAR)) AS question,
                  concat('SELECT ', event_type) AS sql_query,
                  CASE WHEN event_type <> 'error' THEN 'success' ELSE 'error' END AS status,
                  CAST(floor(value * 1000) AS BIGINT) AS duration_ms, CAST(n AS BIGINT) AS execution_count,
                  k, event_type FROM ex WHERE r = 1)
"""
_FOLD_COLS = 'id, "timestamp", question, sql_query, status, duration_ms, execution_count'


def fold_reruns_sql() -> str:
    return f"WITH {RUNS_LATEST} SELECT {_FOLD_COLS} FROM folded"


def latest_runs_sql(n: int = 20) -> str:
    return f'WITH {RUNS_LATEST} SELECT {_FOLD_COLS} FROM folded ORDER BY "timestamp" DESC, id DESC LIMIT {n}'


def live_runs_sql() -> str:
    return (f"WITH {RUNS_LATEST} SELECT {_FOLD_COLS} FROM folded WHERE id NOT IN "
            "(SELECT user_id FROM events WHERE event_type = 'signup' AND value > 250)")


def run_stats_sql() -> str:
    return (f"WITH {RUNS_LATEST} SELECT id, status, CASE WHEN status = 'success' THEN k % 5 END AS row_count, "
            "CASE WHEN status = 'error' THEN concat('failed: ', event_type, ' ', CAST(k AS VARCHAR)) END AS error FROM folded")


def publish_manifest_sql() -> str:
    tables = {"ministries": ministries_sql(), "business": business_sql(), "budgets": budgets_sql(), "fund_flow": fund_flow_sql(), "expenditure": expenditure_sql()}
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) AS read_back FROM ({q})" for t, q in tables.items())


def _described() -> list[tuple[str, int, str, str]]:
    fixed = {"source_year": "BIGINT", "ministry_id": "BIGINT"}
    return ([("business", i, c, fixed.get(c, "VARCHAR")) for i, c in enumerate(K.BUSINESS_COLUMNS)]
            + [("ministries", 0, "ministry_id", "BIGINT"), ("ministries", 1, "ministry_name", "VARCHAR")])


def describe_tables_sql() -> str:
    values = ", ".join(f"('{t}', {i}, '{c}', '{k}')" for t, i, c, k in _described())
    return f"SELECT * FROM (VALUES {values}) v(table_name, position, column_name, data_type)"


def schema_prompt_sql() -> str:
    text = "# データベーススキーマ\n**テーブル一覧:** `business`, `ministries`\n\n"
    for table in ("business", "ministries"):
        text += f"## テーブル: `{table}`\n\n| カラム名 | データ型 |\n|---|---|\n"
        text += "".join(f"| `{c}` | `{k}` |\n" for t, _, c, k in _described() if t == table) + "\n"
    return f"SELECT DISTINCT '{text}---' || chr(10) || o_orderpriority || chr(10) || '{text}' AS prompt FROM orders"


def guarded_query_sql() -> str:
    return ("SELECT 'value' AS query, event_type, CASE WHEN event_type <> 'error' THEN max(value) END AS most, 'run' AS outcome FROM events GROUP BY event_type "
            "UNION ALL SELECT 'no_such_column', NULL, NULL, 'skipped'")


def sheet_csv_lines_sql() -> str:
    note = """CASE WHEN o_orderkey % 3 = 0 THEN 'first' || chr(10) || chr(10) || '"' || o_orderpriority || '",' || chr(13) || chr(10) || 'last' ELSE o_orderpriority END"""
    return f"SELECT o_orderkey, {note} AS note, o_orderstatus AS status, true AS in_order FROM orders"


def workbook_cells_sql() -> str:
    return ("SELECT 'database2016_S' AS source_file, o_orderkey, o_orderpriority || '<br>' || o_orderstatus || '<br>end' AS text, "
            "CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE '' END AS status, 'database2016.xlsx' AS workbook FROM orders WHERE o_orderkey % 2 = 0")


def selective_quotes_sql() -> str:
    return ("""SELECT o_orderkey || ',' || o_custkey || ',"' || CASE WHEN o_orderkey % 3 = 0 THEN 'a ""q"", ' || o_orderstatus ELSE '' END || '","' || o_orderpriority || '"' AS value FROM orders""")


def browse_sql(search: str = "事業1", sort_by: str = "事業名", page: int = 1, size: int = 20) -> str:
    cols = K.BUSINESS_COLUMNS
    hit = " OR ".join(f"coalesce(contains(CAST(\"{c}\" AS VARCHAR), '{search}'), false)" for c in cols)
    order = f'"{sort_by}" DESC NULLS LAST, ' + ", ".join(f'"{c}" ASC NULLS LAST' for c in cols)
    return f"SELECT * FROM ({business_sql()}) b WHERE {hit} ORDER BY {order} LIMIT {size} OFFSET {page * size}"


# --- header trace (U9): the expected reading of every review-sheet header ---------------

# spec column -> (raw item, year offset from the review year, tail in the 2014
# layout, expected item for the 2015+ layout, expected item for the 2014 layout)
_TRACE_BUDGET = {
    13: ("予算の状況当初予算", -3, "", "予算の状況当初予算", "予算の状況当初予算"),
    14: ("予算の状況当初予算", -2, "", "予算の状況当初予算", "予算の状況当初予算"),
    15: ("予算の状況当初予算", -1, "", "予算の状況当初予算", "予算の状況当初予算"),
    16: ("予算の状況当初予算", 0, "", "予算の状況当初予算", "予算の状況当初予算"),
    17: ("要求予算の状況当初予算", 1, "要求", "要求予算の状況当初予算", "要求予算の状況当初予算"),
    18: ("執行額", -3, "", "執行額", "執行額"),
    19: ("執行額", -1, "", "執行額", "執行額"),
    20: ("当初予算+補正予算に対する執行額の割合(%)", -1, "", "執行額", "執行額"),  # Q2
    21: ("執行額", -6, "", "執行額", "執行額"),  # F6
    22: ("予算の状況計", 1, "要求", "予算の状況計", None),  # Q3 / Q4
    23: ("予算の状況計", 0, "", "予算の状況計", "予算の状況計"),
}
_SUFFIX = {-3: "_py3", -2: "_py2", -1: "_py1", 0: "", 1: "_req"}


def header_trace_sql() -> str:
    keys = " ".join(f"WHEN instr(source_file, '{k}') > 0 THEN {y}" for k, y in K.FILENAME_YEAR_KEYS)
    files = (f"SELECT DISTINCT concat({file_stem_sql('R')}, '_', grp) AS source_file, R, grp FROM "
             f"(SELECT {ORDERS_BASE_SQL['R']} AS R, {ORDERS_BASE_SQL['grp']} AS grp FROM orders)")
    parts = []
    for i, (h15, h14, _) in enumerate(ORDERS_SHEET):
        name = f"CASE WHEN R = 2014 THEN {h14} ELSE {h15} END".replace("AS STRING", "AS VARCHAR")
        if i not in _TRACE_BUDGET:
            parts.append(
                f"SELECT source_file, CAST({i} AS INTEGER) AS col_idx, {name} AS name, review_year, "
                "CAST(NULL AS VARCHAR) AS matched_rule, CAST(NULL AS VARCHAR) AS raw_item, CAST(NULL AS INTEGER) AS target_year, "
                "CAST(NULL AS BOOLEAN) AS is_request, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS INTEGER) AS relative_year, "
                "CAST(NULL AS VARCHAR) AS out_col, CASE WHEN review_year IS NULL THEN 'no review year in file name' "
                "ELSE 'no budget grammar matches' END AS reject_reason FROM f")
            continue
        raw, off, tail, item15, item14 = _TRACE_BUDGET[i]
        req15, req14 = "要求" in raw, ("要求" in raw or "要求" in tail)

        def lit(v):
            return "NULL" if v is None else f"'{v}'"

        req = f"CASE WHEN R = 2014 THEN {str(req14).upper()} ELSE {str(req15).upper()} END"
        item = f"CASE WHEN R = 2014 THEN {lit(item14)} ELSE {lit(item15)} END"
        # target year - review year is the offset the sheet was built with
        rel = f"CASE WHEN {item} IS NULL THEN NULL WHEN {req} THEN 1 WHEN review_year IS NULL THEN NULL ELSE {off} END"
        suffix = "CASE " + " ".join(f"WHEN ({rel}) = {k} THEN '{v}'" for k, v in _SUFFIX.items()) + " END"
        reason = (f"CASE WHEN review_year IS NULL THEN 'no review year in file name' WHEN {item} IS NULL THEN 'item not listed' "
                  f"WHEN NOT (({rel}) BETWEEN -3 AND 1) THEN 'relative year out of range' END")
        parts.append(
            f"SELECT source_file, CAST({i} AS INTEGER) AS col_idx, {name} AS name, review_year, "
            f"CASE WHEN R = 2014 THEN '2014' ELSE '2015+' END AS matched_rule, '{raw}' AS raw_item, "
            f"CAST(R + {off} AS INTEGER) AS target_year, {req} AS is_request, {item} AS item, "
            f"CAST({rel} AS INTEGER) AS relative_year, CASE WHEN ({reason}) IS NULL THEN concat({item}, {suffix}) END AS out_col, "
            f"{reason} AS reject_reason FROM f")
    return (f"WITH f0 AS ({files}), f AS (SELECT source_file, R, grp, CAST(CASE {keys} END AS INTEGER) AS review_year FROM f0) "
            + " UNION ALL ".join(parts))


# --- sinks, sources and views read back ------------------------------------------------

def run_history_sql(n: int = 50) -> str:
    return (f"SELECT f.id, f.timestamp, f.question, f.sql_query, f.status, f.duration_ms, f.execution_count, s.row_count, s.error "
            f"FROM ({fold_reruns_sql()}) f JOIN ({run_stats_sql()}) s ON s.id = f.id "
            f"QUALIFY row_number() OVER (ORDER BY f.timestamp DESC, f.id DESC) <= {n}")


def run_log_import_sql(times: int) -> str:
    """The folded log, and ``times`` copies of it numbered on from its greatest id."""
    n = "(SELECT count(*) FROM folded)"
    copies = [f"""SELECT (SELECT max(id) FROM folded) + {k} * {n} + row_number() OVER (ORDER BY id), "timestamp", question, sql_query, status, duration_ms, execution_count FROM folded""" for k in range(times)]
    return f"WITH {RUNS_LATEST} SELECT {_FOLD_COLS} FROM folded UNION ALL " + " UNION ALL ".join(copies)


def run_log_deletes_sql() -> str:
    """Runs and deletes one after another per user: an id begins with its first run
    and is gone if any delete of it, or of everything, comes later."""
    return """
WITH ev AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS place, event_id = 4 AS clears, event_type = 'signup' AND value > 150 AND event_id <> 4 AS deletes FROM events),
runs AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, min(place) OVER (PARTITION BY user_id) AS born, max(place) OVER (PARTITION BY user_id) AS newest FROM ev WHERE NOT clears AND NOT deletes)
SELECT user_id AS id, ts AS "timestamp", concat('question ', CAST(user_id AS VARCHAR)) AS question, concat('SELECT ', event_type) AS sql_query,
  CASE WHEN event_type <> 'error' THEN 'success' ELSE 'error' END AS status, CAST(floor(value * 1000) AS BIGINT) AS duration_ms, CAST(n AS BIGINT) AS execution_count
FROM runs r WHERE place = newest AND NOT EXISTS (SELECT 1 FROM ev d WHERE d.place > r.born AND (d.clears OR (d.deletes AND d.user_id = r.user_id)))
"""


def csv_roundtrip_sql() -> str:
    return ("SELECT CAST(o_orderkey AS VARCHAR) AS k, '  ' || o_orderpriority || '  ' AS padded, "
            "CASE WHEN o_orderkey % 3 = 0 THEN 'a \"q\", b' ELSE o_orderstatus END AS quoted FROM orders")


def item_list_sql() -> str:
    return "SELECT DISTINCT o_orderpriority AS value FROM orders"


def melt_sql() -> str:
    return ("SELECT o_orderkey, 'o_orderstatus' AS original_column, o_orderstatus AS value FROM orders UNION ALL "
            "SELECT o_orderkey, 'o_orderpriority', CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END FROM orders WHERE o_orderkey % 4 <> 0")


def concat_sql() -> str:
    return "SELECT c_custkey AS k, c_name AS name, NULL::BIGINT AS nation FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier"


def sql_views_sql() -> str:
    return f"SELECT ministry_id, count(*) AS n FROM ({business_sql()}) GROUP BY ministry_id"

