"""Fixed values.

Everything in this module is a value that must equal the source system's for
identical results: names, word lists, year keys, item lists and patterns.
They are stated plainly, in their natural order, and are not derived.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: ministry master (id, name), 24 rows
# ---------------------------------------------------------------------------
MINISTRY_MASTER = [
    (1, "内閣官房"), (2, "内閣府"), (3, "宮内庁"), (4, "公正取引委員会"), (5, "警察庁"),
    (6, "個人情報保護委員会"), (7, "カジノ管理委員会"), (8, "金融庁"), (9, "消費者庁"), (10, "こども家庭庁"),
    (11, "デジタル庁"), (12, "復興庁"), (13, "総務省"), (14, "法務省"), (15, "外務省"),
    (16, "財務省"), (17, "文部科学省"), (18, "厚生労働省"), (19, "農林水産省"), (20, "経済産業省"),
    (21, "国土交通省"), (22, "環境省"), (23, "原子力規制委員会"), (99, "防衛省"),
]

# FIXED VALUES: whole-value spelling variants of ministry names -> master spelling
MINISTRY_NAME_VARIANTS = {
    "原子力規制員会": "原子力規制委員会",
    "特定個人情報保護委員会": "個人情報保護委員会",
}

# FIXED VALUES: file-name key -> review year; the first key contained in the
# file name wins, so this order matters.
FILENAME_YEAR_KEYS = [
    ("database240918", 2023), ("database240502", 2022), ("database220524", 2021),
    ("database_220427", 2020), ("database2019_220427", 2019), ("database2018_220427", 2018),
    ("database2017", 2017), ("database2016", 2016), ("database2015", 2015),
    ("database2014", 2014),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: review-sheet gate
# ---------------------------------------------------------------------------
REVIEW_SHEET_REQUIRED = ["府省", "府省庁", "事業名", "事業番号", "事業番号-1"]
REVIEW_SHEET_MIN_REQUIRED = 3
REVIEW_SHEET_EXCLUSION = "セグメント名"

# ---------------------------------------------------------------------------
# FIXED VALUES: business table
# ---------------------------------------------------------------------------
BUSINESS_COLUMNS = [
    "business_id", "source_year", "ministry_id", "府省庁",
    "事業番号-1", "事業番号-2", "事業番号-3", "事業番号-4", "事業番号-5",
    "事業名", "担当部局庁", "作成責任者", "事業開始終了年度", "担当課室",
    "会計区分", "根拠法令（具体的な条項も記載）", "関係する計画、通知等",
    "政策", "施策", "政策体系・評価書URL", "主要経費", "事業の目的",
    "現状・課題", "事業概要", "事業概要URL", "実施方法",
]

# Header alias rules, tried in this order; kind is "eq" (whole name) or
# "prefix" (name starts with the pattern).  The first hit renames the column.
BUSINESS_ALIAS_RULES = [
    ("eq", "府省", "府省庁"),
    ("eq", "事業番号", "事業番号-1"),
    ("prefix", "事業の目的", "事業の目的"),
    ("eq", "事業概要URL", "事業概要URL"),
    ("prefix", "事業概要", "事業概要"),
    ("prefix", "根拠法令", "根拠法令（具体的な条項も記載）"),
    ("prefix", "現状・課題", "現状・課題"),
    ("eq", "政策・施策名", "政策"),
    ("eq", "主要政策・施策", "政策"),
    ("eq", "主要施策", "施策"),
]

# Period columns (looked up by their names before cleaning)
PERIOD_COMBINED = "事業開始・終了(予定)年度"
PERIOD_START = "事業開始年度"
PERIOD_END = "事業終了(予定)年度"
PERIOD_OUTPUT = "事業開始終了年度"

# pandas' default missing-value words (read_csv keep_default_na=True)
DEFAULT_NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: fund flow
# ---------------------------------------------------------------------------
FUND_FLOW_ITEMS = ["支払先使途", "支払先計", "支払先費目", "支払先金額(百万円)"]
FUND_FLOW_OUTPUT_ITEMS = ["支払先費目", "支払先使途", "支払先金額(百万円)", "支払先計"]
FUND_FLOW_RE_WITH_SEQ = r"費目・使途.*?([A-Za-z])\.(.+?)-(\d+)$"
FUND_FLOW_RE_NO_SEQ = r"費目・使途.*?([A-Za-z])\.(.+)$"

# ---------------------------------------------------------------------------
# FIXED VALUES: expenditure (payee top-10 lists)
# ---------------------------------------------------------------------------
EXPENDITURE_PREFIX = "支出先上位10者リスト"
EXPENDITURE_ITEMS = [
    "番号", "支出先", "業務概要", "支出額", "入札者数", "落札率", "契約方式", "契約方式等",
    "法人番号", "一者応札・一者応募又は競争性のない随意契約となった理由及び改善策",
]
EXPENDITURE_RE_2015 = r"支出先上位10者リスト-([A-Za-z])\.支払先-(\d+)-(.+)"
EXPENDITURE_RE_2014 = r"支出先上位10者リスト-グループ-(.+?)-(\d+)$"
EXPENDITURE_BLOCK_2014 = "グループ"
EXPENDITURE_ITEM_CLEANUP = r"\(.*\)|-\d+$"

# ---------------------------------------------------------------------------
# FIXED VALUES: budgets
# ---------------------------------------------------------------------------
PAST_BUDGET_ITEMS = [
    "予算の状況予備費等", "予算の状況前年度から繰越し", "予算の状況当初予算",
    "予算の状況翌年度へ繰越し", "予算の状況補正予算", "予算の状況計",
    "執行率(%)", "執行額", "当初予算+補正予算に対する執行額の割合(%)",
]
REQUEST_BUDGET_ITEMS = ["要求予算の状況当初予算", "要求予算の状況計"]
BUDGET_RE_2015 = r".*?-(\d{4})年度(.*)"
BUDGET_RE_2014 = r".*?-(.*?)-(\d{4})年度(.*)"
BUDGET_REQUEST_WORD = "要求"
# relative year -> column suffix
BUDGET_SUFFIXES = [(-3, "_py3"), (-2, "_py2"), (-1, "_py1"), (0, ""), (1, "_req")]

# ---------------------------------------------------------------------------
# FIXED VALUES: line-item script and header catalogues
# ---------------------------------------------------------------------------
LINE_ITEM_RE = r"費目・使途.*?-([A-Za-z])\..*?(費目|使途|金額).*?-?(\d{2})?"
LINE_ITEM_PREFIX = "費目・使途"
LINE_ITEM_TYPES = [("費目", "expense_item"), ("使途", "purpose"), ("金額", "amount")]
LINE_ITEM_MISSING_ID = "00"
COST_ITEM_CATALOG_RE = r"費目・使途.*?-[A-Z]\.(.+?)-\d+$"
PAYEE_ITEM_CATALOG_RE_2015 = r"支出先上位10者リスト-[A-Z]\.支払先-\d+-(.+?)(?:-\d+)?$"
PAYEE_ITEM_CATALOG_RE_2014 = r"支出先上位10者リスト-グループ-(.+?)-\d+$"
PAYEE_ITEM_PAREN = r"\(.*\)"
HEADER_MATRIX_KEYWORDS = ["予算", "執行", "支出", "費目"]

# ---------------------------------------------------------------------------
# FIXED VALUES: text normalization
# ---------------------------------------------------------------------------
CIRCLED_DIGITS = [
    ("①", "1"), ("②", "2"), ("③", "3"), ("④", "4"), ("⑤", "5"),
    ("⑥", "6"), ("⑦", "7"), ("⑧", "8"), ("⑨", "9"), ("⑩", "10"),
    ("⑪", "11"), ("⑫", "12"), ("⑬", "13"), ("⑭", "14"), ("⑮", "15"),
    ("⑯", "16"), ("⑰", "17"), ("⑱", "18"), ("⑲", "19"), ("⑳", "20"),
]
CIRCLED_MARKER_SUFFIX = ". "
# era name / letter -> year offset (calendar year = offset + era year; 元 = 1)
ERA_OFFSETS = [
    ("明治", 1867), ("M", 1867),
    ("大正", 1911), ("T", 1911),
    ("昭和", 1925), ("S", 1925),
    ("平成", 1988), ("H", 1988),
    ("令和", 2018), ("R", 2018),
]
ERA_FIRST_YEAR = "元"
TILDE = "～"
# bare "NN年度": NN <= 5 -> Reiwa (2018 + NN), else Heisei (1988 + NN)
BARE_YEAR_REIWA_MAX = 5
BARE_YEAR_REIWA_OFFSET = 2018
BARE_YEAR_HEISEI_OFFSET = 1988
# hyphen-like code points: - ‐ ‑ ‒ – — ― − －
HYPHEN_CODEPOINTS = [0x002D, 0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212, 0xFF0D]
LONG_VOWEL_MARK = "ー"
# misspelt group label (its hyphens stand for any hyphen) -> repaired label
GROUP_LABEL_REPAIR = ("リスト-グル-プ", "リスト-グループ")
# protected label (its hyphen stands for any hyphen); kept exactly as written
GROUP_LABEL_PROTECTED = "リスト-グループ"
KATAKANA_RANGE = "ァ-ヴ"
KANA_KANJI_RANGE = "ぁ-んァ-ヴ一-龠"

# ---------------------------------------------------------------------------
# FIXED VALUES: schema document
# ---------------------------------------------------------------------------
SCHEMA_DOCUMENT = {
    "title": "# データベーススキーマ\n",
    "names": "**テーブル一覧:** `%s`\n\n",
    "table": "## テーブル: `%s`\n\n| カラム名 | データ型 |\n|---|---|\n",
    "column": "| `%s` | `%s` |\n",
}
SCHEMA_PLACE = "{{schema}}"
