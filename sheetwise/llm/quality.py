"""Quality rules by weak supervision (native: DataFrame functions only).

Each rule looks at a document and votes *bad*, *good* or abstains.  No rule is
trusted: expectation-maximisation over the votes of all documents estimates how
often each rule votes bad on documents of each kind, and a document's posterior
probability of being good replaces "every rule must pass".  Documents are bad in
different ways that do not go together, so there is one kind of good documents
and one kind of bad ones per rule, of those that this rule is first to object
to; their accuracies are all estimated.  EM runs on the table of distinct vote
vectors, of which there are at most 3^rules whatever the input; each step is one
aggregate over that table and returns one row of parameters.

Defined results: a null text counts as empty (no words, fails the base rule);
equal texts get equal verdicts; an empty table gives an empty result; every row
is judged by itself, so repeated rows stay repeated; extra columns pass through
``filter_quality`` untouched, whatever their names.

Two windows of five words are equal when their 64-bit hashes are (within one
document only; chance of an error below 1e-11 for 20,000 words).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 5
BAD, GOOD, ABSTAIN = 1, -1, 0


@dataclass(frozen=True)
class Rule:
    """Votes bad above/below ``bad``, good beyond ``good``, else abstains.
    ``of`` names the measure; ``low`` means that small values are bad."""
    name: str
    of: str
    bad: float
    good: float
    low: bool = False


RULES = (
    Rule("length", "n_words", 10, 20, low=True),
    Rule("symbols", "symbol_share", 0.10, 0.02),
    Rule("capitals", "capital_share", 0.40, 0.15),
    Rule("duplicate_lines", "line_share", 0.50, 0.50),
    Rule("repeats", "repeat_share", 0.20, 0.20),
    Rule("word_length", "mean_chars", 16.0, 12.0),
    Rule("variety", "distinct_share", 0.15, 0.30, low=True),
)
ITERATIONS = 8
SMOOTH = 0.1
KEEP_AT = 0.5


def _pick(columns: Column, i: Column) -> Column:
    return F.get(columns, i)


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures to ``df``; all of them are computed inside the row."""
    clean = F.coalesce(F.col(text), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"
    d = df.withColumns({"w": C.words_of(F.col(text)), "lines": F.filter(F.split(clean, "\n"), lambda x: x.rlike(has_word))})
    n = F.size("w")
    window = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[_pick(F.col("w"), i + k) for k in range(WINDOW)])))
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(clean, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_lines": F.size("lines"),
        "n_distinct": F.size(F.array_distinct("w")),
        "n_capitals": F.length(F.regexp_replace(clean, r"[^A-Z]+", "")),
        "h": window,
    })
    # only texts in which a window occurs twice go through the sort
    order = F.when(F.size("h") > F.size(F.array_distinct("h")), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    d = d.withColumns({"order": order})
    at = F.col("order")
    same = F.filter(at, lambda s, i: (_pick(at, i + 1)["x"] == s["x"]).eqNullSafe(True) | ((i > 0) & (_pick(at, F.greatest(i - 1, F.lit(0)))["x"] == s["x"]).eqNullSafe(True)))
    d = d.withColumns({"starts": F.array_sort(F.transform(same, lambda s: s["i"]))})
    start = F.col("starts")
    gain = F.transform(start, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(_pick(start, i + 1) - p, F.lit(WINDOW))))
    d = d.withColumns({"n_repeat_words": F.coalesce(F.aggregate(gain, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")})
    return d.drop("w", "lines", "h", "order", "starts")


def measure_columns() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbol_share": F.col("n_symbols") / words,
        "capital_share": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "mean_chars": F.col("word_chars") / words,
        "distinct_share": F.when(F.col("n_words") >= 50, F.col("n_distinct") / words),
    }


def vote_of(rule: Rule) -> Column:
    x = measure_columns()[rule.of]
    bad, good = (x < rule.bad, x >= rule.good) if rule.low else (x > rule.bad, x <= rule.good)
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Model:
    """Shares of the kinds (good first, then one bad kind per rule); per kind and
    rule the chance of a bad vote, given that the rule votes."""
    share: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]


def evidence(model: Model, votes: list[Column], kind: int) -> Column:
    """ln of the kind's share times the chances of the votes."""
    out = F.lit(math.log(model.share[kind]))
    for v, p in zip(votes, model.bad[kind], strict=True):
        out = out + F.when(v == BAD, F.lit(math.log(p))).when(v == GOOD, F.lit(math.log(1 - p))).otherwise(F.lit(0.0))
    return out


def posteriors(model: Model, votes: list[Column]) -> list[Column]:
    weights = [F.exp(evidence(model, votes, k)) for k in range(len(model.share))]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return [w / total for w in weights]


def posterior(model: Model, votes: list[Column]) -> Column:
    """Probability of *good*."""
    return posteriors(model, votes)[0]


def fit(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> Model:
    """EM over all rows of ``votes``.  Start: a document that no rule objects to
    is good; any other one is probably of the kind of the first that does.
    Counts are smoothed by SMOOTH votes each way."""
    table = C.stored(votes.groupBy(*names).agg(F.count("*").cast("double").alias("n")).coalesce(1), "votes")
    v = [F.col(x) for x in names]
    first = F.coalesce(*[F.when(x == BAD, i + 1) for i, x in enumerate(v)], F.lit(0))
    kinds = [F.when(first == 0, 1.0).otherwise(0.1)] + [F.when(first == k, 0.9).otherwise(0.0) for k in range(1, len(v) + 1)]
    model = None
    for _ in range(iterations):
        q = table.select("*", *[k.alias(f"q{i}") for i, k in enumerate(kinds)])
        sums = [F.sum("n").alias("t")]
        for k in range(len(kinds)):
            w = F.col("n") * F.col(f"q{k}")
            sums.append(F.sum(w).alias(f"t{k}"))
            for i, x in enumerate(v):
                sums += [F.sum(F.when(x == BAD, w).otherwise(0.0)).alias(f"b{k}_{i}"), F.sum(F.when(x != ABSTAIN, w).otherwise(0.0)).alias(f"a{k}_{i}")]
        r = {k: float(x or 0.0) for k, x in q.agg(*sums).first().asDict().items()}
        model = Model(tuple((r[f"t{k}"] + SMOOTH) / (r["t"] + SMOOTH * len(kinds)) for k in range(len(kinds))),
                      tuple(tuple((r[f"b{k}_{i}"] + SMOOTH) / (r[f"a{k}_{i}"] + 2 * SMOOTH) for i in range(len(v))) for k in range(len(kinds))))
        kinds = posteriors(model, v)
    return model


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, keep_at: float = KEEP_AT) -> DataFrame:
    """``df`` must hold the measures; adds votes, p_good, base_failed, kept.
    The measures are stored once; EM and the verdicts read the stored table."""
    names = [f"vote_{r.name}" for r in rules]
    d = C.stored(df.withColumns(dict(zip(names, [vote_of(r) for r in rules], strict=True))), "measures")
    model = fit(d, names)
    d = d.withColumns({"p_good": posterior(model, [F.col(x) for x in names]), "base_failed": base_failed()})
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: measures, votes, posterior and verdict."""
    return judge(with_measures(docs.select("doc_id", "text")).drop("text"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is *kept*, with all their own columns."""
    d = judge(with_measures(docs.select(F.struct("*").alias("row"), F.col("text"))).drop("text"))
    return d.where("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.ensure_checkpoint_dir(spark)
    return quality(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql(rules: tuple[Rule, ...] = RULES, iterations: int = ITERATIONS) -> str:
    """The same in one statement: windows as rows, EM as a chain of tables."""
    upper = {
        "n_words": "n_words::DOUBLE", "symbol_share": "n_symbols / w", "capital_share": "n_capitals / greatest(word_chars, 1)::DOUBLE",
        "line_share": "n_dup_lines / greatest(n_lines, 1)::DOUBLE", "repeat_share": "n_repeat_words / w", "mean_chars": "word_chars / w",
        "distinct_share": "CASE WHEN n_words >= 50 THEN n_distinct / w END"}

    def vote(rule: Rule) -> str:
        x = upper[rule.of]
        bad, good = (f"{x} < {rule.bad}", f"{x} >= {rule.good}") if rule.low else (f"{x} > {rule.bad}", f"{x} <= {rule.good}")
        return f"CASE WHEN {bad} THEN 1 WHEN {good} THEN -1 ELSE 0 END AS v{rules.index(rule)}"

    r, kinds = range(len(rules)), range(len(rules) + 1)
    weight = lambda m, k: f"exp(ln({m}.t{k}) + " + " + ".join(f"CASE v{i} WHEN 1 THEN ln({m}.b{k}_{i}) WHEN -1 THEN ln(1 - {m}.b{k}_{i}) ELSE 0 END" for i in r) + ")"
    first = "CASE " + " ".join(f"WHEN v{i} = 1 THEN {i + 1}" for i in r) + " ELSE 0 END"
    steps = []
    for s in range(iterations):
        if s == 0:
            source = f"(SELECT p.*, CASE WHEN f = 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS q0, {', '.join(f'CASE WHEN f = {k} THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS q{k}' for k in kinds if k)} FROM (SELECT *, {first} AS f FROM patterns) p)"
        else:
            inner = f"(SELECT p.*, {', '.join(f'{weight(f'm{s - 1}', k)} AS w{k}' for k in kinds)} FROM patterns p, m{s - 1})"
            source = f"(SELECT *, {', '.join(f'w{k} / ({' + '.join(f'w{j}' for j in kinds)}) AS q{k}' for k in kinds)} FROM {inner})"
        cols = ", ".join([f"(sum(n * q{k}) + {SMOOTH}::DOUBLE) / (sum(n) + {SMOOTH * (len(rules) + 1)}::DOUBLE) AS t{k}" for k in kinds] + [f"(coalesce(sum(n * q{k}) FILTER (v{i} = 1), 0) + {SMOOTH}::DOUBLE) / (coalesce(sum(n * q{k}) FILTER (v{i} <> 0), 0) + {2 * SMOOTH}::DOUBLE) AS b{k}_{i}" for k in kinds for i in r])
        steps.append(f"m{s} AS MATERIALIZED (SELECT {cols} FROM {source})")
    last = f"m{iterations - 1}"
    good = f"{weight(last, 0)} / ({' + '.join(weight(last, k) for k in kinds)})"
    chain = ",\n".join(steps)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c, lead(word, 3) OVER p AS d, lead(word, 4) OVER p AS e
  FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) AS n FROM win WHERE e IS NOT NULL) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, {WINDOW}) AS r(k) GROUP BY doc_id),
measures AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    greatest(len(words), 1)::DOUBLE AS w
  FROM w LEFT JOIN cov USING (doc_id)),
votes AS (SELECT *, {', '.join(vote(x) for x in rules)} FROM measures),
patterns AS MATERIALIZED (SELECT {', '.join(f'v{i}' for i in r)}, count(*)::DOUBLE AS n FROM votes GROUP BY ALL),
{chain},
judged AS (SELECT votes.*, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, {good} AS p_good FROM votes, m{iterations - 1})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND p_good >= {KEEP_AT}) AS kept FROM judged
"""
