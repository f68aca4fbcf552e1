"""Secret scans: fixed patterns plus character Markov models.

Three patterns give the base spans.  Two first-order Markov models over
characters then judge what these spans leave of every run of token characters,
each stretch of ``MIN_RUN`` or more: one model is
trained on random strings, one on ordinary identifiers, and a run whose
log-likelihood ratio favours *random* clearly is added as a ``markov`` span.

Training: labelled samples.  Random: the values of base spans in a bounded
sample of documents (``SAMPLE_DOCS`` documents with the smallest hash of their
id) and generated strings over the usual key alphabets (fixed seed).  Ordinary:
the other runs of at least four token characters in the same sample, and names
made of them (snake case, camel case, constants, paths).  The model is a 67 x 66
table whatever the input.

Positions are code points, end exclusive.  A span covers the whole match.
Defined results: a null or empty text has no spans (digest of the empty
string); each row is scanned by itself, so repeated rows give repeated results;
an empty table gives an empty result and a model from generated strings only.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN = 20
MIN_DISTINCT = 8
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
SHORT_RUN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
#: natural logarithms: evidence needed in all and per character
MIN_RATIO, MIN_RATIO_PER_CHAR = 9.0, 0.3
SAMPLE_DOCS = 2000
GENERATED = {"0123456789abcdef": 300, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567": 200, ALPHABET[:62]: 300, ALPHABET[:64]: 200}

_TOKEN_BYTE = np.zeros(256, dtype=bool)
_TOKEN_BYTE[[ord(c) for c in ALPHABET]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, ordered by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        # an assignment whose value is too short still uses up its characters
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _clear_of(run: tuple[int, int], spans: list[tuple[int, int, str]]) -> bool:
    return all(run[1] <= s or e <= run[0] for s, e, _ in spans)


def _outside(run: tuple[int, int], spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Stretches of the run that no span covers; ``spans`` come by start."""
    start, end = run
    for s, e, _ in spans:
        if e > start and s < end:
            if s > start:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


# ---- the models ---------------------------------------------------------------

def _transitions(strings: Iterator[str], smooth: float) -> list[list[float]]:
    """log P(next | previous); row 66 is the start."""
    at = {c: i for i, c in enumerate(ALPHABET)}
    n = np.full((len(ALPHABET) + 1, len(ALPHABET)), smooth)
    for s in strings:
        codes = [len(ALPHABET), *(at[c] for c in s)]
        np.add.at(n, (codes[:-1], codes[1:]), 1)
    # each row leans on the character frequencies, so a rare start is not uniform
    overall = n.sum(axis=0) / n.sum()
    n += 2.0 * overall
    return np.log(n / n.sum(axis=1, keepdims=True)).tolist()


NAMES = 4000


def _names(words: list[str], rng: random.Random) -> list[str]:
    """Identifiers as programmers join words."""
    styles = ("_".join, "-".join, "/".join, lambda w: "".join(x.capitalize() for x in w), lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "_".join(w).upper(),
              lambda w: "-".join(w) + f"-{rng.randint(1, 2030)}", lambda w: f"{rng.randint(2000, 2030)}-{rng.randint(10, 12)}/" + "_".join(w), lambda w: f"/{'/'.join(w)}")
    return [rng.choice(styles)(rng.choices(words, k=rng.randint(2, 5))) for _ in range(NAMES)] if words else []


def train(texts: list[str]) -> dict:
    """Log-likelihood ratio of random over ordinary for every transition."""
    rng = random.Random(20)
    randoms = ["".join(rng.choices(chars, k=rng.randint(20, 44))) for chars, n in GENERATED.items() for _ in range(n)]
    ordinary = []
    for text in texts:
        spans = base_spans(text)
        for s, e, kind in spans:
            value = text[s:e] if kind != "assign" else ASSIGN.match(text, s)[2]
            randoms += [x for x in SHORT_RUN.findall(value) if len(x) >= MIN_VALUE]
        ordinary += [m[0] for m in SHORT_RUN.finditer(text) if _clear_of(m.span(), spans)]
    ordinary += _names(sorted({w.lower() for w in ordinary if w.isalpha()}), rng)
    # 3.0: a transition that words never show costs about as much as a guess
    a, b = _transitions(randoms, 1.0), _transitions(ordinary, 3.0 if ordinary else 1.0)
    ratio = [[x - y for x, y in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]
    return {(p, c): ratio[i][j] for i, p in enumerate([*ALPHABET, ""]) for j, c in enumerate(ALPHABET)}


def log_ratio(model: dict, run: str) -> float:
    return sum(map(model.__getitem__, zip(["", *run[:-1]], run, strict=True)))


def spans_of(text: str, model: dict) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    added = []
    for m in RUN.finditer(text):
        for start, end in _outside(m.span(), base):
            run = text[start:end]
            if end - start >= MIN_RUN and len(set(run)) >= MIN_DISTINCT:
                r = log_ratio(model, run)
                if r >= MIN_RATIO and r >= MIN_RATIO_PER_CHAR * len(run):
                    added.append((start, end, "markov"))
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def fit(docs: DataFrame) -> dict:
    return train(C.sample(docs, "doc_id", "text", SAMPLE_DOCS))


# ---- on Spark -----------------------------------------------------------------

def _suspects(column: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, text) of the rows that can hold a span: a run of MIN_RUN token
    bytes, or a sign of assignment.  Every whole text is looked at."""
    for first, texts in C.text_groups(column):
        data, offsets = C.joined(texts)
        token = np.zeros(len(data) + 2, dtype=bool)
        token[1:-1] = _TOKEN_BYTE[data]
        edge = np.flatnonzero(token[1:] != token[:-1])
        runs = edge[0::2][edge[1::2] - edge[0::2] >= MIN_RUN]
        signs = np.flatnonzero((data == 0x3A) | (data == 0x3D))
        for i in np.unique(np.searchsorted(offsets, np.concatenate([runs, signs]), side="right") - 1).tolist():
            yield first + i, texts[i].decode("utf-8", "replace")


RESULT = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_markov", pa.int64())])


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and the digest of its spans."""
    def task(batches):
        none = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
        for batch in batches:
            rows = [none] * batch.num_rows
            for i, text in _suspects(batch.column("text")):
                spans = spans_of(text, model)
                base = [s for s in spans if s[2] != "markov"]
                n = [sum(s[2] == k for s in spans) for k in KINDS]
                rows[i] = (*n[:3], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), n[3])
            cols = list(zip(*rows, strict=True)) or [()] * len(RESULT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, RESULT, strict=True))], names=["doc_id", *(f.name for f in RESULT)])

    d = docs.select(F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redact(docs: DataFrame, model: dict, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark`` and ``n_chars`` set
    anew where the text changed; all other columns and rows stay."""
    def clean(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        for i, text in _suspects(column):
            out, done = [], 0
            for s, e, _ in spans_of(text, model):
                if s >= done:
                    out += [text[done:s], mark]
                done = max(done, e)
            texts[i] = "".join([*out, text[done:]]) if done else texts[i]
        return pa.array(texts, pa.string())

    udf = F.arrow_udf(clean, "string")
    d = docs.select(F.struct("*").alias("row"), udf("text").alias("clean"))
    changed = ~F.col("clean").eqNullSafe(F.col("row.text"))
    new = {"text": F.col("clean")} | ({"n_chars": F.when(changed, F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return d.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
