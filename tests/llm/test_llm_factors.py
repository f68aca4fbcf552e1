"""Factorisation machine: the identity, the inputs, training and held-out quality."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import common as C
from sheetwise.llm import factors as M


def test_linear_time_equals_all_pairs():
    r = np.random.default_rng(1)
    m = M.Machine(0.3, r.normal(size=M.SLOTS), r.normal(size=(M.SLOTS, 4)))
    rows = [(r.choice(M.SLOTS, n, replace=False), r.normal(size=n)) for n in (1, 2, 17, 40)]
    want = []
    for slot, x in rows:
        z = m.bias + sum(m.weights[i] * v for i, v in zip(slot, x, strict=True))
        z += sum(float(m.factors[slot[a]] @ m.factors[slot[b]]) * x[a] * x[b] for a in range(len(slot)) for b in range(a + 1, len(slot)))
        want.append(z)
    doc = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    begin = np.searchsorted(doc, np.arange(len(rows)))
    got = m.margins(begin, np.concatenate([s for s, _ in rows]), np.concatenate([x for _, x in rows]))[0]
    assert np.allclose(got, want)
    assert np.allclose(m.scores(doc, np.concatenate([s for s, _ in rows]), np.concatenate([x for _, x in rows])), 1 / (1 + np.exp(-np.clip(want, -30, 30))))


def bins(text, claimed=None):
    """The statistics' bins of one text, counted plainly."""
    data = text.encode()
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    low = [re.sub("[A-Z]", lambda x: x.group().lower(), w) for w in words]
    lines = [[re.sub("[A-Z]", lambda x: x.group().lower(), w) for w in re.split(r"[\x20\x09-\x0D]+", x) if w] for x in text.split("\n")]
    lines = [tuple(x) for x in lines if x]
    windows = [tuple(low[i:i + 5]) for i in range(len(low) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    share = lambda a, b: a / max(b, 1)
    of = lambda chars: share(sum(c in chars for c in data), len(data))
    letters = [c for c in text if c.isascii() and c.isalpha()]
    values = {
        "words": len(words), "lines": len(lines), "longest_word": max((len(w.encode()) for w in words), default=0),
        "word_length": share(sum(len(w.encode()) for w in words), len(words)), "line_words": share(len(words), len(lines)),
        "capitals": share(sum(c.isupper() for c in letters), len(letters)), "distinct_words": share(len(set(low)), len(low)),
        "stuttered_words": share(sum(a == b for a, b in zip(low, low[1:], strict=False)), len(low)), "repeated_windows": share(len(covered), len(low)),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)), "top_word": share(max(Counter(low).values(), default=0), len(low)),
        "claimed": 0 if claimed is None else 1 if claimed == len(text) else 2 if claimed < len(text) else 3,
        "digits": of(b"0123456789"), "stops": of(b".,;:"), "marks": of(b"!?"), "symbols": of(b"#*$%&@^~=+_\\/"), "bars": of(b"|"), "brackets": of(b"<>[]{}()"),
        "controls": of(bytes([*range(9), *range(14, 32), 127])), "beyond_ascii": of(bytes(range(128, 256))), "blank": of(b" \t\n\x0b\f\r"),
    }
    return [M._FIRST[k] + int(np.searchsorted(e, values[k], side="left")) for k, e in M.STATISTICS.items()], low


TEXTS = ["", " \n\t", "one", "The cat sat. The CAT sat!", "a b c d e x a b c d e\na b c d e\n\na b c d e", "no no no no\nno", "naïve | café | 12 <b>", "x" * 3000,
         "alpha beta gamma " * 4000, "#$% &&& ***\x00\x01", "tab\tand\x0bmore\n" * 7]


def test_inputs_match_a_plain_count():
    claimed = np.array([np.nan, 3, 1, 99, *[np.nan] * (len(TEXTS) - 4)])
    doc, slot, value = M.inputs([t.encode() for t in TEXTS], claimed)
    assert (np.diff(doc) >= 0).all()
    for i, text in enumerate(TEXTS):
        own = doc == i
        want, low = bins(text, None if np.isnan(claimed[i]) else int(claimed[i]))
        stats = slot[own] >= M.WORD_SLOTS
        assert list(slot[own][stats]) == want, text[:30]
        assert (value[own][stats] == 1).all()
        x = np.sort(value[own][~stats])
        counts = np.log1p(sorted(Counter(low).values()))
        if len(x) == len(counts):  # no two words in one slot
            assert np.allclose(x, counts / np.sqrt((counts ** 2).sum()) if len(counts) else x)
        assert not len(x) or abs((x ** 2).sum() - 1) < 1e-9


def test_grouping_of_rows_does_not_matter():
    one = [M.inputs([t.encode()], np.array([np.nan])) for t in TEXTS]
    doc, slot, value = M.inputs([t.encode() for t in TEXTS], np.full(len(TEXTS), np.nan))
    for i, (_, s, v) in enumerate(one):
        assert np.array_equal(slot[doc == i], s) and np.allclose(value[doc == i], v)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_learns_pairs_of_words(spark):
    """Good exactly when both or neither of two words occur: no linear model can."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        a, b = r.random(2) < 0.5
        rows.append((i, " ".join(f"w{k}" for k in r.integers(0, 30, 6)) + (" left" if a else " lone") + (" right" if b else " rest"), int(a == b)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    m = M.fit(docs, labels(spark, [(i, q, 0) for i, _, q in rows]))
    got = {r.doc_id: r.score for r in M.score(docs, m).collect()}
    held = [(got[i] >= 0.5) == q for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    some = labels(spark, [(4, 1, 0), (5, 0, 0), (6, 1, 0), (7, 1, 0), (7, 0, 0), (None, 0, 0), (8, 3, 0), (9, None, 0), (3, 0, 1), (404, 1, 1)])
    m = M.fit(odd_docs, some)
    rows = M.score(odd_docs, m).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    assert M.score(no_docs, m).count() == 0
    assert M.score(odd_docs.drop("n_chars"), m).count() == len(rows)
    nothing = M.fit(odd_docs, labels(spark, []))
    assert {r.score for r in M.score(odd_docs, nothing).collect()} == {0.5}
    single = M.fit(odd_docs, labels(spark, [(4, 1, 0), (6, 1, 0), (3, 1, 0), (8, 1, 0), (9, 1, 0)]))
    assert len({r.score for r in M.score(odd_docs, single).collect()}) == 1
    assert M.fit(no_docs, some).bias == 0


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    docs, marks = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    return docs, marks, {r.doc_id: r for r in M.op13_quality_classifier(spark, sf_dir).collect()}


def test_query_on_held_out_rows(scored):
    docs, marks, got = scored
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in marks.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)


def test_held_out_labels_and_forbidden_columns_do_not_count(spark, scored):
    docs, marks, got = scored
    spoilt = marks.withColumn("quality", F.when(M.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}).repartition(7)
    again = {r.doc_id: r.score for r in M.score(other, M.fit(other, spoilt)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_sample_is_bounded(spark, scored):
    docs, marks, _ = scored
    few = M.fit(docs, marks, most=20)
    assert np.isfinite(few.factors).all() and np.isfinite(few.weights).all()
