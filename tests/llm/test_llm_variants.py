"""Spelling variants against plain counting and letter-by-letter comparison."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sheetwise.llm import common as C
from sheetwise.llm import variants as V


def edits(word, letters):
    """Every string one edit away, over an alphabet."""
    for i in range(len(word)):
        yield word[:i] + word[i + 1:]
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word) and c != word[i]:
                yield word[:i] + c + word[i + 1:]


def plain(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    letters = sorted({c for w in words for c in w})
    near = {w: {x for x in edits(w, letters) if x in words and x != w} if len(w) < 200 else {x for x in words if x != w and single(w, x)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def single(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in C.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert got(V.op11_spelling_variants(spark, sf_dir)) == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    assert got(V.variants(odd_docs)) == plain([(r.doc_id, r.text) for r in odd_docs.collect()])
    df = V.variants(no_docs)
    assert df.count() == 0 and df.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", "f", 3, 9) for i, t in rows], "doc_id long, text string, word string, form string, n int, c0 int")


@pytest.mark.parametrize("tile", [1 << 15, 64])
def test_hot_word_chains_ties_and_cut_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(V, "TILE", tile)
    r = random.Random(2)
    base = "kontrolle"
    counts = {base: 4000}
    for w in sorted(set(edits(base, "abcdefgé"))):  # a hot word with hundreds of near ones
        counts[w] = r.choice([5, 6, 30, 799, 801])
    for n, w in ((5, "abcdef"), (25, "abcdeg"), (125, "abcdxg"), (625, "abydxg"), (625, "abcdxh"), (3125, "abydxgg")):  # a chain with a tie
        counts[w] = n
    for i in range(40):  # anagrams: letter counts agree, words do not
        counts["".join(r.sample("anagramme", 9))] = 5
    for w in ("ÀÉÎÕÜÿ", "÷×÷×÷×", "áéíóúý", "áéíóúx", "y" * 5000, "y" * 4999 + "x", "y" * 5001, "straße", "strase"):
        counts[w] = counts.get(w, 0) + 7
    pool = [w for w, n in counts.items() for _ in range(n)]
    r.shuffle(pool)
    rows = [(i, " ".join(pool[i::97])) for i in range(97)] + [(None, "Kontrolle, KONTROLLE"), (3, None), (3, "Strasse")]
    assert got(V.variants(docs(spark, rows))) == plain(rows)


def test_all_near_pairs_meet_once(spark):
    r = random.Random(9)
    words = sorted({"".join(r.choice("abcdefghijé") for _ in range(r.randint(6, 8))) for _ in range(4000)} | {"".join(r.choice("ab") for _ in range(r.randint(6, 9))) for _ in range(900)})
    own = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = Counter()
    for m in V.meetings(V.tiles(own)).collect():
        for i, j in zip(*V.near_words(m.words_a, m.words_b), strict=True):
            pairs[tuple(sorted((m.words_a[i], m.words_b[j])))] += 2 - m.same
    have = set(words)
    want = {tuple(sorted((w, x))) for w in words for x in edits(w, "abcdefghijé") if x in have and x != w}
    assert set(pairs) == want and set(pairs.values()) <= {2}


def test_long_texts_in_pieces(monkeypatch):
    text = "Alpha betaß " * 500
    want = Counter(dict(V.words_of(7, text)))
    monkeypatch.setattr(V, "LONG_TEXT", 10)
    assert Counter(dict(V.words_of(7, text))) == want


def test_one_edit():
    r = random.Random(3)
    for _ in range(300):
        a = "".join(r.choice("ab") for _ in range(6))
        for size in (6, 7):
            b = "".join(r.choice("ab") for _ in range(size))
            assert bool(V.one_edit(V._letters([a]), V._letters([b]))[0]) == single(a, b)
    assert np.array_equal(V.near_words(["abcdef"], ["fedcba"])[0], [])
