"""Benchmark decontamination, near duplicates and components."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from sheetwise.llm import common as C
from sheetwise.llm import decontaminate as D
from sheetwise.llm import neardup as N
from sheetwise.llm.components import components


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n)]


def shingles(w, n=5):
    w = [x.lower() for x in w]
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def plain_copies(docs, items):
    out = {}
    for d, text in docs:
        w = (text or "").split()
        for i, item in items:
            v = (item or "").split()
            if not v:
                continue
            n, k = min(len(v), len(w)), min(5, len(v))
            have, best = shingles(v, k), None
            for s in range(len(w) - n + 1):
                x = shingles(w[s:s + n], k)
                a = sum((x & have).values()) / max(1, sum((x | have).values()))
                if n and a >= 0.8 and (best is None or a > best[1]):
                    best = s, a
            if best:
                out[d, i] = best[0], n, best[1]
    return out


def test_copies_equal_brute_force(spark):
    C.prepare(spark)
    items = [(1, " ".join(words(40, 1))), (2, " ".join(words(17, 2))), (3, "tiny item"), (4, None), (5, ""), (6, " ".join(words(40, 1)).upper()), (7, " ".join(["ab cd ef gh ij"] * 6)), (None, " ".join(words(25, 9)))]
    docs = []
    for k in range(30):
        w = words(120, 100 + k)
        for i, t in items[:2] + items[6:]:
            if random.Random(k * 10 + (i or 0)).random() < 0.5:
                c = t.split()
                for e in range(random.Random(k).randint(0, 2)):
                    c[(7 * k + 11 * e) % len(c)] = "zzz"
                w[50:50] = c
        docs.append((k, " \n".join(w)))
    docs += [(100, "a tiny item here"), (101, None), (102, ""), (103, " ".join(words(40, 1)[:38])), (104, " ".join(words(17, 2)))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in D.copies(d, b).collect()}
    want = plain_copies(docs, items)
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-12 for k in want)
    dirty = {k for k, _ in want}
    assert {r.doc_id for r in D.drop_contaminated(d, b).collect()} == {i for i, _ in docs} - dirty


def test_blocks_of_items_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    C.prepare(spark)
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    prose = odd_docs.where("doc_id = 7").first().text.split()
    b = spark.createDataFrame([(i, " ".join(prose[50 * i:50 * i + 30])) for i in range(5)], "item_id long, text string")
    got = D.copies(odd_docs, b).collect()
    assert Counter(r.doc_id for r in got) == {6: 10, 7: 5, None: 5}
    left = D.drop_contaminated(odd_docs, b)
    assert left.schema.names == odd_docs.schema.names and left.count() == odd_docs.count() - 4
    assert D.copies(no_docs, b).count() == 0 and D.copies(odd_docs, b.limit(0)).count() == 0
    assert D.drop_contaminated(odd_docs, b.limit(0)).count() == odd_docs.count()


def test_index_finds_all_within_the_radius():
    r = np.random.default_rng(5)
    items = [D.Item(i, 20, r.integers(0, 1 << 63, 16).astype(np.uint64), np.ones(16, np.int64), 16) for i in range(300)]
    for x in items:
        x.shingles.sort()
    index = D.Index(items)
    prints = []
    for i in range(300):
        flips = r.choice(64, r.integers(0, D.RADIUS + 1), replace=False)
        prints.append(int(index.prints[i]) ^ sum(1 << int(f) for f in flips))
    prints = np.array(prints, dtype=np.uint64)
    w, i = index.near(prints, 16)
    brute = {(a, b) for a in range(300) for b in range(300) if int(prints[a] ^ index.prints[b]).bit_count() <= D.RADIUS}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == brute and len(brute) >= 300


def test_copies_with_a_repeated_word_run(spark):
    """A run of one word in a copy moves its fingerprint beyond the radius."""
    C.prepare(spark)
    items = [(i, " ".join(words(n, 50 + i))) for i, n in enumerate([400, 400, 200, 60])] + [(9, " ".join(["a b c d e f g"] * 12))]
    docs = []
    for i, t in items[:4]:
        for run, mark in ((len(t.split()) * 7 // 100, "[MASK]"), (len(t.split()) // 4, "---")):
            w = t.split()
            w[len(w) // 2:len(w) // 2 + run] = [mark] * run
            docs.append((len(docs), " ".join([*words(70, 900 + i), *w, *words(70, 950 + i)])))
    docs.append((len(docs), " ".join([*words(30, 70), *(["a b c d e f g"] * 11), "a b", *(["q"] * 9), *words(30, 71)])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in D.copies(d, b).collect()}
    want = plain_copies(docs, items)
    assert {(0, 0), (2, 1), (4, 2)} <= want.keys() and got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-12 for k in want)
    assert {r.doc_id for r in D.drop_contaminated(d, b).collect()} == {i for i, _ in docs} - {k for k, _ in want}


# ---- near duplicates -----------------------------------------------------------------

def plain_components(docs, n, t=0.8):
    sets = {i: set(shingles((x or "").split(), n)) for i, x in docs}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, c in Counter(j for x in s for j in by[x] if j < i).items():
            if c >= t * len(s | sets[j]) - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed=1, families=6, members=25):
    r = random.Random(seed)
    docs = []
    for f in range(families):
        base = words(r.randint(30, 160), 1000 + f)
        for m in range(members):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 8, 20])):
                w[r.randrange(len(w))] = r.choice(["x1", "y22", "z333"]) + str(r.randrange(50))
            docs.append(" ".join(w))
    docs += [" ".join(words(60, 5000 + k)) for k in range(60)] + ["one", "one", "One two", "one two", "a b c", "a b c d", None, "", " "]
    r.shuffle(docs)
    return list(enumerate(docs))


def check(spark, docs, n):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in N.near_duplicates(d, n).collect()}
    want = plain_components(docs, n)
    assert len(got) == len(docs)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_components_equal_brute_force(spark):
    C.prepare(spark)
    check(spark, near_copies(), 2)


def test_families_in_blocks(spark, monkeypatch):
    """Long lists only, in several blocks."""
    C.prepare(spark)
    monkeypatch.setattr(N, "SHORT_LIST", 2)
    monkeypatch.setattr(N, "BLOCK", 7)
    check(spark, near_copies(2, 4, 30), 2)


def test_odd_rows(spark, odd_docs, no_docs):
    C.prepare(spark)
    out = N.near_duplicates(odd_docs, 2).collect()
    assert len(out) == odd_docs.count()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[6][0][1:] == (6, True) and by[7][0][1:] == (6, False) and len(by[6]) == 2
    assert all(c is None and kept for _, c, kept in by[None])
    left = N.drop_near_duplicates(odd_docs, 5)
    assert left.schema.names == odd_docs.schema.names
    assert Counter(r.doc_id for r in left.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 2, 8: 1, 9: 1}
    assert N.near_duplicates(no_docs, 2).count() == 0 and N.drop_near_duplicates(no_docs, 5).count() == 0


def test_paths_and_stars(spark):
    C.prepare(spark)
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (500, 499), (499, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 60)} | {500: 499}
    assert got == want


def test_word_hashes_follow_words_not_places():
    a = np.frombuffer("Ab\tcd\x0b\x0cAB  é\x1cx é\x1cx".encode(), dtype=np.uint8)
    s, e = C.split_words(a)
    assert [a[x:y].tobytes().decode() for x, y in zip(s, e, strict=True)] == ["Ab", "cd", "AB", "é\x1cx", "é\x1cx"]
    h = C.word_hashes(a, s, e)
    assert h[0] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 3
    assert [len(g) for _, g in C.text_groups(pa.array(["a" * 10, None, "b" * 30, "c"]), 20)] == [2, 1, 1]
