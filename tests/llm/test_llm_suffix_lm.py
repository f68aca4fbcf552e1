"""Suffix-array removal of repeats and the language model."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sheetwise.llm import common as C
from sheetwise.llm import lm as L
from sheetwise.llm import suffixdedup as S
from sheetwise.llm import suffixes


def test_suffix_array_and_prefixes():
    r = random.Random(1)
    for t in range(150):
        strings = [bytes(r.choices(b"ab\0\xff" if t % 2 else b"a", k=r.randint(1, 30))) for _ in range(r.randint(1, 10))]
        data, ends = np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum([len(s) for s in strings])
        suffix, at = {}, 0
        for s in strings:
            suffix |= {at + i: s[i:] for i in range(len(s))}
            at += len(s)
        last = {i: int(ends[np.searchsorted(ends, i, side="right")]) for i in suffix}
        want = sorted(suffix, key=lambda i: ([x + 1 for x in suffix[i]] + [0], last[i]))
        order = suffixes.suffix_array(data, ends)
        assert order.tolist() == want
        prefix = suffixes.common_prefixes(data, ends, order)
        for a, b in zip(want, want[1:], strict=False):
            x, y = suffix[a], suffix[b]
            assert prefix[b] == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def brute_removal(texts, width):
    n = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if n[t[i:i + width]] > 1:
                m[i:i + width] = b"\1" * width
        kept = bytes(b for b, x in zip(t, m, strict=True) if not x)
        out.append((len(t), sum(m), sum(bool(m[i]) and (i == 0 or not m[i - 1]) for i in range(len(m))), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(4)
    prose = lambda n: "".join(r.choices("abcdé \n", k=n))
    shared = [prose(k) for k in (399, 400, 401, 450, 900)]
    texts = [prose(r.randint(0, 1500)) for _ in range(25)]
    texts += [prose(r.randint(0, 300)) + r.choice(shared) + prose(r.randint(0, 300)) for _ in range(40)]
    texts += ["x" * 399, "x" * 400, "x" * 401, "ab" * 900, "", prose(50) + shared[4][100:700] + prose(9) + shared[4][300:], texts[30], texts[30], texts[30][:-1]]
    return texts + [t[:200] + "#" + t[201:] for t in texts[25:40]]


@pytest.mark.parametrize("split", [8192, 3])
def test_removal_equals_brute_force(spark, monkeypatch, split):
    """Also with anchors split over shards and small shards."""
    C.prepare(spark)
    monkeypatch.setattr(S, "SPLIT", split)
    monkeypatch.setattr(S, "SHARD_BYTES", 30_000)
    texts = corpus()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in S.remove_repeats(d).orderBy("doc_id").collect()]
    assert got == brute_removal([t.encode() for t in texts], S.WIDTH)


def test_removal_of_odd_rows(spark, odd_docs, no_docs):
    C.prepare(spark)
    rows = odd_docs.collect()
    got = Counter((r.doc_id, *tuple(r)[1:]) for r in S.remove_repeats(odd_docs).collect())
    want = brute_removal([(r.text or "").encode() for r in rows if r.doc_id != 5], S.WIDTH)
    want = Counter((r.doc_id, *w) for r, w in zip([r for r in rows if r.doc_id != 5], want, strict=True))
    assert {k: n for k, n in got.items() if k[0] != 5} == want
    # the long text repeats itself everywhere
    long_ = next(k for k in got if k[0] == 5)
    assert long_[1] == long_[2] and long_[3] == 1 and long_[4] == hashlib.sha256(b"").hexdigest()
    assert S.remove_repeats(no_docs).count() == 0


# ---- language model --------------------------------------------------------------------

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_unigrams(docs):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter()
    for i, t in docs:
        if not held[i]:
            c.update(("w", w) for w in (t or "").encode().translate(FOLD).split())
            c["end"] += 1
    n, v, out = sum(c.values()), len(c), Counter()
    for i, t in docs:
        tokens = [("w", w) for w in (t or "").encode().translate(FOLD).split()] + ["end"]
        out[i, held[i], len(tokens), sum(c[x] > 0 for x in tokens), n, round(sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in tokens), 4)] += 1
    return out


@pytest.mark.parametrize("frequent", [L.FREQUENT_TOKEN, 0.01])
def test_unigram_base(spark, sf_dir, odd_docs, monkeypatch, frequent):
    """Also with nearly all tokens scored by the join."""
    C.prepare(spark)
    monkeypatch.setattr(L, "FREQUENT_TOKEN", frequent)
    docs = C.table(spark, sf_dir, "documents").selectExpr("doc_id + 20 AS doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in L.score(docs).collect())
    want = plain_unigrams([(r.doc_id, r.text) for r in docs.collect()])
    close = lambda c: sorted((str(k[:5]), k[5], n) for k, n in c.items())
    assert [x[0] for x in close(got)] == [x[0] for x in close(want)]
    assert all(abs(a[1] - b[1]) < 2e-3 and a[2] == b[2] for a, b in zip(close(got), close(want), strict=True))


def test_empty_table_is_scored_by_nothing(spark, no_docs):
    C.prepare(spark)
    assert L.score(no_docs).count() == 0


def tree(texts):
    keys, n = L._counted(L.keys_of(texts))
    total = int(n.sum())
    return L.Model([(g, m) for _, g, m in L.next_bytes(keys, n, L.frequent_contexts(keys, n, total))], total)


def plain_tree_score(texts, text, depth=L.DEPTH, rare=L.RARE):
    """Context-tree weighting bit by bit, from counts in dictionaries."""
    bits = lambda b: [((1 << k) | (b >> (8 - k)), (b >> (7 - k)) & 1) for k in range(8)]
    count, size, total = Counter(), Counter(), 0
    for t in texts:
        s = L.PAD + t + b"\0"
        for i in range(depth, len(s)):
            total += 1
            for d in range(depth + 1):
                c = s[i - d:i]
                size[c] += 1
                for k, bit in bits(s[i]):
                    count[c, k, bit] += 1
    inside = {c for c, n in size.items() if n >= max(1.0, rare * total)} | {b""}
    children = {}
    for c in inside:
        if c:
            children.setdefault(c[1:], []).append(c)
    kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def below(c, k):
        if (c, k) not in memo:
            a, b = count[c, k, 0], count[c, k, 1]
            if len(c) == depth:
                memo[c, k] = kt(a, b)
            else:
                x, (ra, rb) = kt(a, b), rest(c, k)
                y = kt(ra, rb) + sum(below(z, k) for z in children.get(c, ()))
                memo[c, k] = math.log(.5) + max(x, y) + math.log1p(math.exp(-abs(x - y)))
        return memo[c, k]

    def rest(c, k):
        return tuple(count[c, k, bit] - sum(count[z, k, bit] for z in children.get(c, ())) for bit in (0, 1))

    def one(c, k, before):
        a, b = count[c, k, 0], count[c, k, 1]
        p = (b + .5) / (a + b + 1)
        if len(c) == depth:
            return p
        w = math.exp(math.log(.5) + kt(a, b) - below(c, k))
        longer = before[len(before) - len(c) - 1:]
        ra, rb = rest(c, k)
        return w * p + (1 - w) * (one(longer, k, before) if longer in inside else (rb + .5) / (ra + rb + 1))

    out, s = 0.0, L.PAD + text + b"\0"
    for i in range(depth, len(s)):
        for k, bit in bits(s[i]):
            p = one(b"", k, s[i - depth:i])
            out += math.log10(p if bit else 1 - p)
    return out


def test_tree_equals_plain_context_tree_weighting(monkeypatch):
    r = random.Random(2)
    texts = [("".join(r.choice(["the ", "then ", "cat ", "catch ", "é "]) for _ in range(60))).encode() for _ in range(8)]
    for rare in (L.RARE, 0.02):
        monkeypatch.setattr(L, "RARE", rare)
        model = tree(texts)
        assert np.allclose((10.0 ** model.log10.astype(float)).sum(axis=1), 1, atol=1e-5)
        probe = [b"", b"the cat", b"zz\xff\0 the thence", texts[0]]
        assert model.score(probe) == pytest.approx([plain_tree_score(texts, t, rare=rare) for t in probe], rel=1e-4)
        assert model.score(probe, lanes=3) == pytest.approx(model.score(probe))


def test_model_learns(spark, sf_dir):
    texts = [r.text.encode() for r in C.table(spark, sf_dir, "documents").collect()]
    model, bytes_ = tree(texts[::2]), sum(map(len, texts[1::2]))
    assert -model.score(texts[1::2]).sum() / math.log10(2) / bytes_ < 3.5


def test_rare_contexts_count(spark, monkeypatch):
    """Contexts under a share of 2^-15 keep their counts, also over several
    chunks and buckets, and for a context never seen."""
    C.prepare(spark)
    monkeypatch.setattr(L, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(L, "BUCKET_BYTES", 3000)
    r = random.Random(7)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    docs = [(i, " ".join(r.choices(words, k=180))) for i in range(70)] + [(70, "Zebra é" * 3), (71, None), (72, "")]
    train = [(t or "").encode() for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(len(t) + 1 for t in train) > 1 / L.RARE
    got = {x.doc_id: x.score for x in L.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    probe = [0, 1, 70, 71]
    assert sorted(got) == sorted(i for i, _ in docs)
    plain = plain_tree_scores(train, [(docs[i][1] or "").encode() for i in probe])
    assert [got[i] for i in probe] == pytest.approx(plain, rel=1e-6, abs=1e-6)


def plain_tree_scores(texts, probes):
    """All contexts, none merged."""
    return [plain_tree_score(texts, t, rare=0.0) for t in probes]
