"""Packing, WARC archives and the pipeline."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sheetwise.llm import common as C
from sheetwise.llm import neardup, packing, warc

TRICKY = ["It's you'd l'été İstanbul ΑΣ. ΑΣ, don't, x'd' ''s a's. 'tis été.  x y <|endoftext|> a<|endoftext|>. 12,5 a1. ...", "\x1cab\x85c. ﬁn, Ⅳ. ²x.", "", " \n", "THE The the, THE.!! naïve. ñ é. é, 漢字です。"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def plain_pieces(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    return [(doc_id, k, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], dtype="<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]


def check_packing(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_pieces_equal_the_tokenizer(spark, sf_dir, odd_docs, tokenizer):
    C.prepare(spark)
    docs = C.table(spark, sf_dir, "documents").selectExpr("doc_id + 100 AS doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(
        spark.createDataFrame(list(enumerate(TRICKY, 50)), "doc_id long, text string"))
    out = packing.pack_documents(docs).collect()
    want = Counter(p for r in docs.collect() for p in plain_pieces(tokenizer, r.doc_id, r.text))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = check_packing(out)
    assert bins <= -(-sum(r.length for r in out) // 2048) * 1.01 + 1


def test_empty_table(spark, no_docs):
    C.prepare(spark)
    assert packing.pack_documents(no_docs).count() == 0


def plain_best_two_fit(lengths, capacity):
    """Bin after bin over a sorted list."""
    left, bins = sorted(lengths), []
    while left:
        bin_, gap = [], capacity
        while (fit := [x for x in left if x <= gap]):
            bin_.append(fit[-1])
            left.remove(fit[-1])
            gap -= fit[-1]
        if gap and len(bin_) > 1:
            room, small = gap + bin_[-1], bin_[-1]
            pairs = [(left[i] + left[j], left[i], left[j]) for i in range(len(left)) for j in range(i) if small < left[i] + left[j] <= room]
            if pairs:
                _, a, b = max(pairs)
                left.remove(a)
                left.remove(b)
                left = sorted([*left, small])
                bin_ = [*bin_[:-1], a, b]
        bins.append(sorted(bin_))
    return bins


def test_plan_equals_bin_by_bin_packing():
    r = random.Random(8)
    for _ in range(60):
        capacity = r.choice([10, 37, 100])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        slots, times, n = packing.plan(Counter(lengths), capacity)
        bins = defaultdict(list)
        ranks = defaultdict(list)
        for (length, rank, sequence, _), k in zip(slots.tolist(), times.tolist(), strict=True):
            for j in range(k):
                bins[sequence + j].append(length)
                ranks[length].append(rank + j)
        assert n == len(bins) and all(sorted(v) == list(range(Counter(lengths)[x])) for x, v in ranks.items())
        assert Counter(x for b in bins.values() for x in b) == Counter(lengths) and all(sum(b) <= capacity for b in bins.values())
        assert len(bins) == len(plain_best_two_fit(lengths, capacity))


def test_word_coder_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    coder = packing.WordCoder(packing.tokenizer_path())
    texts = [" ".join(f"word{i} Thing{i * j}." for i in range(20)) for j in range(6)]
    for t in texts * 2:
        assert coder.encode([t.encode()])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# ---- warc -------------------------------------------------------------------------------

def odd_pages(spark):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "http://a/\r\nX: y", big, 1), (2, None, big, 1), (3, "u", big, 1), (4, "u", other, 1), (4, "u", other, 1), (5, "u", "y" * 999, 1), (6, "u", "y" * 999, 1), (7, "u", None, 1), (8, "u", "", 1), (None, "u", big, 1), (None, "u", None, 1),
            (9, "u", "head\r\n\r\nWARC/1.1\r\n\r\n" + "z" * 300_000, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_pages_survive_the_round_trip(spark):
    C.prepare(spark)
    pages = odd_pages(spark)
    path = C.scratch_path(spark, "warc")
    warc.write_archive(pages, path)
    got = Counter(tuple(r) for r in warc.read_pages(spark, path).collect())
    want = Counter()
    best = {}
    for r in pages.collect():
        data = (r.html or "").encode()
        if len(data) >= 1000 and r.page_id is not None:
            best[data] = max(best.get(data, -1), r.page_id)
    for r in pages.collect():
        data = (r.html or "").encode()
        to = best.get(data) if best.get(data) != r.page_id else None
        want[r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to] += 1
    assert got == want
    full = spark.read.format("warc").load(path)
    assert sorted(bytes(r.payload) for r in full.where("record_type = 'response'").collect()) == sorted((r.html or "").encode() for r in pages.collect() if not (best.get((r.html or "").encode(), r.page_id) != r.page_id))
    empty = C.scratch_path(spark, "none")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_pages(spark, empty).count() == 0


class Counting:
    """A file that knows how much was read."""

    def __init__(self, data):
        self.f, self.n = pa.BufferReader(data), 0

    def read(self, n):
        out = self.f.read(n)
        self.n += len(out)
        return out

    def __getattr__(self, name):
        return getattr(self.f, name)


def test_unwanted_payloads_are_stepped_over():
    r = random.Random(1)
    data = b"".join(warc.gzip_member(warc.record(f"urn:{i}", "response", "http://x/", "00" * 20, r.randbytes(200_000), None)) for i in range(20))
    f = Counting(data)
    assert [h["warc-record-id"] for h, _ in warc.records(f, lambda h: h["warc-record-id"] == "<urn:7>")] == ["<urn:7>"]
    assert f.n < len(data) / 10
    # members of other writers, and no compression at all
    plain = [warc.record(f"urn:{i}", "response", None, "00" * 20, bytes([i]) * 5000, None) for i in range(4)]
    for packed in (b"".join(map(gzip.compress, plain)), b"".join(plain)):
        got = list(warc.records(pa.BufferReader(packed), lambda h: "3" not in h["warc-record-id"]))
        assert [b[-5000:] for _, b in got] == [bytes([i]) * 5000 for i in range(3)]
    assert gzip.decompress(data).count(b"WARC/1.1") == 20


def test_predicates_are_pushed(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    reader = warc.WarcReader(None, {"path": "/x"})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), GreaterThan(("content_length",), 5)]))
    assert [type(x) for x in rest] == [GreaterThan] and len(reader.tests) == 2
    digest = base64.b32encode(bytes(20)).decode()
    head = {"warc-type": "response", "warc-target-uri": "a", "warc-payload-digest": f"sha1:{digest}"}
    assert reader.wanted(head) and not reader.wanted(head | {"warc-target-uri": "c"})


# ---- the pipeline ----------------------------------------------------------------------------

def test_pipeline_stages(spark, sf_dir, tokenizer):
    C.prepare(spark)
    docs = C.table(spark, sf_dir, "documents")
    seen = {}
    d = docs
    for name, stage in corpus_pipeline.STAGES:
        d = C.stored(stage(spark, d, sf_dir), name)
        seen[name] = d
        if name != "packing":
            assert d.schema.names == docs.schema.names
    rows = lambda n: {r.doc_id: r for r in (seen[n] if n else docs).collect()}
    first, near, clean, safe = (rows(n) for n in ("quality_rules", "near_duplicates", "decontamination", "secrets"))
    assert 0 < len(safe) == len(clean) < len(near) <= len(first) < docs.count()
    # near duplicates: five-word shingles, the smallest id of each component
    words = {i: [w.lower() for w in re.split(r"[\x20\x09-\x0D]+", r.text) if w] for i, r in first.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    for i in near:
        assert not any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in near)
    for i in first.keys() - near.keys():
        assert any(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in first)
    # decontamination: a benchmark passage's middle never stays
    items = [r.text.split() for r in C.table(spark, sf_dir, "benchmark").collect()]
    assert not any(" ".join(w) in " ".join(r.text.split()) for w in items for r in clean.values())
    # secrets: nothing that the patterns know stays, and all else is untouched
    for i, r in safe.items():
        parts = r.text.split("[SECRET]")
        assert (len(parts) > 1 or r == clean[i]) and r.n_chars == len(r.text)
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text)
    want = Counter(p for r in safe.values() for p in plain_pieces(tokenizer, r.doc_id, r.text))
    out = seen["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    check_packing(out)


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    C.prepare(spark)
    for docs in (odd_docs, no_docs):
        d = docs
        for name, stage in corpus_pipeline.STAGES:
            d = C.stored(stage(spark, d, sf_dir), name)
        assert d.count() == (0 if docs is no_docs else d.count())
        if docs is odd_docs:
            assert Counter(r.doc_id for r in d.where("piece = 0").collect()) == {6: 1, None: 1}


def test_lists_of_a_sketch_are_few():
    assert neardup.K - neardup.MIN_OVERLAP + 1 == 31
