"""Benchmark decontamination: SimHash windows, a multi-index, exact checks.

A benchmark item of n words is looked for in every window of n words of every
document.  Shingles are runs of five lower-cased words; window and item are
weighted sets of shingles (weight: how often one occurs), and a window counts as
a copy when the weighted Jaccard similarity, sum of minima over sum of maxima, is
0.8 or more.

* Windows that hold no shingle of any item have similarity 0 and are passed over.
* Every other window gets a 64-bit SimHash from running sums over its shingles.
* Multi-index: five blocks of 13, 13, 13, 13 and 12 bits.  Two fingerprints
  within ``RADIUS`` = 19 bits differ by at most 3 bits in one of the blocks, and
  the index holds each item under every block value within 3 bits, so it finds
  all items within the radius.  One shingle that is repeated often moves a
  fingerprint far, so the index alone would lose some copies.
* Exact route beside the index: a copy shares a weight of at least 0.8 / 1.8 of
  both sizes.  Where a window holds as many shingles of any items, the items that
  own them are found by the shingles, and an item that can reach the weight is
  compared with all windows by running sums, whatever the fingerprints say.
* Candidates are verified exactly on the shingles.

Work is one map over the documents, without a shuffle.  The index is bounded:
items come in blocks of ``BLOCK_ITEMS`` / ``BLOCK_BYTES``, and every block is
held against all documents.

Defined results: an item of fewer than five words has its whole sequence as its
only shingle; items without words match nothing; a document shorter than the
item is one window; null texts are empty; repeated rows give repeated results;
several items or copies of an item each give their own row; of equal windows the
first counts; empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCK_BITS = (13, 13, 13, 13, 12)
FLIPS = 3  # RADIUS // len(BLOCK_BITS)
BLOCK_ITEMS, BLOCK_BYTES = 2000, 8 << 20


@dataclass
class Item:
    item_id: int | None
    n_words: int
    shingles: np.ndarray  # distinct hashes, sorted
    counts: np.ndarray
    total: int


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 / -1 per bit of each hash."""
    raw = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), 8), axis=1)
    return raw.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def simhash(hashes: np.ndarray) -> int:
    return int(_pack(_bits(hashes).sum(axis=0, keepdims=True))[0])


def masks(bits: int, flips: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``flips`` ones."""
    v = np.arange(1 << bits, dtype=np.uint64)
    return v[np.bitwise_count(v) <= flips]


class Index:
    """Items by (size in shingles, block value), for each of the blocks."""

    def __init__(self, items: list[Item], shingle: int = SHINGLE):
        self.items = items
        #: short items: hash of the whole sequence -> items, per number of words
        self.short: dict[int, dict[int, list[int]]] = {}
        long_ = []
        for i, x in enumerate(items):
            if x.n_words < shingle:
                self.short.setdefault(x.n_words, {}).setdefault(int(x.shingles[0]), []).append(i)
            else:
                long_.append(i)
        self.shingles = np.unique(np.concatenate([items[i].shingles for i in long_] or [np.zeros(0, np.uint64)]))
        of = np.repeat(np.array(long_, dtype=np.int64), [len(items[i].shingles) for i in long_])
        at = np.searchsorted(self.shingles, np.concatenate([items[i].shingles for i in long_] or [self.shingles]))
        order = np.argsort(at, kind="stable")
        #: items that own a shingle: owners[owned[k]:owned[k + 1]], and how often
        self.owners, self.times = of[order], np.concatenate([items[i].counts for i in long_] or [of])[order]
        self.owned = np.searchsorted(at[order], np.arange(len(self.shingles) + 1))
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        self.sizes = sorted({items[i].total for i in long_})
        self.prints = np.zeros(len(items), dtype=np.uint64)
        for i in long_:
            self.prints[i] = simhash(np.repeat(items[i].shingles, items[i].counts))
        of, size = np.array(long_, dtype=np.int64), np.array([items[i].total for i in long_], dtype=np.int64)
        self.blocks, shift = [], 0
        for bits in BLOCK_BITS:
            near = masks(bits, FLIPS)
            value = (self.prints[of] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            keys = ((size[:, None] << 16) | (value[:, None] ^ near[None, :]).astype(np.int64)).ravel()
            order = np.argsort(keys, kind="stable")
            self.blocks.append((shift, bits, keys[order], np.repeat(of, len(near))[order]))
            shift += bits

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item holds."""
        at = np.flatnonzero(self.known[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.shingles):
            return at[:0]
        k = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
        return at[self.shingles[k] == hashes[at]]

    def reached(self, hashes: np.ndarray, least: int) -> list[int]:
        """Items that share a weight of ``least`` or more with these shingles."""
        own, n = np.unique(np.searchsorted(self.shingles, hashes), return_counts=True)
        a, many = self.owned[own], self.owned[own + 1] - self.owned[own]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
        weight = np.bincount(self.owners[at], np.minimum(np.repeat(n, many), self.times[at]), len(self.items))
        return np.flatnonzero(weight >= least).tolist()

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of this size within the radius."""
        windows, found = [], []
        for shift, bits, keys, items in self.blocks:
            k = (size << 16) | ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            a, b = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            n = b - a
            w = np.repeat(np.arange(len(prints)), n)
            i = items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)] if n.sum() else items[:0]
            ok = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
            windows.append(w[ok])
            found.append(i[ok])
        pairs = np.unique(np.concatenate(windows) * len(self.items) + np.concatenate(found))
        return np.divmod(pairs, max(1, len(self.items)))


def similarity(window: np.ndarray, item: Item) -> float:
    """Weighted Jaccard of the window's shingles and the item's."""
    k = np.minimum(np.searchsorted(item.shingles, window), len(item.shingles) - 1)
    n = np.bincount(k[item.shingles[k] == window], minlength=len(item.shingles))
    shared = int(np.minimum(n, item.counts).sum())
    return shared / (len(window) + item.total - shared)


def needed(size: int, total: int) -> int:
    """Weight that a window of ``size`` shingles shares with its item, at least."""
    return math.ceil(SIMILARITY / (1 + SIMILARITY) * (size + total) - 1e-9)


def shared_weights(hashes: np.ndarray, n: int, item: Item) -> np.ndarray:
    """Weight that each window of n shingles shares with the item.  A shingle
    counts in a window unless as many of its kind as the item has come before it
    there."""
    k = np.minimum(np.searchsorted(item.shingles, hashes), len(item.shingles) - 1)
    at = np.flatnonzero(item.shingles[k] == hashes)
    at = at[np.argsort(k[at], kind="stable")]
    kind = k[at]
    rank = np.arange(len(at)) - np.searchsorted(kind, kind)
    most = item.counts[kind]
    full = np.where(rank >= most, at[np.maximum(np.arange(len(at)) - most, 0)], -1)
    first = np.maximum(np.maximum(full, at - n) + 1, 0)
    change = np.bincount(first, minlength=len(hashes) + 1) - np.bincount(at + 1, minlength=len(hashes) + 1)
    return np.cumsum(change)[:len(hashes) - n + 1]


def make_item(item_id, text: bytes, shingle: int = SHINGLE) -> Item | None:
    data = np.frombuffer(text, dtype=np.uint8)
    words = C.word_hashes(data, *C.split_words(data))
    if not len(words):
        return None
    values, counts = np.unique(C.chain(words, min(shingle, len(words))), return_counts=True)
    return Item(item_id, len(words), values, counts, int(counts.sum()))


def search(words: np.ndarray, hashes: np.ndarray, hits: np.ndarray, index: Index) -> list[tuple[int, int, float]]:
    """(item number, first word, similarity) of the best window per item.
    ``hashes`` are the document's shingles, ``hits`` the positions of those
    that items hold."""
    best: dict[int, tuple[float, int]] = {}

    def offer(i: int, start: int, value: float) -> None:
        if value >= SIMILARITY and (i not in best or (value, -start) > (best[i][0], -best[i][1])):
            best[i] = value, start

    for n, of in index.short.items():
        runs = C.chain(words, n)
        for start in np.flatnonzero(np.isin(runs, np.array(list(of), dtype=np.uint64))).tolist():
            for i in of[int(runs[start])]:
                offer(i, start, 1.0)
    if len(hits):
        reach = min(index.sizes[-1], len(hashes))
        # stretches of the document that windows with a hit can cover
        cut = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
        for part in np.split(hits, cut):
            first, last = max(0, int(part[0]) - reach), min(len(hashes), int(part[-1]) + reach + 1)
            here = hashes[first:last]
            sums = np.zeros((len(here) + 1, 64), dtype=np.int32)
            np.cumsum(_bits(here), axis=0, out=sums[1:])
            held = np.zeros(len(here) + 1, dtype=np.int32)
            held[1:][part - first] = 1
            held = np.cumsum(held)
            reached: dict[int, list[int]] = {}
            for size in index.sizes:
                n = min(size, len(hashes))  # a short document is one window
                if n < SIMILARITY * size or n > len(here):
                    continue
                starts = np.flatnonzero(held[n:] > held[:len(held) - n])
                if not len(starts):
                    continue
                for w, i in zip(*index.near(_pack(sums[starts + n] - sums[starts]), size), strict=True):
                    s = int(starts[w])
                    offer(int(i), first + s, similarity(here[s:s + n], index.items[int(i)]))
                least = needed(n, size)
                if int((held[n:] - held[:len(held) - n]).max()) >= least:
                    if least not in reached:
                        reached[least] = index.reached(hashes[part], least)
                    for i in reached[least]:
                        if index.items[i].total == size:
                            shared = shared_weights(here, n, index.items[i])
                            s = int(shared.argmax())
                            offer(i, first + s, int(shared[s]) / (n + size - int(shared[s])))
    return [(i, start, value) for i, (value, start) in sorted(best.items())]


def search_column(column: pa.Array, index: Index):
    """(row, item, first word, words in the window, similarity) of every copy."""
    for first, texts in C.text_groups(column):
        data, offsets = C.joined(texts)
        starts, ends = C.split_words(data)
        words = C.word_hashes(data, starts, ends)
        edge = np.searchsorted(starts, offsets)  # first word of each text
        hashes = C.chain(words, SHINGLE)
        hits = index.hits(hashes)
        docs = np.searchsorted(edge, hits, side="right") - 1
        # a shingle that starts in a document must end in it
        inside = hits + SHINGLE <= edge[docs + 1]
        hits, docs = hits[inside], docs[inside]
        todo = range(len(texts)) if index.short else np.unique(docs).tolist()
        for d in todo:
            a, b = int(edge[d]), int(edge[d + 1])
            own = hits[np.searchsorted(docs, d):np.searchsorted(docs, d, side="right")] - a
            for i, start, value in search(words[a:b], hashes[a:max(a, b - SHINGLE + 1)], own, index):
                item = index.items[i]
                yield first + d, item, start, min(item.n_words, b - a), value


def indexes(benchmark: DataFrame):
    """One index per block of items."""
    b = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = b.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    b = b.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        rows = b.where(F.col("block") == k).collect()
        items = [make_item(r.item_id, r.text.encode()) for r in rows]
        if any(items):
            yield Index([x for x in items if x])


FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds a copy of: the best window."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], FOUND)
    d = docs.select(F.col("doc_id").cast("long"), "text")
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def task(batches, shared=shared):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[r], item.item_id, start, n, value) for r, item, start, n, value in search_column(batch.column("text"), shared.value)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        out = out.unionByName(d.mapInArrow(task, FOUND))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a copy of an item, with all their columns."""
    def dirty_by(shared):
        def dirty(column: pa.Array) -> pa.Array:
            rows = {r for r, *_ in search_column(column, shared.value)}
            return pa.array([i in rows for i in range(len(column))], pa.bool_())
        return F.arrow_udf(dirty, "boolean")

    for index in indexes(benchmark):
        docs = docs.where(~dirty_by(docs.sparkSession.sparkContext.broadcast(index))("text"))
    return docs


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return copies(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT id, len(w) AS n, list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: list_slice(w, k, least(k + 4, len(w)))) AS s FROM items WHERE len(w) > 0),
ish AS (SELECT id, n, sh, count(*) AS c, any_value(len(s)) AS m FROM (SELECT id, n, s, unnest(s) AS sh FROM i) GROUP BY id, n, sh),
k AS (SELECT DISTINCT least(n, 5) AS k FROM i),
dsh AS (SELECT id, len(w) AS n, k, p, list_slice(w, p + 1, p + k) AS sh FROM docs, k, range(0, 100000) AS r(p) WHERE p + k <= len(w)),
hit AS (SELECT d.id AS doc_id, i.id AS item_id, d.n AS dn, i.n AS n, i.m, d.p, d.sh, i.c, d.k FROM dsh d JOIN ish i ON d.sh = i.sh AND d.k = least(i.n, 5)),
win AS (SELECT doc_id, item_id, dn, n, m, sh, c, s, count(*) AS cw, least(m, dn - k + 1) AS wm
  FROM (SELECT *, unnest(range(greatest(0, p - m + 1), least(p, greatest(dn - n, 0)) + 1)) AS s FROM hit) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, s, least(n, dn) AS n_words, sum(least(c, cw)) AS shared, any_value(wm) AS wm, any_value(m) AS m FROM win GROUP BY doc_id, item_id, s, n_words),
val AS (SELECT *, shared::DOUBLE / (wm + m - shared)::DOUBLE AS similarity FROM sim)
SELECT doc_id, item_id, s::BIGINT AS start_word, n_words::BIGINT AS n_words, similarity
FROM val WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
"""
