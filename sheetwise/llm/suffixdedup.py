"""Exact removal of repeated passages with suffix arrays.

Every byte covered by a 400-byte string that also starts anywhere else, in the
same document or another, is removed.  Strings are judged on the input.

1. *Anchors.*  Of the 32-byte strings inside a 400-byte window the one with the
   least hash (the leftmost of equal ones) is the window's anchor.  Equal windows
   have equal anchors at equal places, so only windows of one anchor can be
   equal, and no window is lost.  Successive windows share anchors: a text of n
   bytes has about n / 185 stretches of windows with one anchor.  One pass over
   the documents gives a row of ids and hashes per stretch, without its bytes.
2. *Counting.*  Anchors that occur once are dropped: nearly all of a clean
   corpus.  Equal stretches are counted: all their windows repeat.  This settles
   exact copies and the inside of passages that any number of documents share,
   with partial aggregates.
3. *Shards.*  Anchors with several different stretches go to shards by anchor,
   one copy of each different stretch with its bytes.  A shard's suffix array
   (``suffixes``: Larsson-Sadakane refinement, Kasai's common prefixes) gives the
   windows that start twice in it.
4. *Across shards.*  Equal windows have one anchor, so shards of different anchors
   need no merging.  An anchor with more than ``SPLIT`` different stretches is
   split over several shards, which are merged by the windows' fingerprints in a
   Spark aggregate and join (instead of by binary search, which would compare all
   pairs of shards).
5. The repeated stretches are joined back to the documents and merged.

Hashes stand for bytes in steps 2 and 4: 64 bits of the anchor and 64 bits of the
stretch or window.  Rows are told apart by doc_id and text, so repeated rows
are copies of each other and both are removed.  Defined results: null text counts
as empty; texts under 400 bytes lose nothing; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .suffixes import repeated_starts

WIDTH = 400
GRAM = 32
SHARD_BYTES = 1 << 20
SPLIT = 8192


class Rolling:
    """64-bit hashes of any stretches of one byte array."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = C._power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return C.mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return C.mix64((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, from running minima of blocks in both directions."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def stretches(text: bytes, width: int = WIDTH, gram: int = GRAM):
    """Arrays start, end, place, anchor, hash: windows starting in
    [start, end - width] have the anchor that lies at ``place``."""
    data = np.frombuffer(text, dtype=np.uint8)
    rolling = Rolling(data)
    grams = rolling.grams(gram)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_minimum(packed, width - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    end = np.append(start[1:], len(place)) - 1 + width
    at = place[start]
    return start, end, at, grams[at], rolling.of(start, end)


OCCURRENCES = "doc long, start int, end int, place int, anchor long, hash long"
STRETCH = ["anchor", "hash"]


def _with_key(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("doc", F.xxhash64("doc_id", "text"))


def occurrences(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    def task(batches):
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            for i, text in enumerate(batch.column("text").cast("binary")):
                text = text.as_py()
                if len(text) >= width:
                    start, end, at, *hashes = stretches(text, width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(start), docs[i], dtype=np.int64)), *(pa.array(x.astype(np.int32)) for x in (start, end, at)), *(pa.array(h.view(np.int64)) for h in hashes)],
                        names=["doc", "start", "end", "place", *STRETCH])

    def grouped(batches):
        # a document has few rows: send them on together
        held, n = [], 0
        for b in task(batches):
            held.append(b)
            n += b.num_rows
            if n >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return keyed.select("doc", "text").mapInArrow(grouped, OCCURRENCES)


# ---- shards ---------------------------------------------------------------------------

def shard_rows(stretches_: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row per different stretch of a contested anchor: its bytes and shard."""
    many = stretches_.groupBy("anchor").agg(F.count("*").alias("variants"))
    s = stretches_.join(many, "anchor")
    size = s.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    salt = F.pmod("hash", F.ceil(F.col("variants") / SPLIT))
    s = s.select("doc", F.struct(*STRETCH, "occurs", "start", "end", "place", (F.col("variants") > SPLIT).alias("split"),
                                 F.when(F.col("variants") > SPLIT, F.xxhash64("anchor", salt)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard")).alias("s"))
    by_doc = s.groupBy("doc").agg(F.collect_list("s").alias("s"))
    texts = keyed.where(C.maybe(C.key_filter(by_doc, "doc"), "doc")).select("doc", "text").dropDuplicates(["doc"]).join(by_doc, "doc")

    def task(batches):
        for batch in batches:
            for text, s in zip(batch.column("text").cast("binary"), batch.column("s").to_pylist(), strict=True):
                text = text.as_py()
                for i in range(0, len(s), 5000):
                    p = s[i:i + 5000]
                    col = lambda k, p=p: [x[k] for x in p]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col("shard"), pa.int64()), *(pa.array(col(k), pa.int64()) for k in STRETCH), pa.array([x["occurs"] > 1 for x in p]), pa.array(col("split")),
                         pa.array([x["place"] - x["start"] for x in p], pa.int32()), pa.array([text[x["start"]:x["end"]] for x in p], pa.binary())],
                        names=["shard", *STRETCH, "settled", "split", "lead", "bytes"])

    return texts.select("text", "s").mapInArrow(task, "shard long, anchor long, hash long, settled boolean, split boolean, lead int, bytes binary")


FOUND = ("anchor long, hash long, spans array<struct<a:int,b:int>>, "
         "prints array<struct<print:long,a:int,open:boolean>>, shard long")


def shard_repeats(table: pa.Table, width: int = WIDTH) -> pa.Table:
    """Of one shard: per stretch the repeated bytes, counted from the anchor, and
    (if the anchor is split over shards) the fingerprints of its windows."""
    strings = table.column("bytes").to_pylist()
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    twice = repeated_starts(data, ends, width)
    settled, split = table.column("settled").to_pylist(), table.column("split").to_pylist()
    lead, rows = table.column("lead").to_pylist(), []
    rolling = Rolling(data) if any(split) else None
    for i in range(len(strings)):
        spans, prints = [], []
        here = twice[starts[i]:ends[i]]
        if not settled[i]:
            spans = [{"a": a - lead[i], "b": b - lead[i]} for a, b in runs(here, width)]
        if split[i]:
            w = np.arange(starts[i], ends[i] - width + 1)
            own = rolling.of(w, w + width).view(np.int64)
            open_ = ~here[:len(w)] & (not settled[i])
            prints = [{"print": int(own[k]), "a": k - lead[i], "open": bool(open_[k])} for k in range(len(w))]
        rows.append((spans, prints))
    types = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.struct([("print", pa.int64()), ("a", pa.int32()), ("open", pa.bool_())]))
    keep = [i for i, (s, p) in enumerate(rows) if s or p]
    out = table.select(STRETCH).take(pa.array(keep, pa.int64()))
    return pa.table([*out.columns, pa.array([rows[i][0] for i in keep], types[0]), pa.array([rows[i][1] for i in keep], types[1]), table.column("shard").take(pa.array(keep, pa.int64()))],
                    names=[*STRETCH, "spans", "prints", "shard"])


def runs(marked: np.ndarray, width: int) -> list[tuple[int, int]]:
    """[a, b) of bytes covered by windows that start at the marked positions."""
    at = np.flatnonzero(marked)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > width)
    first, last = np.append(at[0], at[cut + 1]), np.append(at[cut], at[-1])
    return list(zip(first.tolist(), (last + width).tolist(), strict=True))


def across_shards(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """Spans of windows of split anchors that another shard has as well."""
    p = found.where(F.size("prints") > 0).select(*STRETCH, "shard", F.explode("prints").alias("p")).select(*STRETCH, "shard", "p.*")
    both = p.groupBy("anchor", "print").agg(F.min("shard").alias("x"), F.max("shard").alias("y")).where("x <> y").select("anchor", "print")
    hit = p.where("open").join(both, ["anchor", "print"], "left_semi")
    return hit.groupBy(*STRETCH).agg(F.collect_list(F.struct("a", (F.col("a") + width).alias("b"))).alias("spans"))


# ---- the operator ------------------------------------------------------------------------

def repeats(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, spans): byte ranges of each document that repeat."""
    seen = C.stored(occurrences(keyed, width), "occurrences")
    shared = seen.groupBy("anchor").agg(F.count("*").alias("n"), F.min("hash").alias("x"), F.max("hash").alias("y")).where("n > 1")
    # stored, so that both sides of the join have shuffles of their own and Spark
    # can split the rows of a very common anchor
    shared = C.stored(shared.select("anchor", F.expr("x <> y").alias("contested")), "shared")
    again = C.stored(seen.join(shared, "anchor"), "again")
    counted = again.groupBy(*STRETCH, "contested").agg(F.count("*").alias("occurs"), F.min(F.struct("doc", "start", "end", "place")).alias("one"))
    counted = C.stored(counted.select(*STRETCH, "contested", "occurs", "one.*"), "stretches")

    found = C.stored(shard_rows(counted.where("contested").drop("contested"), keyed).groupBy("shard").applyInArrow(lambda t: shard_repeats(t, width), FOUND), "found")
    spans = found.where(F.size("spans") > 0).select(*STRETCH, "spans").unionByName(across_shards(found, width))
    spans = C.stored(spans.groupBy(*STRETCH).agg(F.flatten(F.collect_list("spans")).alias("spans")), "stretch-spans")
    whole = counted.where("occurs > 1").select(*STRETCH)
    copies = again.join(whole, STRETCH, "left_semi").select("doc", F.col("start").alias("a"), F.col("end").alias("b"))
    parts = again.join(spans, STRETCH).select("doc", "place", F.explode("spans").alias("s")).select("doc", (F.col("place") + F.col("s.a")).alias("a"), (F.col("place") + F.col("s.b")).alias("b"))
    return copies.unionByName(parts).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _report(d: DataFrame, leave_out=None) -> DataFrame:
    """``leave_out``: documents of this key filter are not reported."""
    def task(batches):
        for batch in batches:
            if leave_out is not None:
                batch = batch.filter(pa.array(~C.may_hold(leave_out.value, batch.column("doc").to_numpy())))
            rows = []
            spans_ = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [()] * batch.num_rows
            for text, spans in zip(batch.column("text").cast("binary"), spans_, strict=True):
                text = text.as_py()
                cut = merged(spans)
                kept, at = hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in cut), len(cut), kept.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return d.mapInArrow(task, RESULT)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: sizes, number of removed runs, digest of what is left."""
    keyed = _with_key(docs)
    spans = C.stored(repeats(keyed, width), "spans")
    shared = C.key_filter(spans, "doc")
    # texts are shuffled only where something may have to go
    clean = _report(keyed, leave_out=shared)
    cut = _report(keyed.where(C.maybe(shared, "doc")).join(spans, "doc", "left").select("doc_id", "text", "spans"))
    return clean.unionByName(cut)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return remove_repeats(C.table(spark, sf_dir, "documents"))
