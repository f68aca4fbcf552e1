"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

Inputs x of a text.  Words (case-folded, with their punctuation) are hashed into
WORD_SLOTS slots; a slot's value is log(1 + count), and a text's word values
have length 1 together.  Every structure statistic (shares of capitals, symbols,
digits, repeated words, windows and lines, mean lengths, ...) lights one of its
fixed bins.  The only metadata is ``n_chars``: whether it agrees with the text.
Label columns, lang, source and doc_id are never inputs.

    z(x) = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

The bracket is the sum over all pairs of <v_i, v_j> x_i x_j, so a score takes
time linear in the number of non-zero inputs.  The score is 1 / (1 + exp(-z)).

Training: at most MOST labelled documents (the smallest hashes of doc_id among
labels whose fold is not held out), whose inputs are computed in Spark tasks and
gathered on the driver (at most MOST x (WORD_SLOTS + a few) numbers), then
mini-batches of AdaGrad on the logistic loss.  Scoring is one map over whole
texts; nothing is shuffled.

Defined results.  Null and empty texts are scored like any text, from their
statistics (no words).  Very long texts are read whole, one text at a time.
Repeated rows get one row each with the same score.  A null doc_id counts as the
empty string in the fold (crc32 0, held out).  Labels other than 0 and 1, of a
null id, or that contradict each other for one id are not learned from.  With
no label at all every score is 0.5; with one class only, the smoothed share of
that class.  A document id with several texts is learned from its least text.
Equal inputs give equal scores on any partitioning.  Extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORD_SLOTS = 1 << 13
RANK = 8
MOST = 8_000
EPOCHS = 12
STEPS = 200  # mini-batches at least, for small samples
BATCH = 64
RATE = 0.1
DECAY = 3e-4
FOLDS = 5
WINDOW = 5
PREDICT_AT = 0.3

_SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.035, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
_COUNTS = 2.0 ** np.arange(0, 17) - 0.5
_MEANS = np.array([0.5, 1.5, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0, 14.0, 30.0])

#: statistic -> bin edges
STATISTICS = {
    "words": _COUNTS, "lines": _COUNTS, "longest_word": _COUNTS, "word_length": _MEANS, "line_words": _COUNTS,
    "capitals": _SHARES, "digits": _SHARES, "stops": _SHARES, "marks": _SHARES, "symbols": _SHARES, "bars": _SHARES,
    "brackets": _SHARES, "controls": _SHARES, "beyond_ascii": _SHARES, "blank": _SHARES, "distinct_words": _SHARES,
    "stuttered_words": _SHARES, "repeated_windows": _SHARES, "repeated_lines": _SHARES, "top_word": _SHARES, "claimed": np.array([0.5, 1.5, 2.5]),
}
_FIRST = {}
SLOTS = WORD_SLOTS
for _name, _edges in STATISTICS.items():
    _FIRST[_name] = SLOTS
    SLOTS += len(_edges) + 1


def _class(of: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(of)] = True
    return out


_KINDS = {
    "digits": _class(b"0123456789"), "stops": _class(b".,;:"), "marks": _class(b"!?"), "symbols": _class(b"#*$%&@^~=+_\\/"), "bars": _class(b"|"),
    "brackets": _class(b"<>[]{}()"), "controls": _class(bytes([*range(9), *range(14, 32), 127])), "beyond_ascii": np.arange(256) >= 128, "blank": _class(b" \t\n\x0b\f\r"),
}
_UPPER, _LETTER = _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)]))
_INNER = (np.arange(256) & 0xC0) == 0x80


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items of (doc, hash): how often each occurs in its document, whether
    it is the first there, and its group."""
    own = C.mix64(hashes + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, first, group, n = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(own), dtype=bool)
    is_first[first] = True
    return n[group], is_first, group


def inputs(texts: list[bytes], claimed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, value) of all non-zero inputs of a few texts, by
    document.  ``claimed``: n_chars of the row, NaN if there is none."""
    data, offsets = C.joined(texts)
    docs = len(texts)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    per_doc = lambda of, weights=None: np.bincount(of, weights, minlength=docs)
    size = np.diff(offsets) - 1
    starts, ends = C.split_words(data)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n_words = per_doc(doc)
    hashes = C.word_hashes(data, starts, ends)
    length = (ends - starts).astype(np.float64)
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, length)
    times, first, _ = _repeats(doc, hashes)
    top = np.zeros(docs)
    np.maximum.at(top, doc, times)
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])

    covered = np.zeros(len(doc) + 1, dtype=np.int64)
    windows = C.chain(hashes, WINDOW)
    at = np.flatnonzero(doc[:len(windows)] == doc[WINDOW - 1:]) if len(windows) else np.zeros(0, dtype=np.int64)
    if len(at):
        again = at[_repeats(doc[at], windows[at])[0] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    covered = np.cumsum(covered)[:-1] > 0

    line_ends = np.flatnonzero(data == 10)
    line = np.searchsorted(line_ends, starts)
    line_first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, dtype=np.int64)
    line_doc = doc[line_first]
    n_lines = per_doc(line_doc)
    doubled = np.zeros(docs)
    if len(line_first):
        place = (np.arange(len(line)) - np.repeat(line_first, np.diff(np.append(line_first, len(line))))).astype(np.uint64)
        sums_of = np.add.reduceat(C.mix64(hashes + place * np.uint64(0xD6E8FEB86659FD93)), line_first)
        doubled = per_doc(line_doc, ~_repeats(line_doc, sums_of)[1])

    letters, n_chars = sums(_LETTER[data]), size - sums(_INNER[data])
    agrees = np.where(np.isnan(claimed), 0, np.where(claimed == n_chars, 1, np.where(claimed < n_chars, 2, 3)))
    values = {
        "words": n_words, "lines": n_lines, "longest_word": longest, "word_length": _share(per_doc(doc, length), n_words), "line_words": _share(n_words, n_lines),
        "capitals": _share(sums(_UPPER[data]), letters), "distinct_words": _share(per_doc(doc, first), n_words), "stuttered_words": _share(per_doc(doc, same), n_words),
        "repeated_windows": _share(per_doc(doc, covered), n_words), "repeated_lines": _share(doubled, n_lines), "top_word": _share(top, n_words), "claimed": agrees,
        **{k: _share(sums(v[data]) - (k == "blank"), size) for k, v in _KINDS.items()},
    }
    bins = np.stack([_FIRST[k] + np.searchsorted(edges, values[k], side="left") for k, edges in STATISTICS.items()], axis=1)

    slot = (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
    key, n = np.unique(doc * WORD_SLOTS + slot, return_counts=True)
    word_doc, x = key // WORD_SLOTS, np.log1p(n)
    x /= np.sqrt(per_doc(word_doc, x * x))[word_doc] if len(x) else 1.0

    all_docs = np.concatenate([word_doc, np.repeat(np.arange(docs), bins.shape[1])])
    order = np.argsort(all_docs, kind="stable")
    return all_docs[order], np.concatenate([key % WORD_SLOTS, bins.ravel()])[order], np.concatenate([x, np.ones(bins.size)])[order]


@dataclass
class Machine:
    bias: float
    weights: np.ndarray   # SLOTS
    factors: np.ndarray   # SLOTS x RANK

    def margins(self, begin: np.ndarray, slot: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """z of the rows that begin at ``begin`` (every row has an input), and
        their factor sums."""
        part = self.factors[slot] * value[:, None]
        total = np.add.reduceat(part, begin)
        pairs = (total * total - np.add.reduceat(part * part, begin)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.weights[slot] * value, begin) + pairs, total

    def scores(self, doc: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        return _sigmoid(self.margins(begin, slot, value)[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS,
          rate: float = RATE, decay: float = DECAY, seed: int = 13) -> Machine:
    """AdaGrad on the logistic loss; ``rows``: (slots, values) of each text."""
    r = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SLOTS), r.normal(0, 0.05, (SLOTS, rank)))
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    seen_w, seen_v, seen_b = np.full(SLOTS, 1e-8), np.full((SLOTS, rank), 1e-8), 1e-8
    for _ in range(max(epochs, -(-STEPS * BATCH // len(rows)))):
        order = r.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            some = order[i:i + BATCH]
            slot, value = np.concatenate([rows[j][0] for j in some]), np.concatenate([rows[j][1] for j in some])
            sizes = np.array([len(rows[j][0]) for j in some])
            z, total = m.margins(np.concatenate([[0], np.cumsum(sizes)[:-1]]), slot, value)
            off = (_sigmoid(z) - labels[some]) / len(some)
            pull = np.repeat(off, sizes) * value
            used, back = np.unique(slot, return_inverse=True)
            grad_w = np.bincount(back, pull) + decay * m.weights[used]
            inner = pull[:, None] * (np.repeat(total, sizes, axis=0) - m.factors[slot] * value[:, None])
            grad_v = np.stack([np.bincount(back, inner[:, f]) for f in range(rank)], axis=1) + decay * m.factors[used]
            seen_w[used] += grad_w ** 2
            seen_v[used] += grad_v ** 2
            seen_b += off.sum() ** 2
            m.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            m.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            m.bias -= rate * off.sum() / np.sqrt(seen_b)
    return m


# ---- Spark side -------------------------------------------------------------

def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _texts(docs: DataFrame, *extra: Column) -> DataFrame:
    claimed = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(*extra, F.col("text"), claimed.alias("claimed"))


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    claimed = batch.column("claimed").to_numpy(zero_copy_only=False).astype(np.float64)
    for first, texts in C.text_groups(batch.column("text")):
        yield first, len(texts), *inputs(texts, claimed[first:first + len(texts)])


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, doc, slot, value in _batches(batch):
            begin = np.searchsorted(doc, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(first, n), batch.column("quality").slice(first, n),
                pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(slot, pa.int32())),
                pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(value, pa.float32()))], names=["doc_id", "quality", "slots", "vals"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, folds: int = FOLDS) -> Machine:
    """Learn from at most ``most`` labelled documents outside the held-out fold."""
    one = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("upper")).where("quality = upper")
    some = one.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = _texts(docs, F.col("doc_id")).join(F.broadcast(some), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "claimed")).alias("t"))
    got = rows.select("doc_id", "quality", "t.text", "t.claimed").mapInArrow(_as_rows, "doc_id long, quality int, slots array<int>, vals array<float>").toArrow().sort_by("doc_id")
    slots, vals = got.column("slots").combine_chunks(), got.column("vals").combine_chunks()
    begin = slots.offsets.to_numpy()
    flat_slots, flat_vals = slots.values.to_numpy(), vals.values.to_numpy().astype(np.float64)
    return train([(flat_slots[a:b], flat_vals[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)], got.column("quality").to_numpy())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, doc, slot, value in _batches(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(shared.value.scores(doc, slot, value))], names=["doc_id", "score"])

    return _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(scored, "doc_id long, score double")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.table(spark, sf_dir, "documents")
    machine = fit(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
