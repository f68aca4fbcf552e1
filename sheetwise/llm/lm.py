"""Language-model scoring by context-tree weighting, next to a unigram score.

The model predicts a text byte by byte, each byte as eight binary decisions.  A
decision's probability is the context-tree mixture over the contexts of 0 to
``DEPTH`` preceding bytes: at each context a Krichevsky-Trofimov estimate from
the training counts, mixed with what the longer contexts say by the weights that
context-tree weighting gives them (their share of the probability of all
training data).  A text is read after ``DEPTH`` line feeds and ends with a zero
byte, which is coded as well; ``score`` is the log10 probability of all of it.

Training uses every training document and every context, however rare.  A key
is a byte and the ``DEPTH`` bytes before it; all that is needed is the count of
each key, and the table of keys grows with the input, so it stays in Spark:

* texts are dealt into chunks of ``CHUNK_BYTES``; each chunk lists its distinct
  keys with their counts in training documents (0 for held-out ones);
* keys are dealt into buckets by their nearest ``TOP`` + 1 bytes, so a bucket has
  every context of more than TOP bytes whole: its contexts are worked through from
  the longest to the shortest, and what goes on are sums by (TOP bytes, decision),
  at most 2^16 x 255 rows whatever the input;
* the driver finishes the contexts of 0 to TOP bytes and broadcasts, for each of
  those rows, the mixture so far and the weight left for longer contexts;
* the buckets again, now downward, give the log probability of each key; these go
  back to the chunks that list the keys, where the texts are added up.

Keys travel packed: one row per chunk and bucket.

``Model`` is the same tree in one process, without contexts under RARE.

Unigram base: counts of all training tokens.  Tokens of at least 2^-22 of the
training tokens (4 million at most) are broadcast; the rest are scored by a join.

Defined results: null and empty texts have one token, the end; rows with a null
doc_id are training rows; each row is scored by itself; with no training rows all
counts are 0 and the model is uniform; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DEPTH = 6
RARE = 2.0 ** -15
FREQUENT_TOKEN = 2.0 ** -22
HELD_OUT_FOLD, FOLDS = 2, 7
CHUNK_BYTES, GROUP_BYTES, TOKEN_BYTES = 8 << 20, 4 << 20, 64 << 20
TOP = 2
BUCKET_BYTES = 4 << 20
PAD = b"\n" * DEPTH


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


# ---- contexts of bytes ---------------------------------------------------------

def padded(texts: list[bytes]) -> np.ndarray:
    """Each text after DEPTH line feeds and before a zero byte."""
    return np.frombuffer(b"".join(x for t in texts for x in (PAD, t, b"\0")), dtype=np.uint8)


def _positions(texts: list[bytes]) -> np.ndarray:
    """Index in ``padded`` of every byte that is predicted."""
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(np.arange(1, len(size) + 1) * DEPTH, size)


def _keys(texts: list[bytes]) -> np.ndarray:
    """Keys of all predicted bytes in order."""
    data = padded(texts)
    key = data[DEPTH:].astype(np.uint64)
    for back in range(1, DEPTH + 1):
        key |= data[DEPTH - back:len(data) - back].astype(np.uint64) << np.uint64(8 * (DEPTH - back + 1))
    return key[_positions(texts) - DEPTH]


def keys_of(texts: list[bytes]) -> np.ndarray:
    """Sorted keys of all predicted bytes: the preceding bytes, the nearest
    first, then the byte itself.  A context of d bytes is the key's first d."""
    return np.sort(_keys(texts))


def _counted(sorted_: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return sorted_, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    n = np.diff(np.append(first, len(sorted_))) if weights is None else np.add.reduceat(weights, first)
    return sorted_[first], n


def _context(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys >> np.uint64(8 * (DEPTH - depth + 1))


def frequent_contexts(keys: np.ndarray, counts: np.ndarray, total: int) -> list[np.ndarray]:
    """Per length 1..DEPTH the contexts of at least RARE of ``total``."""
    out = []
    for d in range(1, DEPTH + 1):
        c, n = _counted(_context(keys, d), counts)
        out.append(c[n >= max(1.0, RARE * total)])
    return out


def _member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def next_bytes(keys: np.ndarray, counts: np.ndarray, contexts: list[np.ndarray]):
    """(length, context << 8 | byte, count) for the named contexts and the empty one."""
    byte = keys & np.uint64(255)
    for d in range(DEPTH + 1):
        c = _context(keys, d) if d else np.zeros(len(keys), dtype=np.uint64)
        if d:
            own, first = np.unique(c, return_index=True)
            keep = np.repeat(_member(contexts[d - 1], own), np.diff(np.append(first, len(c))))
            c, b, n = c[keep], byte[keep], counts[keep]
        else:
            b, n = byte, counts
        gram = (c << np.uint64(8)) | b
        order = np.argsort(gram, kind="stable")
        yield d, *_counted(gram[order], n[order])


# ---- the tree ------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: shifted by seven, then Stirling's series."""
    y = x + 7
    shift = np.log(x)
    for k in range(1, 7):
        shift = shift + np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 binary decisions of the byte counts (n, 256).
    Decision k >= 1 stands for the bits after its leading one."""
    n = len(counts)
    total = np.zeros((n, 512))
    total[:, 256:] = counts
    for k in range(255, 0, -1):
        total[:, k] = total[:, 2 * k] + total[:, 2 * k + 1]
    return total[:, 2:512:2], total[:, 3:512:2]  # children of decisions 1..255


class Model:
    """states: contexts by length, then value; ``log10`` (states, 256) of the
    next byte; ``move`` (states, 256) to the next state."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], total: int):
        """counts: per length the sorted (context << 8 | byte) and their counts."""
        contexts, kept = [], []
        for d, (gram, n) in enumerate(counts):
            c, of = np.unique(gram >> np.uint64(8), return_inverse=True)
            large = np.bincount(of, n, len(c)) >= max(1.0, RARE * total)
            kept.append(large[of])
            contexts.append(c[large] if d else np.zeros(1, dtype=np.uint64))
        # a context's parent leaves out its farthest byte
        parents = [None] + [np.searchsorted(contexts[d - 1], contexts[d] >> np.uint64(8)) for d in range(1, DEPTH + 1)]

        def table(d: int) -> np.ndarray:
            gram, n = (x[kept[d]] for x in counts[d])
            out = np.zeros((len(contexts[d]), 256))
            out[np.searchsorted(contexts[d], gram >> np.uint64(8)), (gram & np.uint64(255)).astype(np.int64)] = n
            return out

        # upward: probability of all data below each context, and its own weight
        estimate, weight, rest = ([None] * (DEPTH + 1) for _ in range(3))
        below = longer_table = None
        for d in range(DEPTH, -1, -1):
            here = table(d)
            zeros, ones = _decisions(here)
            own = _log_kt(zeros, ones)
            estimate[d] = ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32)
            if d == DEPTH:
                weight[d], below = np.ones_like(own, dtype=np.float32), own
            else:
                split, left = np.zeros_like(own), here.copy()
                np.subtract.at(left, parents[d + 1], longer_table)
                np.add.at(split, parents[d + 1], below)
                zeros, ones = _decisions(left)
                split += _log_kt(zeros, ones)
                rest[d] = ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32)
                below = np.logaddexp(own, split) + math.log(0.5)
                weight[d] = np.exp(own + math.log(0.5) - below).astype(np.float32)
            longer_table = here
        del longer_table, below

        # downward: the mixture so far, and the weight left for longer contexts
        start = np.cumsum([0] + [len(c) for c in contexts])
        self.log10 = np.empty((start[-1], 256), dtype=np.float32)
        self.move = np.empty((start[-1], 256), dtype=np.int32)
        mixed = open_ = None
        bits = [((1 << k) | (np.arange(256) >> (8 - k))) - 1 for k in range(8)]
        ones_at = [(np.arange(256) >> (7 - k)) & 1 for k in range(8)]
        for d in range(DEPTH + 1):
            before, left = (0.0, 1.0) if d == 0 else (mixed[parents[d]], open_[parents[d]])
            mixed = before + left * weight[d] * estimate[d]
            open_ = left * (1 - weight[d])
            p = mixed if d == DEPTH else mixed + open_ * rest[d]
            p = np.clip(p, 1e-12, 1 - 1e-12)
            out = np.zeros((len(p), 256))
            for k in range(8):
                q = p[:, bits[k]]
                out += np.log10(np.where(ones_at[k], q, 1 - q))
            s = slice(start[d], start[d + 1])
            self.log10[s] = out
            # a frequent context's every part is frequent, so the next context
            # is the byte after this one, or what its parent moves to
            move = self.move[start[d - 1]:start[d]][parents[d]] if d else np.zeros((1, 256), dtype=np.int32)
            if d < DEPTH:
                longer = (np.arange(256, dtype=np.uint64) << np.uint64(8 * d))[None, :] | contexts[d][:, None]
                found = np.searchsorted(contexts[d + 1], longer)
                known = _member(contexts[d + 1], longer.ravel()).reshape(longer.shape)
                move = np.where(known, found + start[d + 1], move)
            self.move[s] = move

    def score(self, texts: list[bytes], lanes: int = 4096) -> np.ndarray:
        """log10 probability of each text.  The bytes are dealt into lanes that
        advance together; each starts DEPTH bytes early, which fixes its state."""
        data, at = padded(texts), _positions(texts)
        steps = -(-len(data) // lanes) if len(data) > 16 * lanes else len(data)
        lanes = -(-len(data) // steps) if steps else 0
        padded_ = np.full(lanes * steps + DEPTH, 10, dtype=np.uint8)
        padded_[DEPTH:DEPTH + len(data)] = data
        begin = np.arange(lanes) * steps
        state = np.zeros(lanes, dtype=np.int64)
        table, move = self.log10.ravel(), self.move.ravel()
        for k in range(DEPTH):
            state = move[(state << 8) | padded_[begin + k]].astype(np.int64)
        out = np.empty((steps, lanes), dtype=np.float32)
        for k in range(steps):
            cell = (state << 8) | padded_[begin + (DEPTH + k)]
            out[k] = table[cell]
            state = move[cell].astype(np.int64)
        values = out.T.ravel()[at].astype(np.float64)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]) if texts else []
        return np.add.reduceat(values, np.array(first, dtype=np.int64)) if texts else values


# ---- the whole tree, by parts -------------------------------------------------

_SMALL = np.arange(1 << 16, dtype=np.float64)
_HALF, _WHOLE = _log_gamma(_SMALL + 0.5), _log_gamma(_SMALL + 1.0)


def _looked_up(table: np.ndarray, counts: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(counts, len(table) - 1)]
    large = np.flatnonzero(counts >= len(table))
    out[large] = _log_gamma(counts[large] + add)
    return out


class Levels:
    """One decision's nodes, from contexts of ``deep`` bytes up to ``top`` bytes.
    ``nodes``: the node's place in the byte, then its context, sorted, ``deep``
    bytes of it; zeros and ones: its counts; ``longer``: log probability of all
    data below, or None where contexts end."""

    def __init__(self, nodes, zeros, ones, longer, deep: int, top: int):
        self.estimate, self.weight, self.up = [], [], []
        for d in range(deep, top - 1, -1):
            if d < deep:
                nodes = nodes >> np.uint64(8)
                first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
                self.up.append(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(nodes)))))
                nodes, zeros, ones, longer = nodes[first], np.add.reduceat(zeros, first), np.add.reduceat(ones, first), np.add.reduceat(self.below, first)
            own = _looked_up(_HALF, zeros, 0.5) + _looked_up(_HALF, ones, 0.5) - _looked_up(_WHOLE, zeros + ones, 1.0) - math.log(math.pi)
            self.estimate.append((ones + 0.5) / (zeros + ones + 1))
            self.below = own if longer is None else np.logaddexp(own, longer) + math.log(0.5)
            self.weight.append(np.ones_like(own) if longer is None else np.exp(own + math.log(0.5) - self.below))
        self.nodes, self.zeros, self.ones = nodes, zeros, ones

    def mixture(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per longest context: the mixture of all lengths, the weight that is
        left for still longer ones, and the number of its shortest context."""
        mixed, open_ = self.weight[0] * self.estimate[0], 1 - self.weight[0]
        at = np.arange(len(mixed))
        for estimate, weight, up in zip(self.estimate[1:], self.weight[1:], self.up, strict=True):
            at = up[at]
            mixed = weight[at] * estimate[at] + (1 - weight[at]) * mixed
            open_ = (1 - weight[at]) * open_
        return mixed, open_, at


def _decided(keys: np.ndarray, counts: np.ndarray):
    """For each of the eight decisions: order of the keys, number of each ordered
    key's longest context, its bit, and the Levels of contexts over TOP bytes."""
    byte = (keys & np.uint64(255)).astype(np.uint8)
    context = keys >> np.uint64(8)
    for k in range(8):
        place = (1 << k) | (byte.astype(np.uint16) >> (8 - k))
        order = np.argsort(place, kind="stable")
        nodes = (place[order].astype(np.uint64) << np.uint64(8 * DEPTH)) | context[order]
        new = np.concatenate([[True], nodes[1:] != nodes[:-1]])
        first = np.flatnonzero(new)
        bit = (byte[order] >> (7 - k)) & 1
        n = counts[order]
        ones = np.add.reduceat(n * bit, first)
        yield order, np.cumsum(new) - 1, bit, Levels(nodes[first], np.add.reduceat(n, first) - ones, ones, None, DEPTH, TOP + 1)


def top_sums(keys: np.ndarray, counts: np.ndarray):
    """(nodes of TOP bytes, zeros, ones, log probability of all data below)."""
    for _, _, _, levels in _decided(keys, counts):
        nodes = levels.nodes >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        yield nodes[first], np.add.reduceat(levels.zeros, first), np.add.reduceat(levels.ones, first), np.add.reduceat(levels.below, first)


def key_logs(keys: np.ndarray, counts: np.ndarray, top) -> np.ndarray:
    """log10 probability of every key; ``top``: nodes of TOP bytes, the mixture
    so far and the weight left."""
    known, before, left = top
    out = np.zeros(len(keys))
    for order, at, bit, levels in _decided(keys, counts):
        mixed, _, short = levels.mixture()
        above = np.searchsorted(known, levels.nodes >> np.uint64(8))[short]
        p = np.clip(before[above] + left[above] * mixed, 1e-12, 1 - 1e-12)[at]
        out[order] += np.log10(np.where(bit, p, 1 - p))
    return out


# ---- on Spark --------------------------------------------------------------------

COUNTS = "key long, n long"
KEYS = "bucket int, chunk long, keys binary"
BUCKETS = "bucket int, keys binary, chunks array<long>, places array<binary>"
SUMS = "node long, zeros long, ones long, below double"
LOGS = "chunk long, bucket int, logs binary"
TEXTS = "row long, chunk long, doc_id long, held_out boolean, text string"


class Totals:
    """Sums of counts by key, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray, most: int = 8) -> None:
        self.parts.append((keys, counts))
        if len(self.parts) >= most:
            self.parts = [self.sums()]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys)
        return _counted(keys[order], counts[order])


def _rows(names: list[str], *columns: np.ndarray):
    for i in range(0, len(columns[0]), 200_000):
        part = [c[i:i + 200_000] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in part], names=names)


def numbered(docs: DataFrame) -> DataFrame:
    """TEXTS: rows get a number, and consecutive rows a chunk."""
    def task(batches):
        row = chunk = TaskContext.get().partitionId() << 33
        held = 0
        for batch in batches:
            chunks = []
            for n in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
                if held and held + n > CHUNK_BYTES:
                    chunk, held = chunk + 1, 0
                held += n + 1
                chunks.append(chunk)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + k)), pa.array(chunks, pa.int64()), batch.column("doc_id"), batch.column("held_out"), batch.column("text")], names=["row", "chunk", "doc_id", "held_out", "text"])
            row += k

    return docs.select("doc_id", "held_out", "text").mapInArrow(task, TEXTS)


def count_tokens(train: DataFrame) -> DataFrame:
    def task(batches):
        tokens, held = Totals(), 0
        for batch in batches:
            for _, texts in C.text_groups(batch.column("text"), GROUP_BYTES):
                data, _ = C.joined(texts)
                hashes = C.word_hashes(data, *C.split_words(data))
                hashes.sort()
                tokens.add(*_counted(hashes))
                held += len(data)
                if held >= TOKEN_BYTES:  # most tokens are rare: their table grows with the text
                    yield from _rows(["key", "n"], *tokens.sums())
                    tokens, held = Totals(), 0
        if tokens.parts:
            yield from _rows(["key", "n"], *tokens.sums())

    return train.select("text").mapInArrow(task, COUNTS)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values, the first ascending; bytes of a kind together."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(len(kinds), 8, -1)
    out = [np.ascontiguousarray(p.T).view(k).ravel() for p, k in zip(planes, kinds, strict=True)]
    return [np.cumsum(out[0], dtype=kinds[0]), *out[1:]]


def _bucketed(keys: np.ndarray, buckets: int):
    """Order of the keys by bucket, then key; the buckets and where they start."""
    bucket = (C.mix64(keys >> np.uint64(8 * (DEPTH - TOP))) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    return order, *np.unique(bucket[order], return_index=True)


def chunk_keys(texts: DataFrame, buckets: int) -> DataFrame:
    """The keys of each chunk and how often training documents hold them.  A chunk
    that is read by two tasks lists keys twice, which ``by_bucket`` joins."""
    def groups(batches):
        chunk, held, size = None, ([], []), 0
        for batch in batches:
            for c, h, t in zip(batch.column("chunk").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast("binary").to_pylist(), strict=True):
                if size and (c != chunk or size + len(t or b"") > GROUP_BYTES):
                    yield chunk, held
                    held, size = ([], []), 0
                chunk = c
                held[h].append(t or b"")
                size += len(t or b"") + 1
        if size:
            yield chunk, held

    def listed(chunk, seen):
        keys, n = seen.sums()
        order, bucket, start = _bucketed(keys, buckets)
        for k, at in zip(bucket.tolist(), np.split(order, start[1:]), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk], pa.int64()), pa.array([packed(keys[at], n[at])], pa.binary())], names=["bucket", "chunk", "keys"])

    def task(batches):
        current, seen = None, Totals()
        for chunk, held in groups(batches):
            if seen.parts and chunk != current:
                yield from listed(current, seen)
                seen = Totals()
            current = chunk
            for part, is_held in zip(held, (False, True), strict=True):
                if part:
                    keys, n = _counted(keys_of(part))
                    seen.add(keys, n * (not is_held))
        if seen.parts:
            yield from listed(current, seen)

    return texts.select("chunk", "held_out", "text").mapInArrow(task, KEYS)


def by_bucket(keys: DataFrame) -> DataFrame:
    """One row per bucket: its keys and counts, and per chunk the places of its
    keys among them."""
    def merge(rows: pa.Table) -> pa.Table:
        chunks, blobs = rows.column("chunk").to_pylist(), rows.column("keys").to_pylist()
        seen, own = Totals(), {}
        for chunk, blob in zip(chunks, blobs, strict=True):
            seen.add(*unpacked(blob, np.uint64, np.int64))
        all_, n = seen.sums()
        for chunk, blob in zip(chunks, blobs, strict=True):
            place = np.searchsorted(all_, unpacked(blob, np.uint64, np.int64)[0])
            own[chunk] = packed(np.union1d(unpacked(own[chunk], np.int64)[0], place) if chunk in own else place)
        return pa.table({"bucket": rows.column("bucket")[:1], "keys": pa.array([packed(all_, n)], pa.binary()), "chunks": pa.array([list(own)], pa.list_(pa.int64())),
                         "places": pa.array([list(own.values())], pa.list_(pa.binary()))})

    return keys.groupBy("bucket").applyInArrow(merge, BUCKETS)


def fit_top(keys: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of up to TOP bytes: nodes, mixture so far and weight left."""
    def task(batches):
        for batch in batches:
            for blob in batch.column("keys"):
                for part in top_sums(*unpacked(blob.as_py(), np.uint64, np.int64)):
                    yield from _rows(["node", "zeros", "ones", "below"], *part)

    sums = keys.select("keys").mapInArrow(task, SUMS).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    node, zeros, ones, below = _columns(sums, "node", "zeros", "ones", "below")
    order = np.argsort(node)
    nodes = node[order].view(np.uint64)
    if not len(nodes):
        return nodes, below, below
    mixed, open_, _ = Levels(nodes, zeros[order], ones[order], below[order], TOP, 0).mixture()
    return nodes, mixed, open_


def log_keys(keys: DataFrame, top) -> DataFrame:
    """LOGS: the log10 probabilities of a chunk's keys in a bucket, by key."""
    shared = keys.sparkSession.sparkContext.broadcast(top)

    def task(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, blob, chunks, places = (batch.column(c)[row].as_py() for c in ("bucket", "keys", "chunks", "places"))
                logs = key_logs(*unpacked(blob, np.uint64, np.int64), shared.value).astype(np.float32)
                for chunk, place in zip(chunks, places, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([logs[unpacked(place, np.int64)[0]].tobytes()], pa.binary())], names=["chunk", "bucket", "logs"])

    return keys.mapInArrow(task, LOGS)


def tree_scores(texts: DataFrame) -> DataFrame:
    """row and score of every text."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 8 + size // BUCKET_BYTES
    keys = C.stored(by_bucket(chunk_keys(texts, buckets)), "keys")
    logs = log_keys(keys, fit_top(keys))

    def add_up(rows: pa.Table, logs: pa.Table) -> pa.Table:
        parts = sorted(zip(logs.column("bucket").to_pylist(), logs.column("logs").to_pylist(), strict=True))
        # the chunk's keys once more, in the order in which it listed them
        seen = Totals()
        for _, texts in C.text_groups(rows.column("text"), GROUP_BYTES):
            seen.add(*_counted(keys_of(texts)))
        known = seen.sums()[0]
        log = np.empty(len(known), dtype=np.float32)
        log[_bucketed(known, buckets)[0]] = np.frombuffer(b"".join(p for _, p in parts), dtype=np.float32)
        out = []
        for _, texts in C.text_groups(rows.column("text"), GROUP_BYTES):
            key = _keys(texts)
            order = np.argsort(key)
            distinct, n = _counted(key[order])
            value = np.empty(len(key))
            value[order] = np.repeat(log[np.searchsorted(known, distinct)], n)
            size = np.array([len(t) + 1 for t in texts])
            out.append(np.add.reduceat(value, np.cumsum(size) - size))
        return pa.table({"row": rows.column("row"), "score": np.concatenate(out)})

    return texts.select("chunk", "row", "text").groupBy("chunk").cogroup(logs.groupBy("chunk")).applyInArrow(add_up, "row long, score double")


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    t = df.select(*names).toArrow()
    return [t.column(n).to_numpy() for n in names]


SCORED = "row long, doc_id long, held_out boolean, words long, log_known double, known long, rare array<struct<key:long,m:long>>"


def score(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    d = C.stored(numbered(d), "texts")
    train = d.where(~F.col("held_out"))
    tokens = C.stored(count_tokens(train).groupBy("key").agg(F.sum("n").alias("n")), "tokens")
    ends = train.count()  # every training document has one end token
    r = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = r["n"] + ends, r["v"] + (ends > 0)
    cut = max(1.0, FREQUENT_TOKEN * total)
    key, n = _columns(tokens.where(F.col("n") >= cut), "key", "n")
    order = np.argsort(key.view(np.uint64))
    shared = spark.sparkContext.broadcast((key.view(np.uint64)[order], np.log10(n[order] + 1.0)))

    def task(batches):
        known, logs = shared.value
        for batch in batches:
            row, ids, held = batch.column("row"), batch.column("doc_id"), batch.column("held_out")
            for first, texts in C.text_groups(batch.column("text"), 4 << 20):
                data, offsets = C.joined(texts)
                starts, ends_ = C.split_words(data)
                hashes = C.word_hashes(data, starts, ends_)
                edge = np.searchsorted(starts, offsets)
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
                gain = np.zeros(len(hashes) + 1)
                if len(known):
                    gain[1:] = np.cumsum(np.where(hit, logs[at], 0.0))
                hits = np.concatenate([[0], np.cumsum(hit)])
                doc = np.repeat(np.arange(len(texts)), np.diff(edge))[~hit]
                # the other tokens, counted per document
                order = np.lexsort((hashes[~hit], doc))
                doc, other = doc[order], hashes[~hit][order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])])) if len(doc) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.append(new, len(doc)))
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[new], np.arange(len(texts) + 1)), pa.int32()),
                                                pa.StructArray.from_arrays([pa.array(other[new].view(np.int64)), pa.array(times)], names=["key", "m"]))
                k = len(texts)
                yield pa.RecordBatch.from_arrays([
                    row.slice(first, k), ids.slice(first, k), held.slice(first, k), pa.array(np.diff(edge)),
                    pa.array(gain[edge[1:]] - gain[edge[:-1]]), pa.array(hits[edge[1:]] - hits[edge[:-1]]), rare],
                    names=["row", "doc_id", "held_out", "words", "log_known", "known", "rare"])

    scored = C.stored(d.select("row", "doc_id", "held_out", "text").mapInArrow(task, SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.m")
    found = rare.join(tokens.where(F.col("n") < cut), "key").groupBy("row").agg(
        F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("m").alias("rare_known"))
    known_end = int(ends > 0)
    space = math.log10(total + distinct + 1)
    return scored.drop("rare").join(found, "row", "left").join(C.stored(tree_scores(d), "scores"), "row").select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + known_end).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_known") + F.coalesce("rare_log", F.lit(0.0)) + math.log10(ends + 1) - (F.col("words") + 1) * space).alias("base_score"),
        "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return score(C.table(spark, sf_dir, "documents"))
