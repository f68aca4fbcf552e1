"""Best-two-fit packing of tokenized documents into sequences.

Only lengths matter to packing, and there are at most ``CAPACITY`` of them.  So
the packing itself runs on the histogram of piece lengths: a bin is filled
greedily (largest remaining length that fits), then its smallest piece is
replaced by two unpacked pieces if these fit the gap so expanded more tightly.
A bin pattern is repeated as often as the remaining counts allow, so the plan
has a few thousand patterns whatever the number of documents, and it is the
packing that treating the bins one by one would give.  Spark does the rest: it
tokenizes, counts, numbers the pieces of each length and looks each number up in
the plan.

Numbering is distributed: pieces are dealt into chunks by hash, numbered inside
(length, chunk), and shifted by the counts of earlier chunks.  A length that
holds a third of all pieces is spread over all chunks.

Defined results: null and empty texts are one piece of length 1 (id 0); repeated
rows are packed as often as they occur; a null doc_id is kept; an empty table
gives an empty result; very long texts are cut into pieces of 2048 ids.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
END_ID = 0
CHUNK_ROWS = 10_000
CACHED_WORDS = 1_000_000
SLOT_BITS = 21
PUNCTUATION = string.punctuation.encode()

_tokenizers: dict = {}


class WordCoder:
    """Token ids of texts, by way of their white-space delimited words.

    The tokenizer drops white space and no token or normalisation reaches across
    ASCII white space, so a text's ids are those of its words one after another.
    Nor does a token span letters and the punctuation after them, so a word of
    letters with a tail of ASCII punctuation is the letters' ids and the tail's,
    and ASCII letters can be lower-cased first: most new words are made of known
    parts.

    Words are found and hashed for a whole group of texts at once and looked up
    by their 64-bit hash: first in a direct-mapped table, then in a dictionary.
    The ids of all known words lie in one array.  A full coder starts anew."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.parts: dict[bytes, array] = {}
        self.ids, self.used = np.zeros(1 << 20, dtype="<u4"), 0
        self.first, self.length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.slot_hash, self.slot_number = np.zeros(1 << SLOT_BITS, dtype=np.uint64), np.full(1 << SLOT_BITS, -1, dtype=np.int64)

    def _tokenize(self, parts: list[bytes], whole: bool) -> None:
        """``whole``: parts that are one pre-token each.  Many of them are encoded
        as one text; its ids fall apart after each id that ends a word."""
        for i in range(0, len(parts), 2_000):
            some = parts[i:i + 2_000]
            if whole:
                ids = self.tokenizer.encode(" ".join([w.decode() for w in some]), add_special_tokens=False).ids
                stop = np.flatnonzero(self.ends_word[ids]) + 1
                if len(stop) == len(some) and stop[-1] == len(ids):
                    ids, stop = array("I", ids), stop.tolist()
                    self.parts.update((w, ids[a:b]) for w, a, b in zip(some, [0, *stop], stop, strict=False))
                    continue
            coded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
            self.parts.update((w, array("I", e.ids)) for w, e in zip(some, coded, strict=True))

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        """Adds words that are not known."""
        split, odd = [], set()
        for w in words:
            head = w.rstrip(PUNCTUATION)
            if head.isalpha():  # ASCII letters only
                split.append((head.lower(), w[len(head):]))
            elif head and head.decode("utf-8", "replace").isalpha():
                split.append((head, w[len(head):]))
            else:
                split.append((w, b""))
                odd.add(w)
        self.parts.setdefault(b"", array("I"))
        wanted = {x for pair in split for x in pair} - self.parts.keys()
        self._tokenize(list(wanted - odd), True)
        self._tokenize(list(wanted & odd), False)
        new = array("I")
        lengths = np.empty(len(words), dtype=np.int64)
        for i, (a, b) in enumerate(split):
            a, b = self.parts[a], self.parts[b]
            new += a
            new += b
            lengths[i] = len(a) + len(b)
        n, k = len(self.number), len(words)
        self.ids = self._room(self.ids, self.used, len(new))
        self.first, self.length = self._room(self.first, n, k), self._room(self.length, n, k)
        self.ids[self.used:self.used + len(new)] = new
        self.first[n:n + k] = self.used + np.cumsum(lengths) - lengths
        self.length[n:n + k] = lengths
        self.used += len(new)
        self.number.update(zip(hashes, range(n, n + k), strict=True))

    @staticmethod
    def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
        return a if used + more <= len(a) else np.concatenate([a, np.zeros(max(len(a), more), dtype=a.dtype)])

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = C.word_hashes(data, starts, ends, fold=False)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        numbers = np.where(self.slot_hash[slot] == hashes, self.slot_number[slot], -1)
        lost = np.flatnonzero(numbers < 0)
        if len(lost):
            value, at, back = np.unique(hashes[lost], return_index=True, return_inverse=True)
            keys = value.tolist()
            new = [i for i, h in enumerate(keys) if h not in self.number]
            if new:
                where = lost[at[new]]
                raw = data.tobytes()
                self._learn([keys[i] for i in new], [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            found = np.array([self.number[h] for h in keys], dtype=np.int64)
            numbers[lost] = found[back]
            s = (value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.slot_hash[s], self.slot_number[s] = value, found
        return numbers

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.number) > CACHED_WORDS:
            self.clear()
        data, offsets = C.joined(texts)
        starts, ends = C.split_words(data)
        numbers = self._numbers(data, starts, ends)
        length = self.length[numbers]
        stop = np.cumsum(length)
        at = np.repeat(self.first[numbers] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)
        ids = self.ids[at]
        edge = np.concatenate([[0], stop])[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _tokenizer(path: str) -> WordCoder:
    if path not in _tokenizers:
        _tokenizers[path] = WordCoder(path)
    return _tokenizers[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the document's ids and an end id, cut where they are
    longer than a sequence."""
    def task(batches):
        coder = _tokenizer(tokenizer_path)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for first, texts in C.text_groups(batch.column("text")):
                for i, code in enumerate(coder.encode(texts)):
                    code = np.concatenate([code, end])
                    for k, at in enumerate(range(0, len(code), capacity)):
                        part = code[at:at + capacity]
                        rows.append((ids[first + i], k, at, len(part), zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Packs a histogram of lengths.  Gives (length, first rank, first sequence,
    offset) of every slot of every pattern, the number of bins of each slot's
    pattern, and the number of sequences."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    lengths = np.arange(capacity + 1)
    ranks = np.zeros(capacity + 1, dtype=np.int64)
    slots, times, sequences = [], [], 0
    fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the largest remaining length up to each length
    while fits[capacity]:
        have, bin_, gap = left.copy(), [], capacity
        best = fits.copy()

        def take(x: int) -> None:
            nonlocal best
            have[x] -= 1
            if not have[x]:
                best = np.maximum.accumulate(np.where(have > 0, lengths, 0))

        while gap and best[gap]:
            bin_.append(x := int(best[gap]))
            gap -= x
            take(x)
        if gap and len(bin_) > 1:
            room = gap + bin_[-1]
            first = lengths[1:room][have[1:room] > 0]
            second = best[np.minimum(first, room - first)]
            twice = (second == first) & (have[first] < 2)  # the same length twice needs two pieces
            second = np.where(twice, best[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > bin_[-1]:
                k = int(total.argmax())
                have[bin_.pop()] += 1
                bin_ += [int(first[k]), int(second[k])]
        need = np.bincount(bin_, minlength=capacity + 1)
        used = np.flatnonzero(need)
        n = int((left[used] // need[used]).min())
        offset = 0
        for x in bin_:
            slots.append((x, ranks[x], sequences, offset))
            times.append(n)
            ranks[x] += n
            offset += x
        left[used] -= n * need[used]
        sequences += n
        fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))
    return np.array(slots, dtype=np.int64).reshape(-1, 4), np.array(times, dtype=np.int64), sequences


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    counts = cut.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}  # at most `capacity` rows
    slots, _, _ = plan(histogram, capacity)
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    slots = slots[order]
    keys = (slots[:, 0] << 48) | slots[:, 1]

    chunks = max(1, sum(histogram.values()) // CHUNK_ROWS)
    # the hash keeps the pieces of a document apart and copies of a row together
    d = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).cast("int"))
    before = d.groupBy("length", "chunk").agg(F.count("*").alias("n")).select(
        "length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    numbered = d.withColumn("rank", F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = numbered.join(before, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def task(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(task, f"{PIECES}, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(C.stored(pieces(docs, path or tokenizer_path()), "pieces"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return pack_documents(C.table(spark, sf_dir, "documents"))
