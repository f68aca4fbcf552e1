"""Spelling variants: which words of a corpus differ by one code point.

A *run* is a maximal run of A-Z, a-z and U+00C0..U+00FF; only A-Z is
lower-cased.  Of a run in a document, h = crc32("<doc_id>:<run>"); where
``DROP`` divides h, the run loses its code point number h % length.  Words are
the distinct results of at least MIN_LENGTH code points that occur at least
MIN_COUNT times overall.

1. Words are counted in the tasks, then by one aggregate.
2. A word is a vector of letter counts.  One replaced code point moves it by a
   squared distance of 2 within one length, an inserted or deleted one by 1 into
   the adjacent length.  The letters fall into CLASSES classes (code point modulo
   CLASSES); the class sums, which add up to the length, name a word's block.  Near
   words lie in one block, in two of one length with one letter moved between
   classes, or in two of adjacent lengths with one letter more in one class.  So a
   block meets a fixed number of others, and every near pair meets exactly once.
3. A block is dealt into tiles of at most about TILE letters.  For each pair of
   tiles that meet, one NumPy product of their letter counts gives all squared
   distances, |a|^2 + |b|^2 - 2 a.b; the pairs at distance 2 (same length) or 1
   (adjacent) are verified letter by letter.  A tile pair returns one row per word
   with a near word: their number and the best of them, so that a word with very
   many near words is summed up before the shuffle.
4. A word's form is its near word of largest count (ties: the least in
   code-point order) if that count is at least RATIO times its own.  Counts grow by
   RATIO along forms, so a chain has at most log_RATIO(largest count) steps, and
   roots come from that many doublings of a table of (word, form).

The tiles' comparisons grow with the square of a block (about a 150th of
the square of the vocabulary at 180,000 words); the vocabulary grows much more slowly than
the text.

Defined results.  Null, empty and letterless texts have no words; texts and runs
of any length are read whole.  A null doc_id counts as the empty string;
repeated rows are documents of their own and their words count again.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DROP = 199
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
CLASSES = 5
TILE = 1 << 15
LEAST_LETTERS = 16  # a word counts as this long at least when tiles are cut
FLUSH = 1 << 18
LONG_TEXT = 1 << 22
KEY = [f"c{i}" for i in range(CLASSES)]

#: of a text in Latin-1, where other characters are "?" and A-Z is lower-cased
_RUN = re.compile(rb"[a-z\xc0-\xff]+")


# ---- counting ---------------------------------------------------------------

def words_of(doc_id: int | None, text: str, drop: int = DROP) -> Iterator[tuple[bytes, int]]:
    """(word in Latin-1, count) of a document, after the deletions."""
    data = text.encode("latin-1", "replace").lower()
    runs = _RUN.findall(data) if len(data) < LONG_TEXT else (m.group() for m in _RUN.finditer(data))
    before = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    for run, n in Counter(runs).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
        if h % drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, n


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int = DROP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): one row per word."""
    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(doc_id, value.as_py() or "", drop):
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) >= FLUSH:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    parts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- blocks and the tiles that meet -----------------------------------------

def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        letters = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sums = np.bincount(of * CLASSES + letters % CLASSES, minlength=len(words) * CLASSES).reshape(-1, CLASSES)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(sums[:, i], pa.int32()) for i in range(CLASSES))], names=[*batch.schema.names, *KEY])


def tiles(words: DataFrame) -> DataFrame:
    """(class sums, tile, words, ns): blocks cut by a hash of the word.  Only
    blocks of more than one tile are looked up, at most one per TILE letters."""
    keyed = C.stored(words.select("word", "n").mapInArrow(_class_sums, "word string, n long, " + ", ".join(f"{k} int" for k in KEY)), "keyed")
    weight = F.greatest(sum(F.col(k) for k in KEY), F.lit(LEAST_LETTERS))
    large = keyed.groupBy(*KEY).agg(F.ceil(F.sum(weight.cast("long")) / TILE).cast("int").alias("parts")).where("parts > 1")
    dealt = keyed.join(C.stored(large, "large"), KEY, "left").withColumn("tile", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), "parts")).cast("int"))
    each = dealt.groupBy(*KEY, "tile").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("r"))
    return C.stored(each.select(*KEY, "tile", F.col("r.word").alias("words"), F.col("r.n").alias("ns")), "tiles")


def _moves() -> list[list[int]]:
    """From a block to those it meets: itself, one letter from class j to a
    class i < j, one letter more in class i."""
    unit = np.eye(CLASSES, dtype=int)
    return [[0] * CLASSES, *[list(map(int, unit[i] - unit[j])) for j in range(CLASSES) for i in range(j)], *[list(map(int, u)) for u in unit]]


def meetings(of: DataFrame) -> DataFrame:
    """Every pair of tiles that can hold near words, once: (a, b, same, longer)
    with the words and counts of both.  Pairs are found on names alone."""
    name = lambda s: [f"{k}{s}" for k in [*KEY, "tile"]]
    a = of.select(*[F.col(k).alias(f"{k}a") for k in [*KEY, "tile"]])
    b = of.select(*[F.col(k).alias(f"{k}b") for k in [*KEY, "tile"]])
    to = a.withColumn("move", F.explode(F.array(*[F.array(*[F.lit(x) for x in m]) for m in _moves()])))
    to = to.select(*name("a"), F.aggregate("move", F.lit(0), lambda s, x: s + x).alias("longer"), F.forall("move", lambda x: x == 0).alias("own"),
                   *[(F.col(f"{k}a") + F.col("move")[i]).alias(f"{k}b") for i, k in enumerate(KEY)])
    pairs = C.stored(to.join(b, [f"{k}b" for k in KEY]).where("NOT own OR tilea <= tileb").select(
        *name("a"), *name("b"), F.col("longer").cast("boolean").alias("longer"), F.expr("own AND tilea = tileb").alias("same")), "meetings")
    full = lambda s: of.select(*[F.col(k).alias(f"{k}{s}") for k in [*KEY, "tile"]], F.col("words").alias(f"words_{s}"), F.col("ns").alias(f"ns_{s}"))
    return pairs.join(full("a"), name("a")).join(full("b"), name("b")).select("longer", "same", "words_a", "ns_a", "words_b", "ns_b")


# ---- comparison of two tiles ------------------------------------------------

def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two letter matrices whose letter counts have squared
    distance 2 (same length) or 1 (b longer by one)."""
    kinds = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    column = np.zeros(256, dtype=np.int64)
    column[kinds] = np.arange(len(kinds))

    def counts(m: np.ndarray) -> np.ndarray:
        flat = np.arange(len(m))[:, None] * len(kinds) + column[m]
        exact = np.float32 if m.shape[1] < 4000 else np.float64  # squares below 2^24
        return np.bincount(flat.ravel(), minlength=len(m) * len(kinds)).reshape(len(m), -1).astype(exact)

    x, y = counts(a), counts(b)
    distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.nonzero(distance == (2 if a.shape[1] == b.shape[1] else 1))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows paired off: True where b is a with one letter replaced (same
    length) or inserted (b longer by one)."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    left, right = a != b[:, :n], a != b[:, 1:]
    equal_left = np.where(left.any(axis=1), left.argmax(axis=1), n)
    equal_right = np.where(right.any(axis=1), right[:, ::-1].argmax(axis=1), n)
    return equal_left + equal_right >= n


def near_words(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with b[j] near a[i]; b has the length of a or one more."""
    x, y = _letters(a), _letters(b)
    i, j = close_pairs(x, y)
    step = max(1, (1 << 22) // y.shape[1])
    good = [one_edit(x[i[k:k + step]], y[j[k:k + step]]) for k in range(0, len(i), step)]
    good = np.concatenate(good) if good else np.zeros(0, dtype=bool)
    return i[good], j[good]


def _best(of: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word with near words: itself, their number, the best of them (words of
    a tile are in code-point order)."""
    order = np.lexsort((other, -n[other], of))
    of, other = of[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, dtype=np.int64)
    return of[first], np.diff(np.append(first, len(of))), other[first]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]

        def add(words, of, times, others, best, ns, out=out):
            out[0] += [words[k] for k in of]
            out[1] += times.tolist()
            out[2] += [others[k] for k in best]
            out[3] += ns[best].tolist()

        same = batch.column("same").to_pylist()
        for r in range(batch.num_rows):
            a, b = (batch.column(f"words_{s}")[r].as_py() for s in "ab")
            ns_a, ns_b = (batch.column(f"ns_{s}")[r].values.to_numpy() for s in "ab")
            i, j = near_words(a, b)
            of, times, best = _best(i, j, ns_b)
            add(a, of, times, b, best, ns_b)
            if not same[r]:
                of, times, best = _best(j, i, ns_a)
                add(b, of, times, a, best, ns_a)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())],
                                         names=["word", "near", "best", "best_n"])


# ---- forms and roots --------------------------------------------------------

def with_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n)."""
    found = meetings(tiles(words)).mapInArrow(_compare, "word string, near long, best string, best_n long")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("form"))).alias("b"))
    taken = F.col("b.m") <= -ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("b.form")).alias("form"), F.when(taken, -F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame, ratio: int = RATIO, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, root) of the words that have a form, by doubling."""
    links = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("n")).first()[0] or 0
    steps, reach = 0, min_count
    while reach * ratio <= most:
        steps, reach = steps + 1, reach * ratio
    jumps = 1
    while jumps < steps:
        links = C.stored(links, "roots")
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        jumps *= 2
    return links


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = C.stored(count_words(docs), "words")
    forms = C.stored(with_forms(words), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return variants(C.table(spark, sf_dir, "documents"))
