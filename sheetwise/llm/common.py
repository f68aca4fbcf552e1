"""What the training-data operators share: tables, scratch tables, word hashes.

A *word* is a maximal run of characters other than space and the controls
U+0009..U+000D.  Lower-casing touches A-Z only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.session import ensure_checkpoint_dir, ship_package

WORD_BREAKS = " \t\n\x0b\f\r"


# ---- Spark side -------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make the package importable on the workers and keep Arrow batches of
    long texts small (rows per batch; the texts of a batch sit in memory)."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sample(df: DataFrame, key: str, value: str, n: int) -> list:
    """Values of the n keys with the smallest hash (one per key, the least one
    that is not null).  Only keys are sorted; values are read for those alone."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(n)
    rows = df.select(key, value).join(F.broadcast(keys), key, "left_semi").groupBy(key).agg(F.min(value).alias("v")).where("v is not null")
    return [r.v for r in rows.orderBy(F.xxhash64(key), key).collect()]


FILTER_BITS = 26


def key_filter(keys: DataFrame, key: str):
    """A bit set over a column of longs, broadcast: 8 MB whatever the number of
    keys.  ``maybe`` lets all keys of the set through and few others, so that
    big rows without a partner need not be shuffled; the join behind it is exact."""
    slots = keys.select(F.shiftrightunsigned(F.pmod(key, F.lit(1 << FILTER_BITS)), 6).alias("w"), F.pmod(key, F.lit(64)).cast("int").alias("b"))
    words = slots.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()  # at most 2^20 rows
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & ((1 << FILTER_BITS) - 1)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0


def maybe(shared, key: str) -> Column:
    """False for keys that are not in the filter; a null key passes."""
    import pyarrow as pa
    return F.arrow_udf(lambda k: pa.array(may_hold(shared.value, k.fill_null(0).to_numpy()) | k.is_null().to_numpy(zero_copy_only=False)), "boolean")(F.col(key).cast("long"))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WORD_BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


# ---- task side (numpy) ------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 20)
        _powers, _inverse = _geometric(_BASE, size), _geometric(_BASE_INV, size)
    return _powers, _inverse


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, xor)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte array."""
    gap = np.empty(len(data) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _BREAK[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each word: a polynomial of its (case-folded) bytes, from
    one running sum over the whole array, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_FOLD[data] if fold else data).astype(np.uint64) * power[:len(data)] + power[:len(data)], out=run[1:])
    value = (run[ends] - run[starts]) * inverse[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + hashes[i:i + m] + np.uint64(i + 1))
    return out


def text_groups(column, most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of an Arrow string column, a few MB at a
    time; null is empty.  One longer text makes a group of its own."""
    first, size, group = 0, 0, []
    for i, value in enumerate(column.cast("binary").to_pylist()):
        value = value or b""
        if group and size + len(value) > most:
            yield first, group
            first, size, group = i, 0, []
        group.append(value)
        size += len(value) + 1
    if group:
        yield first, group


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, a line feed after each, and their offsets
    (one more than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return data, offsets
