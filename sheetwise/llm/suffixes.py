"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's prefixes.

A shard is a list of byte strings one after another.  Every string ends with a
mark of its own that is smaller than any byte, so suffixes never run on into the
next string and no two suffixes are equal.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # bytes of the first sorting key, nine bits each


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``data``; ``ends`` are the ends of its strings."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int32)
    left = _left(n, ends)
    symbol = np.zeros(n + FIRST, dtype=np.uint64)
    symbol[:n] = data
    symbol[:n] += np.uint64(1)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(FIRST):
        key = (key << np.uint64(9)) | np.where(left > k, symbol[k:k + n], np.uint64(0))
    order = np.argsort(key).astype(np.int32)
    # keys with an end mark are ordered by position where they are equal
    marked = np.flatnonzero(left[order] < FIRST)
    order[marked] = order[marked][np.lexsort((order[marked], key[order[marked]]))]
    key = key[order]
    # equal keys that hold an end mark differ in it
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (left[order[1:]] < FIRST)
    del key, symbol
    start = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = start
    # only suffixes in groups of several are refined further
    single = new.copy()
    single[:-1] &= new[1:]
    slots = np.flatnonzero(~single).astype(np.int32)
    h = FIRST
    while len(slots):
        at = order[slots]
        # after an end mark comes nothing: smaller than all, by position
        second = np.where(left[at] <= h, at, rank[np.minimum(at + np.int32(h), n - 1)] + np.int32(n))
        pair = rank[at].astype(np.uint64) * np.uint64(2 * n) + second.astype(np.uint64)
        by, pair = _sorted(pair, 2 * n * n)
        at = at[by]
        order[slots] = at
        new = np.ones(len(slots) + 1, dtype=bool)
        np.not_equal(pair[1:], pair[:-1], out=new[1:-1])
        first = np.flatnonzero(new[:-1])
        size = np.diff(np.append(first, len(slots)))
        rank[at] = np.repeat(slots[first], size)
        slots = slots[~(new[:-1] & new[1:])]
        h *= 2
    return order


def _sorted(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and sorted values (all below ``most``).  Where value and place fit
    into 64 bits they are sorted as one number, which numpy does much faster."""
    bits = max(1, (len(values) - 1).bit_length())
    if int(most).bit_length() + bits <= 64:
        both = (values << np.uint64(bits)) | np.arange(len(values), dtype=np.uint64)
        both.sort()
        return (both & np.uint64((1 << bits) - 1)).astype(np.int32), both >> np.uint64(bits)
    order = np.argsort(values)
    return order, values[order]


def _left(n: int, ends: np.ndarray) -> np.ndarray:
    """Bytes from each position to the end of its string."""
    sizes = np.diff(np.concatenate([[0], ends]))
    return (np.repeat(ends, sizes) - np.arange(n)).astype(np.int32)


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the
    array, by position in the text.  Kasai's argument: from one position to the
    next, prefix plus position never falls, and it only rises where the bytes in
    front of the two suffixes differ.  So lengths are compared there, and carried
    on elsewhere by a running maximum."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    left = _left(n, ends)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    first = np.zeros(n, dtype=bool)
    first[0] = True
    first[ends[:-1]] = True
    fresh = first | (before <= 0)
    i = np.flatnonzero(~fresh)
    j = before[i]
    fresh[i] = first[j] | (data[i - 1] != data[j - 1])
    at = np.flatnonzero(fresh & (before >= 0))
    other = before[at]
    most = np.minimum(left[at], left[other])
    length = np.zeros(len(at), dtype=np.int32)
    word = np.zeros(n, dtype=np.uint64)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = data
    for k in range(8):
        word |= padded[k:k + n] << np.uint64(8 * k)
    go = np.arange(len(at))
    while len(go):
        x, y = at[go] + length[go], other[go] + length[go]
        differ = word[np.minimum(x, n - 1)] ^ word[np.minimum(y, n - 1)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int32)
        length[go] = np.minimum(length[go] + same, most[go])
        go = go[(same == 8) & (length[go] < most[go])]
    reach = np.zeros(n, dtype=np.int64)
    reach[at] = at + length
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def repeated_starts(data: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` bytes from each position also start elsewhere."""
    order = suffix_array(data, ends)
    prefix = common_prefixes(data, ends, order)
    out = prefix >= width  # as the one before it
    following = order[1:]
    out[order[:-1][prefix[following] >= width]] = True
    return out
