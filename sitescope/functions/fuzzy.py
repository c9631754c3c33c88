"""Fuzzy string scores (C22): token sorting as a column, Indel distances of candidate pairs in arrays.

Only pairs that survived the inverted index of ``operators.names`` reach the
distance function; there a count of common characters bounds the common
subsequence before it is computed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Longest first string whose subsequences fit the bits of one machine word.
WORD_BITS = 62
#: Characters are counted in this many classes for the bound.
CLASSES = 64


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_sort_key(c) -> Column:
    """Words split on whitespace, sorted, joined by one space (case kept)."""
    s = F.trim(F.regexp_replace(_c(c).cast('string'), r'(?U)\s+', ' '))
    return F.when(s == '', F.lit('')).otherwise(F.array_join(F.array_sort(F.split(s, ' ')), ' '))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, one word per row)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count('1')


def indel_ratio(a: str, b: str) -> float:
    """Normalised Indel similarity, 0..100: 200 * LCS / (len a + len b)."""
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    return 200.0 * lcs_length(a, b) / total


def _letters(strings: Sequence[str], lengths: np.ndarray) -> np.ndarray:
    """[row, place]: code points, 0 beyond a string's end."""
    width = max(int(lengths.max(initial=0)), 1)
    return np.array(strings, dtype=f'U{width}').view(np.uint32).reshape(len(strings), width)


def _class_counts(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    row, place = np.nonzero(np.arange(letters.shape[1]) < lengths[:, None])
    cell = row * CLASSES + letters[row, place] % CLASSES
    return np.bincount(cell, minlength=len(lengths) * CLASSES).reshape(len(lengths), CLASSES)


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """:func:`lcs_length` of many pairs, all rows a step; strings ``a`` of at most WORD_BITS characters."""
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    left, right = _letters(a, n_a), _letters(b, n_b)
    inside = np.arange(left.shape[1]) < n_a[:, None]
    bits = np.uint64(1) << np.arange(left.shape[1], dtype=np.uint64)
    full = (np.uint64(1) << n_a.astype(np.uint64)) - np.uint64(1)
    v = full.copy()
    for j in range(int(n_b.max(initial=0))):
        same = ((left == right[:, j, None]) & inside & (j < n_b)[:, None]) @ bits
        u = v & same
        v = np.where(j < n_b, ((v + u) | (v - u)) & full, v)
    return n_a - np.bitwise_count(v).astype(np.int64)


def distances_within(a: Sequence[str], b: Sequence[str], limit: np.ndarray) -> np.ndarray:
    """Indel distances of pairs, -1 where a pair's is over its limit."""
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out = np.full(len(n_a), -1, np.int64)
    short = (n_a <= WORD_BITS) & (n_b <= WORD_BITS)
    pick = np.flatnonzero(short)
    if len(pick):
        some_a, some_b = [a[i] for i in pick], [b[i] for i in pick]
        counts = (_class_counts(_letters(s, n[pick]), n[pick]) for s, n in ((some_a, n_a), (some_b, n_b)))
        common = np.minimum(*counts).sum(axis=1)
        pick = pick[n_a[pick] + n_b[pick] - 2 * common <= limit[pick]]
    if len(pick):
        out[pick] = n_a[pick] + n_b[pick] - 2 * lcs_lengths([a[i] for i in pick], [b[i] for i in pick])
    for i in np.flatnonzero(~short):
        out[i] = n_a[i] + n_b[i] - 2 * lcs_length(a[i], b[i])
    out[out > limit] = -1
    return out


@F.pandas_udf(IntegerType())
def indel_within(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    """Indel distance of two strings; null if it is over the limit."""
    found = distances_within(a.tolist(), b.tolist(), limit.to_numpy(np.int64))
    return pd.Series(found).where(found >= 0).astype('Int32')
