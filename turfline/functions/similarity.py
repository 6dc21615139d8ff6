"""Jaro-Winkler on Arrow batches.

Spark has no Jaro built-in.  The score of a whole batch of pairs is computed with array operations
over character matrices, so no Python code runs per row.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline import fixed

# Workers get these functions by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of one string matrix at most (or one row).
_CELLS = 400_000
_FLOOR, _PREFIX, _SCALE = fixed.WINKLER_FLOOR, fixed.WINKLER_PREFIX, fixed.WINKLER_SCALE


def _characters(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points as an (n, width) matrix, zero padded, and the lengths."""
    array = values.to_numpy(dtype="U")
    width = max(array.dtype.itemsize // 4, 1)
    return array.view(np.uint32).reshape(len(array), width), np.char.str_len(array)


def _in_order(chars: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The taken characters of each row, moved to the left."""
    out = np.zeros_like(chars)
    rows, cols = np.nonzero(taken)
    rank = np.cumsum(taken, axis=1)[rows, cols] - 1
    out[rows, rank] = chars[rows, cols]
    return out


def jaro_winkler_batch(left: pd.Series, right: pd.Series) -> np.ndarray:
    a, la = _characters(left)
    b, lb = _characters(right)
    n = len(a)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    columns = np.arange(b.shape[1])
    inside = columns[None, :] < lb[:, None]
    used_a = np.zeros(a.shape, dtype=bool)
    used_b = np.zeros(b.shape, dtype=bool)
    every = np.arange(n)
    for i in range(a.shape[1]):
        near = np.abs(columns[None, :] - i) <= reach[:, None]
        free = (b == a[:, i : i + 1]) & near & inside & ~used_b & (i < la)[:, None]
        hit = free.any(axis=1)
        used_b[every[hit], free.argmax(axis=1)[hit]] = True
        used_a[:, i] = hit
    matches = used_a.sum(axis=1)
    seq_a, seq_b = _in_order(a, used_a), _in_order(b, used_b)
    width = min(a.shape[1], b.shape[1])
    half_swaps = (seq_a[:, :width] != seq_b[:, :width]).sum(axis=1) / 2
    m = np.maximum(matches, 1)
    jaro = (matches / np.maximum(la, 1) + matches / np.maximum(lb, 1) + (m - half_swaps) / m) / 3
    jaro = np.where(matches == 0, 0.0, jaro)
    k = min(_PREFIX, width)
    same = (a[:, :k] == b[:, :k]) & (a[:, :k] != 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    boosted = jaro + prefix * _SCALE * (1 - jaro)
    score = np.where(jaro < _FLOOR, jaro, boosted)
    return np.where((la == lb) & (left.to_numpy() == right.to_numpy()), 1.0, score)


def by_length(left: pd.Series, right: pd.Series, cells: int = _CELLS) -> np.ndarray:
    """The same scores, computed over slices of similar lengths, so that one long string does not widen every row."""
    longest = np.maximum(left.str.len().to_numpy(), right.str.len().to_numpy())
    order = np.argsort(longest, kind="stable")
    out = np.zeros(len(left))
    stop = len(order)
    while stop:
        rows = max(1, cells // max(1, int(longest[order[stop - 1]])))
        own = order[max(0, stop - rows):stop]
        out[own] = jaro_winkler_batch(left.iloc[own], right.iloc[own])
        stop -= len(own)
    return out


@F.pandas_udf(T.DoubleType())
def _jaro_winkler_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    out = np.zeros(len(left))
    todo = (left.notna() & right.notna()).to_numpy()
    if todo.any():
        pairs = pd.DataFrame({"a": left[todo], "b": right[todo]})
        number = pairs.groupby(["a", "b"], sort=False).ngroup().to_numpy()
        own = pairs[~pairs.duplicated()]  # every different pair of the batch once, in the order of its number
        out[todo] = by_length(own["a"], own["b"])[number]
    return pd.Series(out)


def jaro_winkler(left, right) -> Column:
    """Similarity of two columns; equal values reach the Arrow function as nulls, which it does not compare."""
    left = F.col(left) if isinstance(left, str) else left
    right = F.col(right) if isinstance(right, str) else right
    differs = F.when(left != right, left)
    return F.when(left == right, F.lit(1.0)).otherwise(_jaro_winkler_udf(differs, right))
