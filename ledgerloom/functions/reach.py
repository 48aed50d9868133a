"""Which pairs of texts reach a similarity, decided for whole Arrow batches at once.

The same windows as ``narration.partial_ratio`` with the same bit-parallel common subsequence, but each step works on a
column of pairs instead of one pair. It only sorts out pairs below the floor; the score of the others is the expression's.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# executors need numpy and pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BITS = 61  # needle positions that fit one word
_LONGEST = 512  # longer texts are left to the expression, so that a batch stays small
_PLANE = 0xFFFF  # as are characters beyond the basic plane


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Characters as numbers, one row for each place and one column for each text."""
    wide = np.array(texts, dtype=f"U{max(width, 1)}")
    return np.ascontiguousarray(wide.view(np.uint32).reshape(len(texts), max(width, 1)).T)


def _masks(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """For each place of the longer texts, the needle positions that hold its character as bits."""
    ones = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    out = []
    for at in y:
        mask = np.zeros(len(n), np.uint64)
        for i, letter in enumerate(x):
            mask |= (letter == at).astype(np.uint64) << np.uint64(i)
        out.append(mask & ones)
    return out


def _common(state: np.ndarray, ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    return n - np.bitwise_count(state & ones)


def _windows_reach(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, masks: list[np.ndarray], floor: int) -> np.ndarray:
    """Whether a prefix, full window or suffix of the longer text reaches the floor."""
    ones = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    found = np.zeros(len(n), bool)
    for start in range(len(masks)):
        size = np.minimum(n, m - start)
        state = ones.copy()
        for step in range(min(len(x), len(masks) - start)):
            mask = masks[start + step]
            state = (state + (state & mask)) | (state & ~mask)
            ends = (size == step + 1) if start else (step + 1 <= size)
            if ends.any():
                found |= ends & (_common(state, ones, n) * 200 >= floor * (n + step + 1))
    return found


def reaches(left: list[str], right: list[str], floor: int) -> np.ndarray:
    """For each pair, whether its similarity is at least ``floor`` (above 0). True where that is left to the expression."""
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
    n = np.array([len(a) for a, _ in pairs], np.int64)
    m = np.array([len(b) for _, b in pairs], np.int64)
    out = (n > _BITS) | (m > _LONGEST)
    out |= (n == 0) & (m == 0)
    todo = np.flatnonzero(~out & (n > 0))
    if not len(todo):
        return out
    x = _codes([pairs[i][0] for i in todo], int(n[todo].max()))
    y = _codes([pairs[i][1] for i in todo], int(m[todo].max()))
    beyond = (x > _PLANE).any(0) | (y > _PLANE).any(0)
    out[todo[beyond]] = True
    n, m = n[todo], m[todo]
    masks = _masks(x, n, y)
    # the whole longer text holds every window
    ones = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    state = ones.copy()
    for mask in masks:
        state = (state + (state & mask)) | (state & ~mask)
    least = np.maximum(1, -(-n * floor // (200 - floor)))
    near = np.flatnonzero((_common(state, ones, n) * 200 >= floor * (n + least)) & ~beyond)
    if len(near):
        x, y, n, m = x[:, near], y[:, near], n[near], m[near]
        hit = _windows_reach(x, n, y, m, [k[near] for k in masks], floor)
        same = np.flatnonzero((n == m) & ~hit)  # aligned the other way round too
        if len(same):
            a, b, k = x[:, same], y[: len(x), same], n[same]
            hit[same] = _windows_reach(b, k, a, k, _masks(b, k, a), floor)
        out[todo[near[hit]]] = True
    return out


def may_reach(left: str, right: str, floor: int) -> Column:
    """``reaches`` over two text columns; null counts as empty."""

    @F.arrow_udf("boolean")
    def reached(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(reaches(a.to_pylist(), b.to_pylist(), floor))

    return reached(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))
