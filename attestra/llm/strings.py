"""Similarities of many pairs of strings at once, on padded code-point matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .forms import code_points

CELLS = 1 << 22  # cells of a matrix handled at once


def matrix(array: pa.Array, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of code points padded with 0, and their lengths."""
    points, bounds = code_points(array)
    size = np.diff(bounds)
    out = np.zeros((len(size), max(int(size.max(initial=0)), least, 1)), dtype=np.int32)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(points)) - bounds[:-1][row]] = points
    return out, size


def letters(codes: np.ndarray) -> np.ndarray:
    """The set of characters of each row as 64 bits."""
    bit = np.uint64(1) << (codes & 63).astype(np.uint64)
    return np.bitwise_or.reduce(np.where(codes > 0, bit, np.uint64(0)), axis=1)


def _chunks(n: int, width: int):
    step = max(1, CELLS // max(1, width))
    for lo in range(0, n, step):
        yield slice(lo, min(n, lo + step))


def edits(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Insertions, deletions, substitutions and swaps of neighbours between the rows of two matrices."""
    out = np.zeros(len(a), dtype=np.int64)
    for part in _chunks(len(a), b.shape[1] + 1):
        x, y, n, m = a[part], b[part], a_size[part], b_size[part]
        width = y.shape[1]
        older, old = None, np.broadcast_to(np.arange(width + 1), (len(x), width + 1)).copy()
        rows = np.arange(len(x))
        done = np.where(n == 0, m, 0)
        for i in range(1, int(n.max(initial=0)) + 1):
            row = np.empty_like(old)
            row[:, 0] = i
            same = x[:, i - 1 : i] == y
            swap = None
            if older is not None:
                swap = np.zeros_like(same)
                swap[:, 1:] = (x[:, i - 1 : i] == y[:, :-1]) & (x[:, i - 2 : i - 1] == y[:, 1:])
            for j in range(1, width + 1):
                v = np.minimum(np.minimum(old[:, j], row[:, j - 1]) + 1, old[:, j - 1] + ~same[:, j - 1])
                if swap is not None and j > 1:
                    v = np.where(swap[:, j - 1], np.minimum(v, older[:, j - 2] + 1), v)
                row[:, j] = v
            older, old = old, row
            done = np.where(n == i, row[rows, m], done)
        out[part] = done
    return out


def jaro_winkler(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Jaro-Winkler similarity with a prefix of up to 4 and weight 0.1; 0 where nothing matches, 1 for equal strings."""
    out = np.zeros(len(a))
    for part in _chunks(len(a), max(a.shape[1], b.shape[1])):
        x, y, n, m = a[part], b[part], a_size[part], b_size[part]
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
        hit, taken = np.zeros(x.shape, dtype=bool), np.zeros(y.shape, dtype=bool)
        for i in range(x.shape[1]):
            for j in range(y.shape[1]):
                ok = (x[:, i] == y[:, j]) & (x[:, i] > 0) & ~taken[:, j] & ~hit[:, i] & (np.abs(i - j) <= reach)
                hit[:, i] |= ok
                taken[:, j] |= ok
        count = hit.sum(axis=1)
        # the matched characters of both, in order, side by side
        k = np.maximum.accumulate(np.cumsum(hit, axis=1), axis=1) - 1
        l = np.cumsum(taken, axis=1) - 1  # noqa: E741
        width = max(1, int(count.max(initial=0)))
        p, q = np.zeros((len(x), width), dtype=np.int32), np.zeros((len(x), width), dtype=np.int32)
        r, c = np.nonzero(hit)
        p[r, k[r, c]] = x[r, c]
        r, c = np.nonzero(taken)
        q[r, l[r, c]] = y[r, c]
        swapped = (p != q).sum(axis=1) / 2
        some = np.maximum(count, 1)
        jaro = (count / np.maximum(n, 1) + count / np.maximum(m, 1) + (count - swapped) / some) / 3
        w = min(4, x.shape[1], y.shape[1])
        prefix = np.cumprod((x[:, :w] == y[:, :w]) & (x[:, :w] > 0), axis=1).sum(axis=1)
        out[part] = np.where(count > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)
    return out
