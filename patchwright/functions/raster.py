"""Rasters as row-major arrays: upsampling, box filters, gradients and their summaries.

All work is on DOUBLE arrays inside one row, so it is map side only. Edges reflect (d c b a | a b c d | d c b a).
The column forms are for a filter or two inside a plan; the array forms (of patches x n x n) for whole patches in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, though the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def nearest_index(n: int, size: int) -> list[int]:
    """Source index of each target index when n cells are stretched over size, corners aligned."""
    return [i if n == size else math.floor(i * (n - 1) / (size - 1) + 0.5) for i in range(size)]


def upsample_weights(n: int, size: int) -> list[int]:
    """How often each source index is used: enough for statistics without building the large raster."""
    index = nearest_index(n, size)
    return [index.count(k) for k in range(n)]


def upsample(a: Column, n: int, size: int) -> Column:
    """An n x n raster stretched to size x size by its nearest cells."""
    if n == size:
        return a
    index = nearest_index(n, size)
    at = F.array(*(F.lit(i) for i in index))
    return bind(a, lambda x: F.flatten(F.transform(at, lambda r: F.transform(at, lambda c: F.get(x, r * n + c)))))


def _reflect(i: Column, n: int) -> Column:
    return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)


def _stencil(a: Column, n: int, weights: dict[tuple[int, int], float]) -> Column:
    """Weighted sum of the cells around each cell; weights by (row, column) offset."""
    def cell(x: Column, i: Column) -> Column:
        row, col = F.floor(i / n).cast("int"), i % n
        total = F.lit(0.0)
        for (dr, dc), w in weights.items():
            total = total + w * F.get(x, _reflect(row + dr, n) * n + _reflect(col + dc, n))
        return total

    return bind(a.cast("array<double>"), lambda x: F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: cell(x, i)))


def _pass(a: Column, n: int, k: int, across: bool) -> Column:
    offsets = range(-(k // 2), k // 2 + 1)
    return _stencil(a, n, {((0, d) if across else (d, 0)): 1.0 / k for d in offsets})


def box_mean(a: Column, n: int, k: int) -> Column:
    """k x k mean, as one pass along rows and one along columns."""
    return _pass(_pass(a, n, k, True), n, k, False)


def local_variance(a: Column, n: int, k: int) -> Column:
    """max(0, mean of squares - square of mean) over k x k."""
    square = F.transform(a.cast("array<double>"), lambda x: x * x)
    return F.zip_with(box_mean(square, n, k), box_mean(a, n, k), lambda s, m: F.greatest(s - m * m, F.lit(0.0)))


def sobel(a: Column, n: int) -> Column:
    """Gradient magnitude with [1 2 1] smoothing, not normalised."""
    smooth = {-1: 1.0, 0: 2.0, 1: 1.0}
    down = {(d, c): d * w for d in (-1, 1) for c, w in smooth.items()}
    right = {(r, d): d * w for d in (-1, 1) for r, w in smooth.items()}
    return F.zip_with(_stencil(a, n, down), _stencil(a, n, right), lambda x, y: F.hypot(x, y))


def _edged(grid: np.ndarray, k: int) -> np.ndarray:
    return np.pad(grid, ((0, 0), (k, k), (k, k)), mode="symmetric")


def mean_of(grid: np.ndarray, k: int) -> np.ndarray:
    """box_mean of patches x n x n, by running sums."""
    n, m = grid.shape[1:]
    sums = np.zeros((len(grid), n + k, m + k))
    sums[:, 1:, 1:] = _edged(grid, k // 2).cumsum(axis=1).cumsum(axis=2)
    return (sums[:, k:, k:] - sums[:, :-k, k:] - sums[:, k:, :-k] + sums[:, :-k, :-k]) / (k * k)


def variance_of(grid: np.ndarray, k: int) -> np.ndarray:
    """local_variance of patches x n x n."""
    mean = mean_of(grid, k)
    return np.maximum(mean_of(grid * grid, k) - mean * mean, 0)


def sobel_of(grid: np.ndarray) -> np.ndarray:
    """sobel of patches x n x n."""
    e = _edged(grid, 1)
    across = e[:, :, 2:] - e[:, :, :-2]
    down = e[:, 2:] - e[:, :-2]
    gx = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]
    gy = down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]
    return np.hypot(gx, gy)


def array_percentile(a: Column, p: float) -> Column:
    """Percentile of an array by linear interpolation."""
    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(p)
        low = F.floor(place).cast("int")
        return F.get(s, low) + (F.get(s, F.least(low + 1, F.size(s) - 1)) - F.get(s, low)) * (place - low)

    return bind(F.sort_array(a), at)


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_std(a: Column) -> Column:
    """Population standard deviation of an array."""
    return bind(a, lambda v: bind(array_mean(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v))))
