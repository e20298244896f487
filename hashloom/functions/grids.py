"""Whole-number arithmetic on batches of grayscale grids, the same bit for bit in any engine.

A batch is an int64 array (images, rows, columns) of values 0 to 255. Resampling and blur are
separable: a table of weights for each axis, in 1/65536, vertical before horizontal, each pass
rounded by adding half and shifting.
"""

from __future__ import annotations

import math

import numpy as np

ONE = 1 << 16


def _whole(weights: list[list[float]]) -> np.ndarray:
    """Rows of weights as whole numbers that sum to ONE; what rounding leaves goes to the largest."""
    rows = []
    for row in weights:
        total = sum(row)
        scaled = [math.floor(x / total * ONE + 0.5) for x in row]
        scaled[scaled.index(max(scaled))] += ONE - sum(scaled)
        rows.append(scaled)
    return np.array(rows, dtype=np.int64)


def resize_table(n: int, to: int) -> np.ndarray:
    """(to, n) weights: triangle filter, widened when shrinking; the same size is kept as it is."""
    if n == to:
        return np.eye(n, dtype=np.int64) * ONE
    scale = n / to
    reach = max(1.0, scale)
    rows = []
    for i in range(to):
        centre = (i + 0.5) * scale - 0.5
        row = [0.0] * n
        for j in range(math.floor(centre - reach), math.ceil(centre + reach) + 1):
            weight = 1 - abs(j - centre) / reach
            if weight > 0:
                row[min(max(j, 0), n - 1)] += weight
        rows.append(row)
    return _whole(rows)


def blur_table(n: int, sigma: float) -> np.ndarray:
    """(n, n) weights of a Gaussian of radius ceil(3 sigma), edge values repeated outwards."""
    radius = math.ceil(3 * sigma)
    rows = []
    for i in range(n):
        row = [0.0] * n
        for d in range(-radius, radius + 1):
            row[min(max(i + d, 0), n - 1)] += math.exp(-d * d / (2 * sigma * sigma))
        rows.append(row)
    return _whole(rows)


def separable(px: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    half = ONE // 2
    px = (np.einsum("oi,niw->now", down, px) + half) >> 16
    return (np.einsum("oi,nhi->nho", across, px) + half) >> 16


def resize(px: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if px.shape[1:] == (rows, columns):
        return px
    return separable(px, resize_table(px.shape[1], rows), resize_table(px.shape[2], columns))


def blur(px: np.ndarray, sigma: float) -> np.ndarray:
    return separable(px, blur_table(px.shape[1], sigma), blur_table(px.shape[2], sigma))


def rotate(px: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by a multiple of 90."""
    return np.rot90(px, -degrees // 90, axes=(1, 2))


def average_bits(px: np.ndarray, size: int) -> np.ndarray:
    """(images, size * size): whether a value is at least the mean, without dividing."""
    px = resize(px, size, size).reshape(len(px), -1)
    return px * px.shape[1] >= px.sum(axis=1, keepdims=True)


def vert_gradient_bits(px: np.ndarray, size: int) -> np.ndarray:
    px = resize(px, size + 1, size)
    return (px[:, :-1] < px[:, 1:]).reshape(len(px), -1)


def gradient_bits(px: np.ndarray, size: int) -> np.ndarray:
    px = resize(px, size, size + 1)
    return (px[:, :, :-1] < px[:, :, 1:]).reshape(len(px), -1)


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits to bytes, most significant first."""
    return np.packbits(bits, axis=1)


def to_words(data: np.ndarray) -> np.ndarray:
    """Bytes to signed 64-bit words, most significant first; short ends are followed by zeros."""
    short = -data.shape[1] % 8
    data = np.pad(data, ((0, 0), (0, short))) if short else data
    return np.ascontiguousarray(data).view(">i8").astype(np.int64)
