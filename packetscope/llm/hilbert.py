"""Hilbert curve keys of points, and a projection of vectors to few dimensions."""

from __future__ import annotations

import numpy as np

DIMS, BITS = 6, 10


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point on the Hilbert curve, as int64.

    ``cells``: one row per point, non-negative whole coordinates below ``2**bits``;
    dimensions times bits must stay below 63. Follows J. Skilling, "Programming the Hilbert
    curve" (2004), over all points at once: from the highest bit down, each dimension either
    flips the lower bits of the first one or swaps them with it; what is left is a Gray code.
    """
    points, dims = cells.shape
    if dims * bits > 62:
        raise ValueError("a key has at most 62 bits")
    x = cells.T.astype(np.int64).copy()
    for high in range(bits - 1, 0, -1):
        below = (1 << high) - 1
        for i in range(dims):
            flips = (x[i] >> high) & 1 == 1
            swapped = np.where(flips, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(flips, x[0] ^ below, x[0] ^ swapped)
            x[i] ^= swapped
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(points, np.int64)
    for high in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> high) & 1 == 1, (1 << high) - 1, 0)
    x ^= turn
    key = np.zeros(points, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def projection(inputs: int, dims: int = DIMS, seed: int = 7) -> np.ndarray:
    """Whole-number random directions, 256 standing for one standard deviation."""
    normal = np.random.default_rng(seed).standard_normal((inputs, dims))
    return np.rint(256 * normal).astype(np.int64)


def cells_of(projected: np.ndarray, squares: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells of projected vectors, scaled by their length (``squares``: its square).

    Only exactly rounded operations, so every machine finds the same cell. A zero vector
    lies in the middle.
    """
    length = 256 * np.sqrt(np.maximum(squares, 1).astype(np.float64))
    at = projected / length[:, None]
    squashed = at / (1 + np.abs(at))
    return np.minimum(((squashed + 1) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
