"""Hilbert curve index of quantised points, vectorised over rows (Skilling, 2004)."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``cells`` (n x d unsigned, each below 2**bits); d * bits <= 63."""
    n, d = cells.shape
    if d * bits > 63:
        raise ValueError("d * bits must be at most 63")
    x = cells.astype(np.uint64).T.copy()
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        p = q - np.uint64(1)
        for i in range(d):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= np.uint64(1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(n, dtype=np.uint64)
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    out = np.zeros(n, dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)
