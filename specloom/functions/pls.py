"""Partial least squares from cross-product matrices alone.

With Sxx and Sxy of the centred data, each component needs one singular vector of the
deflated Sxy; X itself is never touched, so the rows can stay distributed.
"""

from __future__ import annotations

import numpy as np


def pls_path(gram: np.ndarray, p: int, grid: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Coefficients for every component count in ``grid``, from one augmented Gram matrix.

    ``gram`` is Z'Z for rows Z = [x (p), y (k), 1].  Returns {n: (B (p, k), intercept (k))};
    counts beyond the numerical rank are left out.
    """
    k = gram.shape[0] - p - 1
    n_rows = gram[-1, -1]
    if n_rows <= 0:
        return {}
    mean = gram[-1, :-1] / n_rows
    centred = gram[:-1, :-1] - n_rows * np.outer(mean, mean)
    sxx, sxy = centred[:p, :p], centred[:p, p:]
    left = sxy.copy()
    scale = max(float(np.trace(sxx)), 1e-300)
    rot, load, q_all, out = np.zeros((p, 0)), np.zeros((p, 0)), np.zeros((k, 0)), {}
    for a in range(1, max(grid) + 1):
        if not np.isfinite(left).all() or np.abs(left).max() <= 1e-12 * scale:
            break
        w = left[:, 0] / np.linalg.norm(left) if k == 1 else np.linalg.svd(left, full_matrices=False)[0][:, 0]
        r = w - rot @ (load.T @ w)
        energy = float(r @ sxx @ r)
        if energy <= 1e-12 * scale:
            break
        pl, q = sxx @ r / energy, sxy.T @ r / energy
        rot, load, q_all = np.column_stack([rot, r]), np.column_stack([load, pl]), np.column_stack([q_all, q])
        left = left - energy * np.outer(pl, q)
        if a in grid:
            b = rot @ q_all.T
            out[a] = (b, mean[p:] - mean[:p] @ b)
    return out
