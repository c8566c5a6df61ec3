"""Eigenpairs of a symmetric matrix by contour integration (FEAST).

Intervals that hold a few eigenvalues each are found by inertia counts. For one
interval, Gauss quadrature of complex shifted solves on a circle through its ends
filters a block of vectors to the eigenvectors inside, and Rayleigh-Ritz extracts
them; that is repeated until the residuals are at rounding. Intervals don't depend on
each other, so each can be a task.
"""

from __future__ import annotations

import numpy as np

#: Quadrature points on the upper half of the circle; rounds; eigenvalues aimed at
#: in an interval; a gap between intervals, relative to the largest eigenvalue.
POINTS = 8
ROUNDS = 30
PER_INTERVAL = 8
LEAST_GAP = 1e-9
#: Residual, relative to the largest eigenvalue, at which a pair counts as exact.
RESIDUAL = 1e-13


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix congruent to ``v`` under
    reflections, so of the same eigenvalues."""
    a, n = v.astype(float).copy(), len(v)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0] if x[0] else 1.0)
        length = np.linalg.norm(x)
        if length == 0:
            continue
        x /= length
        part = a[k + 1 :, k + 1 :]
        p = part @ x
        w = 2 * (p - (x @ p) * x)
        a[k + 1 :, k + 1 :] = part - np.outer(w, x) - np.outer(x, w)
        edge = a[k + 1 :, k] - 2 * (x @ a[k + 1 :, k]) * x
        a[k + 1 :, k], a[k, k + 1 :] = edge, edge
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues are greater than each of ``shifts``, by the signs
    of the pivots of the shifted matrix (Sylvester's law)."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - shifts - e * e / pivot
        count += pivot > 0
    return count


def intervals(v: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) of intervals in falling order, which hold at
    least the ``most`` largest eigenvalues above rounding, and end in gaps."""
    diagonal, off = tridiagonal(v)
    radius = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    top = max(abs(low), abs(high))
    if top == 0:
        return []
    high += top * 1e-12
    low -= top * 1e-12
    # Bisection brackets each of the leading eigenvalues, and those after them.
    nth = np.arange(1, min(len(v), most + 1 + PER_INTERVAL) + 1)
    a, b = np.full(len(nth), low), np.full(len(nth), high)
    for _ in range(60):
        mid = (a + b) / 2
        more = above(diagonal, off, mid) >= nth
        a, b = np.where(more, mid, a), np.where(more, b, mid)
    values = (a + b) / 2
    floor = len(v) * np.finfo(float).eps * top * 8
    known = values[values > floor]
    if not len(known):
        return []
    # Ends lie in the middle of gaps; where the wanted ones end among equal values, all
    # of these are taken, however many: then bracketed ones may not do.
    gaps = known[:-1] - known[1:]
    out, start = [], 0
    while start < min(most, len(known)):
        stop = min(start + PER_INTERVAL, len(known))
        inner = [k for k in range(start + 1, stop + 1) if k == len(known) or gaps[k - 1] > LEAST_GAP * top]
        while not inner and stop < len(known):
            stop += 1
            if stop == len(known) or gaps[stop - 1] > LEAST_GAP * top:
                inner = [stop]
        wide = [k for k in inner if k >= min(most, start + PER_INTERVAL // 2)] or inner
        cut = max(wide, key=lambda k: gaps[k - 1] if k < len(known) else 0)
        # The circle goes round the values closely: at most half their width, or half a gap, away.
        largest, least = float(known[start]), float(known[cut - 1])
        below = least - (float(known[cut]) if cut < len(known) else float(max(values[cut], 0.0)) if cut < len(values) else 0.0)
        over = float(known[start - 1]) - largest if start else np.inf
        reach = max(largest - least, min(below, over))
        end = least - min(below, reach) / 2
        count = int(above(diagonal, off, np.array([end]))[0]) - sum(n for _, _, n in out)
        out.append((end, largest + min(over, reach) / 2, count))
        start += count
    return out


def _nodes(low: float, high: float):
    """Quadrature points z on the upper half circle, and weights of the filter."""
    x, w = np.polynomial.legendre.leggauss(POINTS)
    angle = np.pi / 2 * (1 - x)
    turn = np.exp(1j * angle)
    return (low + high) / 2 + (high - low) / 2 * turn, w * (high - low) / 4 * turn


def eigenpairs(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``count`` eigenvalues of ``v`` in (low, high], falling, and their unit
    vectors as rows. An error if the filter does not find as many as inertia says."""
    n, top = len(v), np.abs(v).sum(0).max()
    z, weight = _nodes(low, high)
    # The circle must not touch values beyond its ends; ends lie in gaps.
    width = min(n, max(count + 4, 2 * count))
    for seed in range(3):
        block = np.random.default_rng(seed).standard_normal((n, width))
        for _ in range(ROUNDS):
            filtered = np.zeros((n, block.shape[1]))
            for point, w in zip(z, weight):
                filtered += (w * np.linalg.solve(point * np.eye(n) - v, block.astype(complex))).real
            basis, strength, _ = np.linalg.svd(filtered, full_matrices=False)
            basis = basis[:, strength > strength[0] * 1e-14]
            ritz, turned = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ turned
            inside = np.flatnonzero((ritz > low) & (ritz <= high))
            error = np.linalg.norm(v @ block[:, inside] - block[:, inside] * ritz[inside], axis=0) if len(inside) else np.ones(1)
            if len(inside) == count and error.max() <= RESIDUAL * top * n**0.5:
                best = inside[::-1]
                return ritz[best], (block[:, best] / np.linalg.norm(block[:, best], axis=0)).T
        width = min(n, 2 * width)
    raise ArithmeticError(f"inertia counts {count} eigenvalues in ({low}, {high}], the contour found {len(inside)}")
