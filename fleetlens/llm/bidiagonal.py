"""Eigenvectors of R'R from a triangular R without forming the product:
Householder bidiagonalisation, dqds for the singular values, and twisted
factorisations for the vectors.

All matrices here have the vectors' dimension as their size, whatever the table's.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than this, relatively, are first told apart by a shift.
_GAP = 1e-3
_DEPTH = 8


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): R = U B V' with B's diagonal a and superdiagonal b, by
    Householder reflections from the left and from the right."""
    m = np.array(r, float)
    n = len(m)
    v = np.eye(n)
    for k in range(n):
        w, beta = _reflector(m[k:, k])
        m[k:, k:] -= beta * np.outer(w, w @ m[k:, k:])
        if k < n - 2:
            w, beta = _reflector(m[k, k + 1:])
            m[k:, k + 1:] -= beta * np.outer(m[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= beta * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """w and beta so that (I - beta w w') x is a multiple of the first unit vector."""
    w = x.copy()
    norm = np.linalg.norm(x)
    if norm == 0 or not np.any(x[1:]):
        return w, 0.0
    w[0] += np.copysign(norm, x[0])
    return w, 2.0 / (w @ w)


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Eigenvalues of B'B, largest first, to high relative accuracy."""
    found: list[float] = []
    top = max(np.max(np.square(a), initial=0.0), np.max(np.square(b), initial=0.0))
    if top == 0:
        return np.zeros(len(a))
    work = [(np.maximum(np.square(a) / top, 1e-280).tolist(), (np.square(b) / top).tolist(), 0.0)]
    while work:
        q, e, sigma = work.pop()
        least = min(q)
        while q:
            m = len(q)
            if m == 1:
                found.append(sigma + q[0])
                break
            cut = next((i for i in range(m - 2, -1, -1) if e[i] <= EPS * EPS * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                least = min(q)
                continue
            if q[0] < q[-1]:
                q.reverse()
                e.reverse()
            shift, tries = 0.98 * least, 0
            step = _transform(q, e, shift)
            while step is None:  # the shift was beyond the smallest eigenvalue
                tries += 1
                shift = 0.0 if tries > 8 else shift / 4
                step = _transform(q, e, shift)
            q, e, least = step
            sigma += shift
    return np.sort(np.array(found))[::-1] * top


def _transform(q: list[float], e: list[float], shift: float):
    """One differential qd step: (q, e, smallest d), or None if an eigenvalue would be negative."""
    d = q[0] - shift
    if d < 0:
        return None
    new_q, new_e, least = [], [], d
    for i in range(len(e)):
        s = d + e[i]
        if s == 0:
            return None
        new_q.append(s)
        t = q[i + 1] / s
        new_e.append(e[i] * t)
        d = d * t - shift
        if d < 0:
            return None
        least = min(least, d)
    new_q.append(d)
    return new_q, new_e, least


def _safe(x: float) -> float:
    return x if x != 0 else EPS * EPS


def _stationary(d: np.ndarray, lo: np.ndarray, x: float):
    """L+ D+ L+' = L D L' - x: (D+, L+, s)."""
    n = len(d)
    plus, low, s = np.empty(n), np.empty(n - 1), np.empty(n)
    s[0] = -x
    for i in range(n - 1):
        plus[i] = _safe(d[i] + s[i])
        low[i] = d[i] * lo[i] / plus[i]
        s[i + 1] = low[i] * lo[i] * s[i] - x
    plus[-1] = d[-1] + s[-1]
    return plus, low, s


def _progressive(d: np.ndarray, lo: np.ndarray, x: float):
    """U- D- U-' = L D L' - x: (U-, p)."""
    n = len(d)
    up, p = np.empty(n - 1), np.empty(n)
    p[-1] = d[-1] - x
    for i in range(n - 2, -1, -1):
        minus = _safe(d[i] * lo[i] * lo[i] + p[i + 1])
        t = d[i] / minus
        up[i] = lo[i] * t
        p[i] = p[i + 1] * t - x
    return up, p


def _below(d: np.ndarray, lo: np.ndarray, x: float) -> int:
    """How many eigenvalues of L D L' are smaller than x."""
    return int((_stationary(d, lo, x)[0] < 0).sum())


def _bisected(d: np.ndarray, lo: np.ndarray, number: int, near: float, width: float) -> float:
    """Eigenvalue ``number`` (0 the smallest) to full relative accuracy, from a guess."""
    low, high = near - width, near + width
    while _below(d, lo, low) > number:
        low -= width
        width *= 2
    while _below(d, lo, high) <= number:
        high += width
        width *= 2
    while high - low > 2 * EPS * max(abs(low), abs(high)):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if _below(d, lo, mid) > number:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def _twisted(d: np.ndarray, lo: np.ndarray, x: float) -> np.ndarray:
    """The eigenvector for x: twist at the smallest gamma, multiply outward."""
    _, low, s = _stationary(d, lo, x)
    up, p = _progressive(d, lo, x)
    k = int(np.argmin(np.abs(s + p + x)))
    z = np.zeros(len(d))
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(k + 1, len(d)):
        z[i] = -up[i - 1] * z[i - 1]
    return z / np.linalg.norm(z)


def _vectors(d: np.ndarray, lo: np.ndarray, values: np.ndarray, first: int, depth: int) -> np.ndarray:
    """Columns for eigenvalues first, first + 1, ... (smallest first) of L D L'.
    Values that are close are told apart in a representation shifted next to them."""
    out, i = np.empty((len(d), len(values))), 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and values[j + 1] - values[j] <= _GAP * max(abs(values[j]), abs(values[j + 1])):
            j += 1
        if i == j:
            out[:, i] = _twisted(d, lo, values[i])
        elif depth == _DEPTH:  # equal to working precision: any orthonormal basis of theirs
            out[:, i:j + 1] = np.linalg.qr(np.stack([_twisted(d, lo, x) for x in values[i:j + 1]], axis=1))[0]
        else:
            group = values[i:j + 1]
            spread = max(group[-1] - group[0], 8 * EPS * abs(group[-1]))
            options = []
            for shift in (group[0] - spread / 8, group[-1] + spread / 8, group[0] - spread, group[-1] + spread):
                plus, low, _ = _stationary(d, lo, shift)
                options.append((np.abs(plus).max(), shift, plus, low))
            _, shift, plus, low = min(options, key=lambda o: o[0])
            again = np.array([_bisected(plus, low, first + i + g, x - shift, spread / 16) for g, x in enumerate(group)])
            out[:, i:j + 1] = _vectors(plus, low, np.maximum.accumulate(again), first + i, depth + 1)
        i = j + 1
    return out


def eigen(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of R'R, largest first, and unit eigenvectors as columns."""
    n = len(r)
    a, b, v = bidiagonalise(r)
    top = max(np.max(np.abs(a), initial=0.0), np.max(np.abs(b), initial=0.0))
    if top == 0:
        return np.zeros(n), np.eye(n)
    a, b = a / top, b / top
    a[a == 0] = 1e-140
    values, vectors, start = [], np.zeros((n, n)), 0
    for stop in [*(np.flatnonzero(np.abs(b) <= EPS * 1e-3 * np.sqrt(np.abs(a[:-1] * a[1:])) if n > 1 else []) + 1).tolist(), n]:
        d, lo = np.square(a[start:stop]), b[start:stop - 1] / a[start:stop - 1]
        own = dqds(a[start:stop], b[start:stop - 1])[::-1]
        vectors[start:stop, len(values):len(values) + len(own)] = _vectors(d, lo, own, 0, 0)
        values += own.tolist()
        start = stop
    order = np.argsort(values)[::-1]
    return np.array(values)[order] * top ** 2, v @ vectors[:, order]
