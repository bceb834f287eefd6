"""Eigenpairs of a symmetric matrix: Householder reduction, then divide and conquer on the tridiagonal form."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Halvings of a root's interval; a root is held as its distance from the nearest pole, which can be tiny.
HALVINGS = 170


def tridiagonal_form(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q @ t @ q.T."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        if scale == 0 or not np.abs(x[1:]).any():
            continue
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        # both sides of the reflection at once: a - 2 v w' - 2 w v'
        p = a[k + 1 :, k + 1 :] @ v
        w = p - v * (v @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = x - 2 * v * (v @ x)
        a[k + 1 :, k] = a[k, k + 1 :] = column
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return a.diagonal().copy(), a.diagonal(1).copy(), q


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(pole number, distance from it) of the roots of 1 + rho * sum(z2 / (d - x)), one above each d."""
    k = len(d)
    upper = np.r_[d[1:], d[-1] + rho * z2.sum()]
    gap = upper - d
    f = lambda at, m: 1 + rho * (z2 / ((d - d[at][:, None]) - m[:, None])).sum(1)
    own = np.arange(k)
    with np.errstate(divide="ignore", invalid="ignore"):
        # f rises between poles: a root in the upper half is nearer to the next pole
        high = (f(own, gap / 2) < 0) & (own < k - 1)
    pole = np.where(high, own + 1, own)
    low = np.where(high, -gap / 2, 0.0)
    top = np.where(high, 0.0, np.where(own < k - 1, gap / 2, gap))
    for _ in range(HALVINGS):
        m = (low + top) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            below = f(pole, m) < 0
        low, top = np.where(below, m, low), np.where(below, top, m)
    return pole, np.where(high, low, top)


def _rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(d) + rho * z z', rho > 0, ascending."""
    n = len(d)
    q = np.eye(n)
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order], q[:, order]
    length = np.linalg.norm(z)
    rho, z = rho * length**2, z / length
    tolerance = 8 * EPS * max(np.abs(d).max(), rho)
    live, last = [], -1
    for i in range(n):
        if rho * abs(z[i]) <= tolerance:
            z[i] = 0.0
            continue
        if last >= 0:
            t = np.hypot(z[last], z[i])
            c, s = z[i] / t, z[last] / t
            if abs((d[i] - d[last]) * c * s) <= tolerance:
                # equal but for rounding: turned so that one of them is done with
                z[i], z[last] = t, 0.0
                a, b = q[:, last].copy(), q[:, i].copy()
                q[:, last], q[:, i] = c * a - s * b, s * a + c * b
                d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                live.remove(last)
        live.append(i)
        last = i
    values, vectors = d.copy(), q
    if live:
        k = np.array(live)
        k = k[np.argsort(d[k], kind="stable")]
        p, w = d[k], z[k]
        pole, m = _roots(p, w * w, rho)
        apart = (p[pole][:, None] - p) + m[:, None]  # root j less pole i
        # the z that has these roots exactly keeps the vectors orthogonal
        own = np.arange(len(k))
        ratio = np.ones((len(k), len(k)))
        for j in range(len(k) - 1):
            other = np.where(own <= j, j + 1, j)
            ratio[j] = apart[j] / (p[other] - p)
        ratio[-1] = apart[-1]
        w = np.copysign(np.sqrt(np.abs(np.prod(ratio, 0))), w)
        u = w[None, :] / -apart
        u /= np.linalg.norm(u, axis=1)[:, None]
        values[k] = p[pole] + m
        vectors = q.copy()
        vectors[:, k] = q[:, k] @ u.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    h = n // 2
    rho = abs(e[h - 1])
    a, b = d[:h].copy(), d[h:].copy()
    a[-1] -= rho
    b[0] -= rho
    (va, qa), (vb, qb) = _conquer(a, e[: h - 1]), _conquer(b, e[h:])
    q = np.zeros((n, n))
    q[:h, :h], q[h:, h:] = qa, qb
    if rho == 0:
        values = np.r_[va, vb]
        order = np.argsort(values, kind="stable")
        return values[order], q[:, order]
    values, u = _rank_one(np.r_[va, vb], np.r_[qa[-1], np.sign(e[h - 1]) * qb[0]], rho)
    return values, q @ u


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues ascending, unit eigenvectors as columns) of a symmetric matrix."""
    scale = np.abs(a).max(initial=0.0)
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal_form(a / scale)
    values, u = _conquer(d, e)
    return values * scale, q @ u
