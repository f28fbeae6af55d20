"""Sparse fits with a certificate: many small problems at once, each solved until its duality gap is closed.

A problem is ``min f(M x) + c sum(x)`` over ``x >= 0``, where ``f`` is a squared or a logistic loss. All rows
of a batch share ``M`` and are solved together by primal-dual interior point steps: Newton systems of all
open rows in one batched solve, steps shortened until the barrier function falls. The gap between the value and
a feasible dual point (the loss' gradient, scaled into the constraints) bounds the distance to the optimum, so a row
is done when its gap is a small share of its value (or what rounding leaves of it), and only then. A row that stays open is an error.
"""

from __future__ import annotations

import numpy as np

#: Share of a row's value that its duality gap may be, and the steps allowed until then (some 40 are usual).
GAP, STEPS = 1e-12, 300
#: Share of the penalty by which a condition may be missed; a row whose gap is closed has so many more tries to meet it where columns are parallel.
MISS, TRIES = 1e-7, 10


class Squared:
    """Half the mean of squared errors."""

    @staticmethod
    def value(u, y):
        return ((u - y) ** 2).sum(axis=1) / (2 * y.shape[1])

    @staticmethod
    def slope(u, y):
        return (u - y) / y.shape[1], np.full_like(u, 1 / y.shape[1])

    @staticmethod
    def conjugate_change(v, y, s):
        """f*(s v) - f*(v), without cancelling."""
        return ((s - 1) * ((s + 1) * y.shape[1] * v * v / 2 + v * y)).sum(axis=1)


class Logistic:
    """The sum of log(1 + exp(u)) - y u; ``y`` is 0 or 1."""

    @staticmethod
    def value(u, y):
        return np.logaddexp(0, np.where(y > 0, -u, u)).sum(axis=1)

    @staticmethod
    def slope(u, y):
        e = np.exp(-np.abs(u))
        miss = np.where((u > 0) == (y > 0), e, 1.0) / (1 + e)  # the share of the other class, exact where it is tiny
        return np.where(y > 0, -miss, miss), e / (1 + e) ** 2

    @staticmethod
    def conjugate_change(v, y, s):
        p, d = np.abs(v), 1 - s
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = s * p * np.log(s) - d * p * np.log(p) + (1 - p) * np.log1p(d * p / (1 - p)) + d * p * np.log1p(-s * p)
        return np.where((p > 0) & (p < 1) & (d > 0), terms, 0).sum(axis=1)


def gap(x: np.ndarray, m: np.ndarray, y: np.ndarray, cost: float, loss) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, duality gap, what rounding may add to the gap) of each row."""
    u = x @ m.T
    v, h = loss.slope(u, y)
    dual, size = v @ m, x @ np.abs(m).T
    s = np.minimum(1.0, cost / np.maximum(-dual.min(axis=1, initial=0.0), 1e-300))
    # f(u) + f*(v) is u v where v is the slope at u, so the gap is a sum of products that vanish at the optimum
    left = (x * (dual + cost)).sum(axis=1) + loss.conjugate_change(v, y, s[:, None])
    return loss.value(u, y) + cost * x.sum(axis=1), left, 4 * np.finfo(float).eps * (size * (h * (size + np.abs(y)) + np.abs(v))).sum(axis=1)


def _newton(x, m, y, cost, loss, extra, drive):
    """The steps that solve (M' H M + diag(extra)) d = drive - slope for each row."""
    v, h = loss.slope(x @ m.T, y)
    n, k = m.shape
    system = (h @ (m[:, :, None] * m[:, None, :]).reshape(n, k * k)).reshape(-1, k, k)
    least = 1e-15 * np.maximum(np.trace(system, axis1=1, axis2=2), 1e-300)[:, None]  # parallel columns leave the system singular
    system[:, np.arange(k), np.arange(k)] += np.maximum(extra, least)
    return np.linalg.solve(system, (drive - (v @ m + cost))[:, :, None])[:, :, 0]


def _violation(x, m, y, cost, loss) -> tuple[np.ndarray, np.ndarray]:
    """(how far the optimality conditions are missed, what rounding leaves of that) of each row, in shares of ``cost``."""
    v, h = loss.slope(x @ m.T, y)
    slope, size = v @ m + cost, x @ np.abs(m).T
    rounding = ((h * (size + np.abs(y)) + np.abs(v)) @ np.abs(m)).max(axis=1) * 16 * np.finfo(float).eps
    return np.where(x > 0, np.abs(slope), np.maximum(0.0, -slope)).max(axis=1) / cost, rounding / cost


def _polished(x, z, m, y, cost, loss):
    """Rows with what belongs to the constraints set to zero and the rest brought to its optimum: of a few active-set steps, the one that meets the conditions best."""
    used = x * cost > z * np.maximum(x.max(axis=1, keepdims=True), 1e-300) * 1e-3
    now = np.where(used, x, 0.0)
    best, least = now.copy(), np.full(len(x), np.inf)
    n, k = m.shape
    for _ in range(12):
        off, _ = _violation(now, m, y, cost, loss)
        better = off < least  # not where it is no number
        best[better], least = now[better], np.where(better, off, least)
        v, h = loss.slope(now @ m.T, y)
        slope = v @ m + cost
        used |= slope < -1e-9 * cost
        system = (h @ (m[:, :, None] * m[:, None, :]).reshape(n, k * k)).reshape(-1, k, k) * used[:, :, None] * used[:, None, :]
        ridge = 1e-13 * np.maximum(np.trace(system, axis1=1, axis2=2), 1e-300)[:, None]
        system[:, np.arange(k), np.arange(k)] += np.where(used, ridge, 1.0)
        now = now - np.linalg.solve(system, np.where(used, slope, 0.0)[:, :, None])[:, :, 0]
        used &= now > 0
        now = np.maximum(now, 0.0)
    return best


@np.errstate(over="ignore", invalid="ignore")  # a polished row may run away; it is not taken then
def nonnegative(m: np.ndarray, y: np.ndarray, cost: float, loss, tol: float = GAP, steps: int = STEPS) -> np.ndarray:
    """The minimising x of every row of ``y``; ArithmeticError for a row whose gap does not close."""
    k = m.shape[1]
    out = np.zeros((len(y), k))
    if not k or not len(y):
        return out
    value, left, noise = gap(out, m, y, cost, loss)
    todo = np.flatnonzero(left > tol * value + noise)  # zero may be the answer
    tries = np.zeros(len(y), int)
    x, z = np.ones((len(todo), k)), np.full((len(todo), k), cost)
    for _ in range(steps):
        if not len(todo):
            return out
        t = y[todo]
        mu = 0.1 * (x * z).mean(axis=1, keepdims=True)
        dx = _newton(x, m, t, cost, loss, z / x, mu / x)
        dz = mu / x - z - z / x * dx
        reach = lambda a, d: np.minimum(1.0, 0.995 / np.maximum((-d / a).max(axis=1, keepdims=True), 1e-300))
        step = reach(x, dx)
        barrier = lambda a: loss.value(a @ m.T, t) + cost * a.sum(axis=1) - mu[:, 0] * np.log(a).sum(axis=1)
        v, _ = loss.slope(x @ m.T, t)
        fall = ((v @ m + cost - mu / x) * dx).sum(axis=1)
        before = barrier(x)
        for _ in range(40):
            rises = barrier(x + step * dx) > before + 1e-4 * step[:, 0] * fall + 1e-13 * np.abs(before)
            if not rises.any():
                break
            step[rises] /= 2
        z = z + reach(z, dz) * dz
        x = x + step * dx
        value, left, noise = gap(x, m, t, cost, loss)
        near = left <= 1e-6 * value + noise
        if near.any():
            some = np.flatnonzero(near)
            tried = _polished(x[some], z[some], m, t[some], cost, loss)
            value, left, noise = gap(tried, m, t[some], cost, loss)
            off, rounding = _violation(tried, m, t[some], cost, loss)
            tries[todo[some]] += 1
            done = (left <= tol * value + noise) & ((off <= MISS + rounding) | (tries[todo[some]] > TRIES))
            out[todo[some[done]]] = tried[done]
            stay = np.ones(len(todo), bool)
            stay[some[done]] = False
            todo, x, z = todo[stay], x[stay], z[stay]
    if len(todo):
        raise ArithmeticError(f"{len(todo)} of {len(y)} fits stay open: the largest gap is {float(left.max()):.3g}")
    return out


def nonnegative_lasso(profiles: np.ndarray, design: np.ndarray, alpha: float) -> np.ndarray:
    """min |y - A w|^2 / (2 n) + alpha sum(w) over w >= 0, for every row of ``profiles``."""
    scale = float(np.abs(design).max(initial=0.0)) or 1.0
    return nonnegative(design / scale, profiles, alpha / scale, Squared) / scale


def l1_logistic(present: np.ndarray, design: np.ndarray, c: float = 1.0) -> np.ndarray:
    """min c * log loss + |w| without an intercept, for every row of ``present``; equal rows are fitted once."""
    scale = float(np.abs(design).max(initial=0.0)) or 1.0
    a, k = design / scale, design.shape[1]
    rows, back = np.unique(present.astype(float), axis=0, return_inverse=True)
    both = nonnegative(np.hstack([a, -a]), rows, 1 / (c * scale), Logistic) / scale
    return (both[:, :k] - both[:, k:])[back.ravel()]
