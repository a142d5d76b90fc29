"""Numpy helpers that run inside grouped tasks on one small group."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def bounded_least_squares(
    residual: Callable[[np.ndarray], np.ndarray], p0, lb, ub, loss: str = "linear", steps: int = 200, tol: float = 1e-12
) -> tuple[np.ndarray, np.ndarray, float]:
    """Damped Gauss-Newton within bounds: (values, deviations, cost).

    `cauchy` reweights residuals by 1 / (1 + r^2) and scores by ln(1 + r^2).
    """
    lb, ub = np.asarray(lb, float), np.asarray(ub, float)
    p = np.clip(np.asarray(p0, float), lb, ub)

    def cost_of(r: np.ndarray) -> float:
        return float(np.sum(np.log1p(r * r)) if loss == "cauchy" else r @ r)

    def jacobian(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        cols = []
        for k in range(len(q)):
            h = 1e-7 * max(abs(q[k]), 1e-12)
            h = -h if q[k] + h > ub[k] else h
            shifted = q.copy()
            shifted[k] += h
            cols.append((residual(shifted) - r) / h)
        return np.array(cols).T

    r = residual(p)
    cost, damp = cost_of(r), 1e-3
    jac = jacobian(p, r)
    for _ in range(steps):
        w = 1 / (1 + r * r) if loss == "cauchy" else np.ones_like(r)
        a = jac.T @ (w[:, None] * jac)
        g = jac.T @ (w * r)
        scale = np.where(np.diag(a) > 0, np.diag(a), 1.0)
        moved = False
        for _ in range(12):
            step = np.linalg.lstsq(a + damp * np.diag(scale), -g, rcond=None)[0]
            trial = np.clip(p + step, lb, ub)
            rt = residual(trial)
            ct = cost_of(rt) if np.all(np.isfinite(rt)) else math.inf
            if ct < cost:
                moved = True
                break
            damp *= 4
        if not moved:
            break
        gain = cost - ct
        p, r, cost = trial, rt, ct
        jac = jacobian(p, r)
        damp = max(damp / 6, 1e-12)
        if gain <= tol * max(cost, 1e-300):
            break
    free = max(len(r) - len(p), 1)
    cov = np.linalg.pinv(jac.T @ jac) * float(r @ r) / free
    return p, np.sqrt(np.maximum(np.diag(cov), 0)), cost


def bounded_least_squares_lanes(
    residual: Callable[[np.ndarray, np.ndarray], np.ndarray], p0, lb, ub, lanes: int, loss: str = "linear", steps: int = 200, tol: float = 1e-12
) -> tuple[np.ndarray, np.ndarray]:
    """`bounded_least_squares` of many problems with one start and bounds: (values, cost), a line per problem.

    `residual(q, at)` gives the lines of residuals of the problems `at` for
    the lines of parameters `q`. Each problem takes its own steps and damping
    and leaves when it has settled.
    """
    lb, ub = np.asarray(lb, float), np.asarray(ub, float)
    p = np.tile(np.clip(np.asarray(p0, float), lb, ub), (lanes, 1))
    size = p.shape[1]

    def cost_of(r: np.ndarray) -> np.ndarray:
        out = np.log1p(r * r).sum(axis=1) if loss == "cauchy" else (r * r).sum(axis=1)
        return np.where(np.isfinite(r).all(axis=1), out, np.inf)

    def jacobian(q: np.ndarray, r: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty((*r.shape, size))
        for k in range(size):
            h = 1e-7 * np.maximum(np.abs(q[:, k]), 1e-12)
            h = np.where(q[:, k] + h > ub[k], -h, h)
            shifted = q.copy()
            shifted[:, k] += h
            out[:, :, k] = (residual(shifted, at) - r) / h[:, None]
        return out

    live = np.arange(lanes)
    r = residual(p, live)
    cost, damp = cost_of(r), np.full(lanes, 1e-3)
    live = live[np.isfinite(cost)] if size else live[:0]
    jac = jacobian(p[live], r[live], live)
    for _ in range(steps):
        if not len(live):
            break
        now = r[live]
        w = 1 / (1 + now * now) if loss == "cauchy" else np.ones_like(now)
        turned = np.swapaxes(jac, 1, 2)
        a = turned @ (w[:, :, None] * jac)
        g = turned @ (w * now)[:, :, None]
        diagonal = np.einsum("bkk->bk", a)
        scale = np.where(diagonal > 0, diagonal, 1.0)
        gain, left = np.full(len(live), np.nan), np.arange(len(live))
        for _ in range(12):
            at = live[left]
            damped = a[left] + damp[at][:, None, None] * (np.eye(size) * scale[left][:, None, :])
            trial = np.clip(p[at] - np.linalg.solve(damped, g[left])[:, :, 0], lb, ub)
            rt = residual(trial, at)
            ct = cost_of(rt)
            better = ct < cost[at]
            won = at[better]
            gain[left[better]] = cost[won] - ct[better]
            p[won], r[won], cost[won] = trial[better], rt[better], ct[better]
            left = left[~better]
            if not len(left):
                break
            damp[live[left]] *= 4
        moved = ~np.isnan(gain)
        damp[live[moved]] = np.maximum(damp[live[moved]] / 6, 1e-12)
        live = live[moved & (gain > tol * np.maximum(cost[live], 1e-300))]
        jac = jacobian(p[live], r[live], live)
    return p, cost


def resample_counts(n: int, replicate: int, seed: int = 7) -> np.ndarray:
    """How often each of n rows is in a resample of n draws with replacement."""
    return np.bincount(np.random.default_rng((seed, replicate)).integers(0, n, n), minlength=n)


def peak_properties(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, prominences and half-prominence widths of local maxima.

    A flat top counts once at its middle. Bases come from the nearest higher
    samples, found with a stack.
    """
    n = len(y)
    tops = []
    i = 1
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                tops.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    at = np.array(tops, dtype=int)
    prom, width = np.zeros(len(at)), np.zeros(len(at))
    for k, p in enumerate(at):
        higher = np.flatnonzero(y[:p] > y[p])
        left = higher[-1] + 1 if len(higher) else 0
        higher = np.flatnonzero(y[p + 1:] > y[p])
        right = p + higher[0] if len(higher) else n - 1
        prom[k] = y[p] - max(y[left: p + 1].min(), y[p: right + 1].min())
        level = y[p] - prom[k] / 2
        lb = left + np.flatnonzero(y[left: p + 1] == y[left: p + 1].min())[-1]
        rb = p + np.flatnonzero(y[p: right + 1] == y[p: right + 1].min())[0]
        a = p
        while a > lb and y[a] > level:
            a -= 1
        lo = a + (level - y[a]) / (y[a + 1] - y[a]) if y[a] < level else float(a)
        b = p
        while b < rb and y[b] > level:
            b += 1
        hi = b - (level - y[b]) / (y[b - 1] - y[b]) if y[b] < level else float(b)
        width[k] = hi - lo
    return at, prom, width


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _fraction(a, b, x)


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 + even * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + even / c
        h *= d * (c if abs(c) > tiny else tiny)
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + odd * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + odd / (c if abs(c) > tiny else tiny)
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def t_quantile(p: float, dof: float) -> float:
    """Quantile of Student's t by bisection on the tail probability."""
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    tail = 2 * (1 - p)
    lo, hi = 0.0, 1.0
    while _incomplete_beta(dof / 2, 0.5, dof / (dof + hi * hi)) > tail and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if _incomplete_beta(dof / 2, 0.5, dof / (dof + mid * mid)) > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@lru_cache(maxsize=100_000)
def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    """Critical value of the largest studentised deviation among n values; keys of equal size ask for the same ones."""
    t = t_quantile(1 - alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


@lru_cache(maxsize=256)
def circuit_tree(model: str) -> tuple:
    """A circuit string as nested tuples: ("-", parts), ("p", parts) or (element, name); read once, as fits ask for it thousands of times."""
    from galvanite.functions.circuits import split_top

    parts = split_top(model.replace(" ", ""), "-")
    if len(parts) > 1:
        return "-", tuple(map(circuit_tree, parts))
    text = parts[0]
    if text.startswith("p("):
        return "p", tuple(map(circuit_tree, split_top(text[2:-1], ",")))
    return text.rstrip("0123456789"), text


def circuit_impedance(model: str, params: dict[str, float], freq: np.ndarray) -> np.ndarray:
    """Impedance of a circuit string on a frequency array."""
    return _impedance(circuit_tree(model), params, 2j * np.pi * freq)


def _impedance(tree: tuple, params: dict[str, float], jw: np.ndarray) -> np.ndarray:
    kind, text = tree
    if kind == "-":
        return sum(_impedance(p, params, jw) for p in text)
    if kind == "p":
        return 1 / sum(1 / _impedance(p, params, jw) for p in text)
    if kind == "R":
        return params[text] * np.ones_like(jw)
    if kind == "C":
        return 1 / (params[text] * jw)
    if kind == "L":
        return params[text] * jw
    a, b = params[f"{text}_0"], params[f"{text}_1"]
    if kind == "CPE":
        return 1 / (a * jw**b)
    if kind == "ICPE":
        return a * jw ** (-b)
    return a / (1 + jw * b)
