"""Partial correlations, and sparse ones by the graphical lasso; nodewise sparse regressions."""

from __future__ import annotations

import math

import numpy as np


def precision_to_partial(theta: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(theta))
    out = -theta / np.outer(d, d)
    out = (out + out.T) / 2
    np.fill_diagonal(out, 0)
    return out


def partial_correlations(r: np.ndarray) -> np.ndarray:
    return precision_to_partial(np.linalg.inv(r))


def _soft(x: float, t: float) -> float:
    return math.copysign(max(abs(x) - t, 0.0), x)


def graphical_lasso(s: np.ndarray, rho: float, start: tuple | None = None, tol: float = 1e-8, allowed: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """The precision matrix that maximises the penalised likelihood, diagonal not penalised;
    `allowed` (with rho 0) fits without penalty on those cells alone."""
    p = len(s)
    w, beta = (s.copy(), np.zeros((p, p))) if start is None else (start[0].copy(), start[1].copy())
    scale = max(1e-12, np.abs(s - np.diag(np.diag(s))).mean())
    for _ in range(2000):
        before = w.copy()
        for j in range(p):
            rest = [i for i in range(p) if i != j]
            v, target, b = w[np.ix_(rest, rest)], s[rest, j], beta[rest, j].copy()
            for _ in range(1000):
                moved = 0.0
                for k in range(p - 1):
                    if allowed is not None and not allowed[rest[k], j]:
                        new = 0.0
                    else:
                        new = _soft(target[k] - v[k] @ b + v[k, k] * b[k], rho) / v[k, k]
                    moved = max(moved, abs(new - b[k]))
                    b[k] = new
                if moved < tol * 0.1:
                    break
            beta[rest, j] = b
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - before).mean() < tol * scale:
            break
    theta = np.zeros((p, p))
    for j in range(p):
        rest = [i for i in range(p) if i != j]
        theta[j, j] = 1 / (w[j, j] - w[rest, j] @ beta[rest, j])
        theta[rest, j] = -beta[rest, j] * theta[j, j]
    theta = (theta + theta.T) / 2
    return theta, (w, beta)


def kkt_violation(theta: np.ndarray, s: np.ndarray, rho: float) -> float:
    """How far theta is from the conditions of the optimum."""
    gap = np.linalg.inv(theta) - s
    off = ~np.eye(len(s), dtype=bool)
    active = off & (np.abs(theta) > 1e-8)
    worst = np.abs(gap - rho * np.sign(theta))[active].max(initial=0.0)
    idle = np.maximum(np.abs(gap) - rho, 0)[off & ~active].max(initial=0.0)
    return float(max(worst, idle, np.abs(np.diag(gap)).max()))


def sparse_partial(s: np.ndarray, n: int, gamma: float = 0.5, steps: int = 40, ratio: float = 0.01, refit: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Partial correlations, precision and penalty chosen by the extended information criterion."""
    p = len(s)
    top = np.abs(s - np.diag(np.diag(s))).max()
    best, start = None, None
    for rho in np.exp(np.linspace(math.log(top), math.log(top * ratio), steps)):
        theta, start = graphical_lasso(s, rho, start, 1e-5)
        ll = n / 2 * (np.linalg.slogdet(theta)[1] - np.trace(s @ theta))
        k = int((np.abs(np.triu(theta, 1)) > 1e-10).sum())
        score = -2 * ll + k * math.log(n) + 4 * k * gamma * math.log(p)
        if best is None or score < best[0]:
            best = score, rho
    theta, _ = graphical_lasso(s, best[1])
    if refit:
        theta, _ = graphical_lasso(s, 0.0, allowed=np.abs(theta) > 1e-10)
    theta = np.where(np.abs(theta) > 1e-10, theta, 0)
    return precision_to_partial(theta), theta, float(best[1])


def moments(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of rows that stand for so many each."""
    mean = weight @ x / weight.sum()
    return mean, np.sqrt(np.maximum(weight @ (x - mean) ** 2 / weight.sum(), 0))


def logistic_path(x: np.ndarray, y: np.ndarray, penalties: np.ndarray, weight: np.ndarray | None = None) -> list[tuple[float, np.ndarray, float]]:
    """(intercept, coefficients, log-likelihood) of L1-penalised logistic regressions, each
    started from the one before: quadratic bounds, coordinate descent inside. A row may stand
    for `weight` equal ones."""
    p = x.shape[1]
    h = np.ones(len(x)) if weight is None else weight.astype(float)
    n = h.sum()
    mean, sd = moments(x, h)
    share = float(h @ y / n)
    z = (x - mean) / np.where(sd > 0, sd, 1)
    b0, b = math.log(max(share, 1e-9) / max(1 - share, 1e-9)), np.zeros(p)
    out = []
    for lam in penalties:
        for _ in range(200):
            eta = b0 + z @ b
            mu = 1 / (1 + np.exp(-eta))
            own = np.maximum(mu * (1 - mu), 1e-5)
            r, w = (y - mu) / own, h * own  # working residual
            old0, old = b0, b.copy()
            for _ in range(100):
                moved = 0.0
                step = (w * r).sum() / w.sum()
                b0 += step
                r = r - step
                for k in range(p):
                    if sd[k] == 0:
                        continue
                    a = (w * z[:, k] ** 2).sum() / n
                    new = _soft((w * z[:, k] * r).sum() / n + a * b[k], lam) / a
                    if new != b[k]:
                        r = r - z[:, k] * (new - b[k])
                        moved = max(moved, abs(new - b[k]))
                        b[k] = new
                if moved < 1e-7:
                    break
            if max(abs(b0 - old0), np.abs(b - old).max(initial=0)) < 1e-6:
                break
        eta = b0 + z @ b
        ll = float(h @ (y * eta - np.logaddexp(0, eta)))
        coef = b / np.where(sd > 0, sd, 1)
        out.append((float(b0 - (coef * mean).sum()), coef, ll))
    return out


def linear_path(x: np.ndarray, y: np.ndarray, penalties: np.ndarray, weight: np.ndarray | None = None) -> list[tuple[np.ndarray, float]]:
    """Coefficients and log-likelihood of lasso regressions on standardised columns."""
    p = x.shape[1]
    h = np.ones(len(x)) if weight is None else weight.astype(float)
    n = h.sum()
    b, out = np.zeros(p), []
    g, c = (x.T * h) @ x / n, (x.T * h) @ y / n
    for lam in penalties:
        for _ in range(1000):
            moved = 0.0
            for k in range(p):
                if g[k, k] == 0:
                    continue
                new = _soft(c[k] - g[k] @ b + g[k, k] * b[k], lam) / g[k, k]
                moved = max(moved, abs(new - b[k]))
                b[k] = new
            if moved < 1e-8:
                break
        rss = float(h @ (y - x @ b) ** 2 / n)
        out.append((b.copy(), -n / 2 * (math.log(2 * math.pi * max(rss, 1e-12)) + 1)))
    return out


def symmetrised(m: np.ndarray, rule: str = "AND") -> np.ndarray:
    out = (m + m.T) / 2
    if rule == "AND":
        out = np.where((m != 0) & (m.T != 0), out, 0.0)
    np.fill_diagonal(out, 0)
    return out


def ising(x: np.ndarray, gamma: float = 0.25, steps: int = 50, rule: str = "AND", weight: np.ndarray | None = None) -> np.ndarray:
    """Couplings of 0/1 columns: each on the others, the penalty by the information criterion.
    Rows may be patterns with their counts as weights."""
    p = x.shape[1]
    h = np.ones(len(x)) if weight is None else weight.astype(float)
    n = h.sum()
    mean, sd = moments(x, h)
    out = np.zeros((p, p))
    for j in range(p):
        rest = [i for i in range(p) if i != j]
        z = (x[:, rest] - mean[rest]) / np.maximum(sd[rest], 1e-12)
        top = max(1e-9, np.abs((z.T * h) @ (x[:, j] - mean[j])).max() / n)
        fits = logistic_path(x[:, rest], x[:, j], np.exp(np.linspace(math.log(top), math.log(top * 0.01), steps)), h)
        score = [-2 * ll + (k := int((c != 0).sum())) * math.log(n) + 2 * gamma * k * math.log(max(p - 1, 1)) for _, c, ll in fits]
        out[j, rest] = fits[int(np.argmin(score))][1]
    return symmetrised(out, rule)


def mixed(x: np.ndarray, kinds: list[str], gamma: float = 0.25, steps: int = 50, rule: str = "AND", weight: np.ndarray | None = None) -> np.ndarray:
    """A mixed model's edges: nodewise lasso, gaussian (g) or binary (c) by column; small
    coefficients go, and an edge weighs the mean size of its two sides."""
    p = x.shape[1]
    h = np.ones(len(x)) if weight is None else weight.astype(float)
    n = h.sum()
    z = np.array(x, float)
    mean, sd = moments(z, h)
    for j, kind in enumerate(kinds):
        if kind == "g":
            z[:, j] = (z[:, j] - mean[j]) / max(sd[j] * math.sqrt(n / max(n - 1, 1)), 1e-12)
    mean = h @ z / n
    out = np.zeros((p, p))
    for j, kind in enumerate(kinds):
        rest = [i for i in range(p) if i != j]
        d = z[:, rest] - mean[rest]
        top = max(1e-9, np.abs((d.T * h) @ (z[:, j] - mean[j])).max() / n)
        grid = np.exp(np.linspace(math.log(top), math.log(top * 0.01), steps))
        fits = [(c, ll) for _, c, ll in logistic_path(z[:, rest], z[:, j], grid, h)] if kind == "c" else linear_path(d, z[:, j] - mean[j], grid, h)
        score = [-2 * ll + (k := int((c != 0).sum())) * math.log(n) + 2 * gamma * k * math.log(p - 1) for c, ll in fits]
        c = fits[int(np.argmin(score))][0]
        cut = math.sqrt(float((c**2).sum())) * math.sqrt(math.log(p - 1) / n) if p > 2 else 0.0
        out[j, rest] = np.where(np.abs(c) >= cut, np.abs(c), 0)
    return symmetrised(out, rule)


def predictability(theta: np.ndarray) -> np.ndarray:
    return np.clip(1 - 1 / np.diag(theta), 0, 1)


def prediction_error(r2: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Root mean squared error of predictions that explain r2 of deviations sd."""
    return sd * np.sqrt(np.maximum(1 - r2, 0))


def neighbour_predictability(r: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r))
    for j in range(len(r)):
        near = [i for i in range(len(r)) if i != j and w[i, j] != 0]
        if near:
            out[j] = r[near, j] @ np.linalg.solve(r[np.ix_(near, near)], r[near, j])
    return np.clip(out, 0, 1)
