"""Multinomial logistic regression on small designs, plain or with Firth's penalty."""

from __future__ import annotations

import math

import numpy as np

from eventloom.kernels.distributions import normal_sf


def multinomial(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, firth: bool = False, steps: int = 100) -> dict:
    """Coefficients (classes from 1 x columns) against class 0, with standard errors, odds
    ratios, intervals, p, log-likelihood and McFadden's share. Rows may carry counts."""
    n, p = x.shape
    k = int(y.max())
    w = np.ones(n) if weight is None else weight.astype(float)
    beta = np.zeros((k, p))
    hot = np.eye(k + 1)[y][:, 1:]

    def probabilities(b):
        eta = np.hstack([np.zeros((n, 1)), x @ b.T])
        e = np.exp(eta - eta.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def information(q):
        out = np.zeros((k * p, k * p))
        for a in range(k):
            for c in range(k):
                v = w * (q[:, a + 1] * ((a == c) - q[:, c + 1]))
                out[a * p : (a + 1) * p, c * p : (c + 1) * p] = x.T @ (x * v[:, None])
        return out

    def objective(b):
        q = probabilities(b)
        value = float((w * np.log(np.maximum(q[np.arange(n), y], 1e-300))).sum())
        return value + (0.5 * np.linalg.slogdet(information(q) + 1e-10 * np.eye(k * p))[1] if firth else 0.0)

    now = objective(beta)
    for _ in range(steps):
        q = probabilities(beta)
        info = information(q) + 1e-10 * np.eye(k * p)
        score = ((hot - q[:, 1:]) * w[:, None]).T @ x
        if firth:
            base, h = 0.5 * np.linalg.slogdet(info)[1], 1e-5
            for a in range(k):
                for c in range(p):
                    moved = beta.copy()
                    moved[a, c] += h
                    score[a, c] += (0.5 * np.linalg.slogdet(information(probabilities(moved)) + 1e-10 * np.eye(k * p))[1] - base) / h
        step = np.linalg.solve(info, score.reshape(-1)).reshape(k, p)
        scale = 1.0
        while scale > 1e-6 and (new := objective(beta + scale * step)) < now - 1e-12:
            scale /= 2
        beta = beta + scale * step
        if abs(new - now) < 1e-10:
            break
        now = new
    q = probabilities(beta)
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(information(q) + 1e-10 * np.eye(k * p))), 0)).reshape(k, p)
    ll = float((w * np.log(np.maximum(q[np.arange(n), y], 1e-300))).sum())
    share = np.bincount(y, weights=w, minlength=k + 1) / w.sum()
    null = float((w * np.log(share[y])).sum())
    z = beta / np.maximum(se, 1e-300)
    return {"beta": beta, "se": se, "odds_ratio": np.exp(beta), "low": np.exp(beta - 1.96 * se), "high": np.exp(beta + 1.96 * se), "p_value": np.vectorize(lambda v: 2 * normal_sf(abs(v)))(z), "log_likelihood": ll, "mcfadden": 1 - ll / null if null else math.nan}
