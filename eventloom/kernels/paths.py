"""Path models of one covariance matrix: maximum likelihood, fit, and modification indices."""

from __future__ import annotations

import math

import numpy as np


class PathModel:
    """Outcomes (the first p variables) on others; the rest are free to go together as they do.

    s: covariances (over n rows, with n below). paths: (outcome, predictor) pairs."""

    def __init__(self, s: np.ndarray, n: int, p: int, paths: list[tuple[int, int]]):
        self.s, self.n, self.p, self.q, self.paths = s, n, p, len(s), list(paths)
        self.a = np.zeros((self.q, self.q))
        self.v = np.diag(s)[:p].copy()
        self.converged = self._fit()

    def sigma(self, a: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = np.linalg.inv(np.eye(self.q) - a)
        e = np.zeros((self.q, self.q))
        e[: self.p, : self.p] = np.diag(v)
        e[self.p :, self.p :] = self.s[self.p :, self.p :]
        return b, b @ e @ b.T

    def _slopes(self, b: np.ndarray, sigma: np.ndarray, paths: list[tuple[int, int]]) -> list[np.ndarray]:
        """Derivatives of sigma by paths."""
        out = []
        for i, j in paths:
            x = np.outer(b[:, i], sigma[j])
            out.append(x + x.T)
        return out

    def _loss(self, a, v) -> float:
        try:
            _, sigma = self.sigma(a, v)
            sign, log = np.linalg.slogdet(sigma)
            return log + float(np.trace(np.linalg.solve(sigma, self.s))) if sign > 0 and (v > 0).all() else math.inf
        except np.linalg.LinAlgError:
            return math.inf

    def _fit(self) -> bool:
        for i in range(self.p):  # least squares to begin with
            on = [j for o, j in self.paths if o == i]
            if on:
                self.a[i, on] = np.linalg.lstsq(self.s[np.ix_(on, on)], self.s[on, i], rcond=None)[0]
                self.v[i] = max(self.s[i, i] - self.a[i, on] @ self.s[on, i], 1e-6 * self.s[i, i])
        loss = self._loss(self.a, self.v)
        if not math.isfinite(loss):
            self.a[:] = 0.0
            self.v = np.diag(self.s)[: self.p].copy()
            loss = self._loss(self.a, self.v)
        for _ in range(40):
            score, info = self._information(self.paths)
            try:
                step = np.linalg.solve(info, score)
            except np.linalg.LinAlgError:
                return False
            size = 1.0
            while size > 1e-3:
                a, v = self.a.copy(), self.v + size * step[len(self.paths) :]
                for (i, j), d in zip(self.paths, step, strict=False):
                    a[i, j] += size * d
                new = self._loss(a, v)
                if new < loss + 1e-13:
                    break
                size /= 2
            else:
                break
            done = loss - new < 1e-10
            self.a, self.v, loss = a, v, new
            if done:
                break
        info = self._information(self.paths)[1]
        d = np.sqrt(np.maximum(np.diag(info), 1e-300))  # whatever the units
        return math.isfinite(loss) and bool(np.linalg.eigvalsh(info / np.outer(d, d)).min(initial=1.0) > 1e-8)

    def _information(self, paths: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Score and expected information of paths and residual variances, for one row."""
        b, sigma = self.sigma(self.a, self.v)
        inverse = np.linalg.inv(sigma)
        slopes = self._slopes(b, sigma, paths) + [np.outer(b[:, i], b[:, i]) for i in range(self.p)]
        w = [inverse @ d for d in slopes]
        gap = inverse @ (self.s - sigma)
        score = np.array([0.5 * np.trace(x @ gap) for x in w])
        flat = np.array([x.reshape(-1) for x in w])
        turned = np.array([x.T.reshape(-1) for x in w])
        return score, 0.5 * flat @ turned.T

    def modification(self, candidates: list[tuple[int, int]]) -> np.ndarray:
        """How much chi-square would fall, about, with each path more."""
        score, info = self._information(self.paths + list(candidates))
        k, c = len(self.paths), len(candidates)
        own = [*range(k), *range(k + c, len(score))]
        new = range(k, k + c)
        inner = np.linalg.inv(info[np.ix_(own, own)])
        out = np.zeros(c)
        for at, j in enumerate(new):
            left = info[j, j] - info[j, own] @ inner @ info[own, j]
            out[at] = self.n * score[j] ** 2 / left if left > 1e-10 else 0.0
        return out

    def z(self) -> np.ndarray:
        """Each path over its standard error."""
        _, info = self._information(self.paths)
        se = np.sqrt(np.maximum(np.diag(np.linalg.inv(info)) / self.n, 1e-300))
        return np.array([self.a[i, j] for i, j in self.paths]) / se[: len(self.paths)]

    def standardised(self) -> np.ndarray:
        """Coefficients in deviations, as the model has them."""
        d = np.sqrt(np.diag(self.sigma(self.a, self.v)[1]))
        return self.a * d[None, :] / d[:, None]

    def fit_measures(self) -> dict[str, float]:
        """chisq, df, rmsea, srmr, nnfi, cfi."""
        q, e = self.q, self.q - self.p
        _, sigma = self.sigma(self.a, self.v)
        log = np.linalg.slogdet(self.s)[1]
        chisq = max(0.0, self.n * (self._loss(self.a, self.v) - log - q))
        df = q * (q + 1) // 2 - len(self.paths) - self.p - e * (e + 1) // 2
        base, base_df = self.n * (np.log(np.diag(self.s)).sum() - log), q * (q - 1) // 2
        gap = (self.s - sigma) / np.sqrt(np.outer(np.diag(self.s), np.diag(self.s)))
        srmr = math.sqrt(float((np.tril(gap) ** 2).sum()) / (q * (q + 1) / 2 + q))
        over, base_over = max(0.0, chisq - df), max(0.0, base - base_df)
        nnfi = (base / base_df - chisq / df) / (base / base_df - 1) if df > 0 and base > base_df else 1.0
        return {"chisq": chisq, "df": float(df), "rmsea": math.sqrt(over / (df * self.n)) if df > 0 else 0.0, "srmr": srmr, "nnfi": nnfi, "cfi": 1 - over / max(over, base_over) if max(over, base_over) > 0 else 1.0}

    def stable(self) -> bool:
        """Whether what a row hands on to the next dies out: predictors p, p + 1, ... are the
        outcomes a row before."""
        p = self.p
        if self.q < 2 * p:
            return True
        move = np.linalg.solve(np.eye(p) - self.a[:p, :p], self.a[:p, self.q - p :])
        return bool(np.abs(np.linalg.eigvals(move)).max(initial=0.0) < 1.0)


def _inverse(m: np.ndarray) -> np.ndarray:
    """Of each matrix; NaN where there is none."""
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        out = np.full(m.shape, np.nan)
        for k, x in enumerate(m):
            try:
                out[k] = np.linalg.inv(x)
            except np.linalg.LinAlgError:
                pass
        return out


class PathModels:
    """PathModel for many covariance matrices side by side, each with some of the same paths.

    s: (k, q, q) over n (k) rows. paths: all that any model may have; free: (k, paths), which a
    model has. In score and information the inverse of sigma cancels out, for sigma is made of
    the paths and of e: what is left are inverses of outcomes by outcomes."""

    def __init__(self, s: np.ndarray, n: np.ndarray, p: int, paths: list[tuple[int, int]], free: np.ndarray, fit: bool = True):
        self.s, self.n, self.p, self.q, self.paths = s, n.astype(float), p, s.shape[1], list(paths)
        self.i, self.j = np.array([x for x, _ in self.paths], int), np.array([x for _, x in self.paths], int)
        self.free = free.copy()
        self.a, self.v = np.zeros((len(s), p, self.q)), np.diagonal(s, axis1=1, axis2=2)[:, :p].copy()
        self.converged = np.zeros(len(s), bool)
        with np.errstate(all="ignore"):
            sign, log = np.linalg.slogdet(s[:, p:, p:])
            self.past = np.where(sign > 0, log, np.inf)
            if fit and len(s):
                self._fit()

    def of(self, at: np.ndarray) -> PathModels:
        """Some of them."""
        out = PathModels(self.s[at], self.n[at], self.p, self.paths, self.free[at], fit=False)
        out.a, out.v, out.converged = self.a[at], self.v[at], self.converged[at]
        return out

    def put(self, at: np.ndarray, other: PathModels, which: np.ndarray) -> None:
        """Takes models over from others."""
        self.a[at], self.v[at], self.free[at], self.converged[at] = other.a[which], other.v[which], other.free[which], other.converged[which]

    def _off(self) -> np.ndarray:
        out = -self.a
        out[:, range(self.p), range(self.p)] += 1
        return out

    def _loss(self) -> np.ndarray:
        off = self._off()
        sign, log = np.linalg.slogdet(off[:, :, : self.p])
        rest = ((off @ self.s) * off).sum(2)
        out = np.log(self.v).sum(1) + self.past - 2 * log + (rest / self.v).sum(1) + self.q - self.p
        return np.where((self.v > 0).all(1) & (sign != 0) & np.isfinite(out), out, np.inf)

    def sigma(self) -> tuple[np.ndarray, np.ndarray]:
        """b (without its rows of the past, which are the identity's) and sigma."""
        p = self.p
        b = _inverse(self._off()[:, :, :p])
        b = np.concatenate([b, b @ self.a[:, :, p:]], axis=2)
        e = np.zeros_like(self.s)
        e[:, range(p), range(p)] = self.v
        e[:, p:, p:] = self.s[:, p:, p:]
        whole = np.zeros_like(self.s)
        whole[:, range(self.q), range(self.q)] = 1.0
        whole[:, :p] = b
        return b, whole @ e @ whole.transpose(0, 2, 1)

    def _information(self) -> tuple[np.ndarray, np.ndarray]:
        """Score and expected information of all paths and residual variances, for one row."""
        i, j, p, k = self.i, self.j, self.p, len(self.paths)
        b, sigma = self.sigma()
        down = np.zeros((len(self.s), self.q, p))  # of b the columns of outcomes
        down[:, :p] = b[:, :, :p]
        off = self._off() / self.v[:, :, None]
        h = off @ (self.s - sigma)
        score = np.concatenate([h[:, i, j], 0.5 * (h * off).sum(2)], axis=1)
        info = np.zeros((len(self.s), k + p, k + p))
        across = down[:, j][:, :, i]
        info[:, :k, :k] = across * across.transpose(0, 2, 1) + sigma[:, j][:, :, j] * (i[:, None] == i) / self.v[:, i][:, :, None]
        mixed = down[:, j, i] / self.v[:, i]
        info[:, range(k), k + i] = mixed
        info[:, k + i, range(k)] = mixed
        info[:, range(k, k + p), range(k, k + p)] = 0.5 / self.v**2
        return score, info

    def _own(self, info: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which parameters a model has, and their information: the identity for others."""
        own = np.concatenate([self.free, np.ones((len(self.s), self.p), bool)], axis=1)
        out = np.where(own[:, :, None] & own[:, None, :], info, 0.0)
        at = np.arange(own.shape[1])
        out[:, at, at] = np.where(own, out[:, at, at], 1.0)
        return own, out

    def _fit(self) -> None:
        for i in range(self.p):  # least squares to begin with
            js = self.j[self.i == i]
            if not len(js):
                continue
            has = self.free[:, self.i == i]
            m = np.where(has[:, :, None] & has[:, None, :], self.s[:, js][:, :, js], 0.0)
            m[:, range(len(js)), range(len(js))] += ~has
            y = np.where(has, self.s[:, js, i], 0.0)
            x = (_inverse(m) @ y[:, :, None])[:, :, 0]
            for k in np.flatnonzero(~np.isfinite(x).all(1)):
                x[k] = np.linalg.lstsq(m[k], y[k], rcond=None)[0] if np.isfinite(m[k]).all() and np.isfinite(y[k]).all() else np.nan
            self.a[:, i, js] = x * has
            total = self.s[:, i, i]
            self.v[:, i] = np.where(has.any(1), np.maximum(total - (x * y).sum(1), 1e-6 * total), total)
        loss = self._loss()
        bad = ~np.isfinite(loss)
        self.a[bad], self.v[bad] = 0.0, np.diagonal(self.s[bad], axis1=1, axis2=2)[:, : self.p]
        loss[bad] = self.of(bad)._loss()
        k, ok, left = len(self.paths), np.isfinite(self.s).all((1, 2)), np.arange(len(self.s))
        left = left[ok]
        for _ in range(40):
            if not len(left):
                break
            m = self.of(left)
            score, info = m._information()
            own, info = m._own(info)
            step = (_inverse(info) @ np.where(own, score, 0.0)[:, :, None])[:, :, 0]
            fine = np.isfinite(step).all(1)
            ok[left[~fine]] = False
            left, m, step = left[fine], m.of(fine), step[fine]
            new, size, todo = loss[left].copy(), 1.0, np.arange(len(left))
            while size > 1e-3 and len(todo):
                t = m.of(todo)
                t.a[:, t.i, t.j] += size * step[todo, :k]
                t.v += size * step[todo, k:]
                now = t._loss()
                good = now < loss[left[todo]] + 1e-13
                self.put(left[todo[good]], t, good)
                new[todo[good]] = now[good]
                todo, size = todo[~good], size / 2
            go = loss[left] - new >= 1e-10
            loss[left] = new
            go[todo] = False
            left = left[go]
        ok &= np.isfinite(loss)
        at = np.flatnonzero(ok)
        m = self.of(at)
        info = m._own(m._information()[1])[1]
        d = np.sqrt(np.maximum(np.diagonal(info, axis1=1, axis2=2), 1e-300))
        info = info / (d[:, :, None] * d[:, None, :])
        fine = np.isfinite(info).all((1, 2))
        at, info = at[fine], info[fine]
        self.converged[at[np.linalg.eigvalsh(info).min(axis=1, initial=1.0) > 1e-8]] = True

    def modification(self) -> np.ndarray:
        """How much chi-square would fall, about, with each path that a model lacks."""
        with np.errstate(all="ignore"):
            score, info = self._information()
            own, inner = self._own(info)
            inner = np.where(own[:, :, None] & own[:, None, :], _inverse(inner), 0.0)
            k = len(self.paths)
            left = np.diagonal(info, axis1=1, axis2=2)[:, :k] - np.einsum("aij,ajk,aki->ai", info[:, :k], inner, info[:, :, :k], optimize=True)
            return np.where((left > 1e-10) & ~self.free, self.n[:, None] * score[:, :k] ** 2 / left, 0.0)

    def z(self) -> np.ndarray:
        """Each path over its standard error; NaN for those that a model lacks."""
        with np.errstate(all="ignore"):
            inner = _inverse(self._own(self._information()[1])[1])
            se = np.sqrt(np.maximum(np.diagonal(inner, axis1=1, axis2=2) / self.n[:, None], 1e-300))
            return np.where(self.free, self.a[:, self.i, self.j] / se[:, : len(self.paths)], np.nan)

    def standardised(self) -> np.ndarray:
        d = np.sqrt(np.diagonal(self.sigma()[1], axis1=1, axis2=2))
        return self.a * d[:, None, :] / d[:, : self.p, None]

    def fit_measures(self) -> dict[str, np.ndarray]:
        """chisq, df, rmsea, srmr, nnfi, cfi, as PathModel has them."""
        with np.errstate(all="ignore"):
            q, p, n, e = self.q, self.p, self.n, self.q - self.p
            _, sigma = self.sigma()
            log = np.linalg.slogdet(self.s)[1]
            chisq = np.maximum(0.0, n * (self._loss() - log - q))
            df = q * (q + 1) // 2 - self.free.sum(1) - p - e * (e + 1) // 2
            own = np.diagonal(self.s, axis1=1, axis2=2)
            base, base_df = n * (np.log(own).sum(1) - log), q * (q - 1) // 2
            gap = (self.s - sigma) / np.sqrt(own[:, :, None] * own[:, None, :])
            srmr = np.sqrt((np.tril(gap) ** 2).sum((1, 2)) / (q * (q + 1) / 2 + q))
            over = np.maximum(0.0, chisq - df)
            most = np.maximum(over, np.maximum(0.0, base - base_df))
            nnfi = np.where((df > 0) & (base > base_df), (base / base_df - chisq / df) / (base / base_df - 1), 1.0)
            return {"chisq": chisq, "df": df.astype(float), "rmsea": np.where(df > 0, np.sqrt(over / (df * n)), 0.0), "srmr": srmr, "nnfi": nnfi, "cfi": np.where(most > 0, 1 - over / most, 1.0)}

    def stable(self) -> np.ndarray:
        p = self.p
        if self.q < 2 * p or not len(self.s):
            return np.ones(len(self.s), bool)
        with np.errstate(all="ignore"):
            move = _inverse(self._off()[:, :, :p]) @ self.a[:, :, self.q - p :]
            fine = np.isfinite(move).all((1, 2))
            return fine & (np.abs(np.linalg.eigvals(np.where(fine[:, None, None], move, 0.0))).max(axis=1, initial=0.0) < 1.0)
