"""Mixtures of Markov chains, with covariates of membership, fitted where the sequences are.

Expectation-maximisation: a pass over the sequences takes each one's posteriors under the
present chains, and adds up what the next chains are made of: pair counts and first states
by component, the likelihood and, with covariates, the gradient and curvature of a
multinomial logit of membership, of which one Newton step is taken a pass. Tasks return
sums whose size is that of the models; they are added up in Spark, so only the models
themselves come to the driver, whatever the number of sequences or of their kinds. All
starts and all numbers of components that are asked for go through each pass together.

Sequences of equal first state, pair counts and covariates are one row with a number.
Random starts are drawn from a hash of a row, so they don't depend on tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.transitions import pairs
from eventloom.session import ensure_importable
from eventloom.storage import written

TINY = 1e-300


@dataclass
class Mixture:
    """share (k), chains (k x S x S), initial (k x S), and with covariates beta ((k - 1) x terms):
    log odds of a component against the first; scale: means and deviations of the covariates."""

    states: list[str]
    chains: np.ndarray
    initial: np.ndarray
    share: np.ndarray
    beta: np.ndarray | None = None
    scale: tuple[np.ndarray, np.ndarray] | None = None
    log_likelihood: float = -math.inf
    n: int = 0
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.share)

    @property
    def free(self) -> int:
        s = len(self.states)
        mixing = self.beta.size if self.beta is not None else self.k - 1
        return self.k * s * (s - 1) + self.k * (s - 1) + mixing

    @property
    def aic(self) -> float:
        return 2 * self.free - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.free * math.log(max(1, self.n)) - 2 * self.log_likelihood

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """Log of the prior share of each component for each row of the design."""
        if self.beta is None:
            return np.tile(np.log(np.maximum(self.share, TINY)), (len(x), 1))
        eta = np.column_stack([np.zeros(len(x)), x @ self.beta.T])
        top = eta.max(1, keepdims=True)
        return eta - top - np.log(np.exp(eta - top).sum(1, keepdims=True))

    def posteriors(self, first: np.ndarray, cells: np.ndarray, times: np.ndarray, ends: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of each row, and its log-likelihood. ends: where each row's cells begin, and the end."""
        logs = self.log_shares(x)
        logs += np.log(np.maximum(self.initial, TINY)).T[np.maximum(first, 0)] * (first >= 0)[:, None]
        part = times[:, None] * np.log(np.maximum(self.chains.reshape(self.k, -1), TINY)).T[cells]
        logs += _by_row(part, ends)
        top = logs.max(1, keepdims=True)
        whole = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        return np.exp(logs - whole[:, None]), whole


def _by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between ends."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0)])
    return total[ends[1:]] - total[ends[:-1]]


def sequence_rows(df: DataFrame, seq: Sequence[str], states: Sequence[str], covariates: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """seq, first (number of the first state there is, null without one), cells and times (pairs
    of states as from * S + to, and how often), x (covariates by name; a missing one is their
    mean). df: seq, pos, state; covariates: seq and numbers."""
    at = F.create_map(*[x for i, s in enumerate(states) for x in (F.lit(s), F.lit(i))])
    n = len(states)
    cell = (at[F.col("from")] * n + at[F.col("to")]).alias("cell")
    per = pairs(df, seq, []).select(*seq, cell).where("cell IS NOT NULL").groupBy(*seq, "cell").agg(F.count(F.lit(1)).cast("double").alias("c"))
    per = per.groupBy(*seq).agg(F.array_sort(F.collect_list(F.struct("cell", "c"))).alias("p"))
    first = df.groupBy(*seq).agg(at[F.min_by("state", F.when(F.col("state").isNotNull(), F.col("pos")))].alias("first"))
    out = first.join(per, list(seq), "left").select(*seq, "first", F.coalesce(F.transform("p", lambda e: e["cell"]), F.array().cast("array<int>")).alias("cells"), F.coalesce(F.transform("p", lambda e: e["c"]), F.array().cast("array<double>")).alias("times"))
    if covariates is None:
        return out.withColumn("x", F.array().cast("array<double>"))
    x = covariates.select(*seq, F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    return out.join(x, list(seq), "left").withColumn("x", F.coalesce("x", F.array(*[F.lit(None).cast("double")] * len(names))))


def kinds(rows: DataFrame) -> DataFrame:
    """first, cells, times, x, n, seed: equal rows as one."""
    out = rows.groupBy("first", "cells", "times", "x").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("seed", F.xxhash64("first", "cells", "times", "x"))


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    get = lambda c: b.column(b.schema.get_field_index(c))
    first = get("first").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    cells, times = get("cells"), get("times")
    ends = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    x = get("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))
    return first, cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64), times.flatten().to_numpy(zero_copy_only=False), ends, x


def _design(x: np.ndarray, scale) -> np.ndarray:
    """A column of ones and the covariates in deviations from their means; missing ones at these."""
    if scale is None:
        return np.ones((len(x), 1))
    mean, sd = scale
    return np.column_stack([np.ones(len(x)), np.nan_to_num((x - mean) / sd)])


def _uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    z = seed.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def _size(k: int, s: int, terms: int) -> int:
    return 2 + k + k * s + k * s * s + (k - 1) * terms * (1 + terms)


def _pass(data: DataFrame, models: list, s: int, scale, terms: int) -> np.ndarray:
    """Sums over all rows for each model. A model is a Mixture, or (k, salt) for a random start."""

    def run(batches):
        total = [np.zeros(_size(m[0] if isinstance(m, tuple) else m.k, s, terms)) for m in models]
        for b in batches:
            if not b.num_rows:
                continue
            first, cells, times, ends, x = _columns(b)
            n = b.column(b.schema.get_field_index("n")).to_numpy().astype(float)
            seed = b.column(b.schema.get_field_index("seed")).to_numpy()
            owner, design = np.repeat(np.arange(len(first)), np.diff(ends)), _design(x, scale)
            for m, out in zip(models, total, strict=True):
                if isinstance(m, tuple):
                    k = m[0]
                    draws = np.column_stack([-np.log(np.maximum(_uniform(seed, 1000 * m[1] + c + 1), TINY)) for c in range(k)])
                    post, whole = draws / draws.sum(1, keepdims=True), np.zeros(len(n))
                    prior = np.full_like(post, 1 / k)
                else:
                    k = m.k
                    post, whole = m.posteriors(first, cells, times, ends, design)
                    prior = np.exp(m.log_shares(design))
                weighted = post * n[:, None]
                parts = [[n @ whole, n.sum()], weighted.sum(0)]
                parts += [np.bincount(first[first >= 0], weighted[first >= 0, c], s) for c in range(k)]
                parts += [np.bincount(cells, times * weighted[owner, c], s * s) for c in range(k)]
                for c in range(1, k):
                    parts.append(design.T @ (n * (post[:, c] - prior[:, c])))
                    parts.append((design.T @ (design * (n * prior[:, c] * (1 - prior[:, c]))[:, None])).reshape(-1))
                out += np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total)], pa.list_(pa.float64()))], names=["sums"])

    each = data.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    rows = each.groupBy("at").agg(F.sum("x").alias("x")).collect()  # numbers of the models
    flat = np.zeros(sum(_size(m[0] if isinstance(m, tuple) else m.k, s, terms) for m in models))
    for r in rows:
        flat[r["at"]] = r.x
    return flat


def _next(sums: np.ndarray, m, states: list[str], smooth: float, scale, terms: int) -> Mixture:
    """The model that a pass's sums make of m."""
    s, k = len(states), m[0] if isinstance(m, tuple) else m.k
    at = 2 + k
    initial = sums[at : at + k * s].reshape(k, s) + smooth
    at += k * s
    chains = sums[at : at + k * s * s].reshape(k, s, s) + smooth
    at += k * s * s
    beta = None
    if scale is not None:
        old = np.zeros((k - 1, terms)) if isinstance(m, tuple) else m.beta
        beta = old.copy()
        for c in range(k - 1):
            gradient, curve = sums[at : at + terms], sums[at + terms : at + terms + terms * terms].reshape(terms, terms)
            beta[c] = old[c] + np.linalg.solve(curve + 1e-6 * np.eye(terms), gradient)
            at += terms + terms * terms
    return Mixture(states, chains / chains.sum(2, keepdims=True), initial / initial.sum(1, keepdims=True), sums[2 : 2 + k] / max(sums[1], TINY), beta, scale, n=int(round(sums[1])))


def fit(rows: DataFrame, states: Sequence[str], ks: Sequence[int], starts: int = 10, steps: int = 200, tol: float = 1e-6, smooth: float = 0.01, seed: int = 1, terms: Sequence[str] = ()) -> dict[int, Mixture]:
    """The best mixture found for each number of components. rows: what sequence_rows gives;
    terms: names of the covariates in x, if they should count. A model rests when its
    likelihood changes by less than tol, or with covariates by that share of it."""
    ensure_importable(rows.sparkSession)
    states, data, scale = list(states), written(kinds(rows)), None
    if terms:
        x = [F.col("x")[i] for i in range(len(terms))]
        sums = data.agg(*[F.sum(v * F.col("n")) for c in x for v in (F.when(c.isNotNull(), 1), c, c * c)]).first()
        n, one, two = (np.array([sums[3 * i + j] or 0.0 for i in range(len(terms))], float) for j in range(3))
        mean = one / np.maximum(n, 1)
        sd = np.sqrt(np.maximum(two / np.maximum(n, 1) - mean**2, 0))
        scale = mean, np.where(sd > 0, sd, 1.0)
    width = 1 + len(terms)
    models: list = [(k, seed * 1000 + r) for k in ks for r in range(starts if k > 1 else 1)]
    live, last = list(range(len(models))), {}
    for step in range(steps + 1):
        flat, at = _pass(data, [models[i] for i in live], len(states), scale, width), 0
        rest = []
        for i in live:
            size = _size(models[i][0] if isinstance(models[i], tuple) else models[i].k, len(states), width)
            sums, at = flat[at : at + size], at + size
            if step:
                models[i].log_likelihood, models[i].n = float(sums[0]), int(round(sums[1]))
                change = abs(models[i].log_likelihood - last.get(i, math.inf))
                last[i] = models[i].log_likelihood
                if change < tol or (terms and change < tol * abs(last[i])):
                    models[i].converged = True
                    continue
            if step < steps:
                models[i] = _next(sums, models[i], states, smooth, scale, width)
                rest.append(i)
        live = rest
        if not live:
            break
    best: dict[int, Mixture] = {}
    for m in models:
        if m.k not in best or m.log_likelihood > best[m.k].log_likelihood:
            best[m.k] = m
    return {k: _ordered(m) for k, m in best.items()}


def _ordered(m: Mixture) -> Mixture:
    """Components by falling share, the reference of the odds with them."""
    by = np.argsort(-m.share, kind="stable")
    if m.beta is not None:
        full = np.vstack([np.zeros(m.beta.shape[1]), m.beta])[by]
        m.beta = full[1:] - full[0]
    m.chains, m.initial, m.share = m.chains[by], m.initial[by], m.share[by]
    return m


def assigned(rows: DataFrame, model: Mixture) -> DataFrame:
    """rows with `posterior` (array) and `component` (from 1) of each sequence."""
    ensure_importable(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of the size of its chains

    def run(batches):
        m = shared.value
        for b in batches:
            first, cells, times, ends, x = _columns(b)
            post, _ = m.posteriors(first, cells, times, ends, _design(x, m.scale))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(post), pa.list_(pa.float64())), pa.array(post.argmax(1) + 1, pa.int32())], names=[*b.schema.names, "posterior", "component"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, posterior array<double>, component int")


def quality(found: DataFrame, model: Mixture) -> DataFrame:
    """One row: n, mean_posterior (of the component assigned), entropy (1: certain, 0: none),
    uncertain (share of sequences with no posterior of a half), icl. found: what assigned() gives."""
    top = F.array_max("posterior")
    own = F.aggregate("posterior", F.lit(0.0), lambda a, p: a - p * F.log(p + TINY))
    out = found.agg(F.count(F.lit(1)).alias("n"), F.avg(top).alias("mean_posterior"), F.sum(own).alias("e"), F.avg((top < 0.5).cast("double")).alias("uncertain"), (-F.sum(F.log(top + TINY))).alias("c"))
    most = F.col("n") * math.log(model.k) if model.k > 1 else F.lit(1.0)
    return out.select("n", "mean_posterior", (1 - F.col("e") / most if model.k > 1 else F.lit(1.0)).alias("entropy"), "uncertain", (F.lit(model.bic) + 2 * F.col("c")).alias("icl"))


def networks(spark, model: Mixture) -> DataFrame:
    """component, share, from, to, weight: the chain of each component as a network."""
    rows = [(c + 1, float(model.share[c]), a, b, float(model.chains[c, i, j])) for c in range(model.k) for i, a in enumerate(model.states) for j, b in enumerate(model.states)]
    return spark.createDataFrame(rows, "component int, share double, from string, to string, weight double")


def coefficients(spark, model: Mixture, terms: Sequence[str]) -> DataFrame:
    """component, term, coefficient, odds_ratio: of membership against the first component, of
    covariates in their own units."""
    rows = []
    for c in range(model.k - 1 if model.beta is not None else 0):
        slopes = model.beta[c, 1:] / model.scale[1]
        for name, b in zip(["(Intercept)", *terms], [model.beta[c, 0] - slopes @ model.scale[0], *slopes], strict=True):
            rows.append((c + 2, name, float(b), math.exp(min(700.0, b))))
    return spark.createDataFrame(rows, "component int, term string, coefficient double, odds_ratio double")
