"""Mixed networks whose edges depend on a moderator.

Each variable is regressed on the others, sparsely, with products: of the moderator and each
other variable, or, for the moderator itself, of all pairs of others. A product of three
variables stands for one thing seen from three sides; it counts if all of its sides do. With
a value for the moderator the products become parts of the edges between the others.

A numeric variable's regression needs no more than sums of products of the design's columns:
one pass of Spark adds up a matrix whose size is that of the design, however many rows there are. A 0/1
variable's likelihood needs the combinations of values that occur, with counts, which are
checked to be few: round numeric columns if they aren't.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.expressions import bounded
from eventloom.kernels.penalised import logistic_path
from eventloom.operators.association import complete
from eventloom.session import ensure_importable

MOST_COMBINATIONS = 200_000


@dataclass
class Moderated:
    """sides: for each variable its coefficients by what they belong to, (j,) or (j, k); main and
    product: which edges, and which products with the moderator, all sides agree on."""

    columns: list[str]
    kinds: list[str]
    moderator: int
    sides: list[dict[tuple[int, ...], float]]
    main: np.ndarray
    product: np.ndarray
    center: float
    spread: float


def _features(z: np.ndarray, terms: list[tuple[int, ...]]) -> np.ndarray:
    return np.column_stack([np.ones(len(z)), *[np.prod(z[:, list(t)], axis=1) for t in terms]])


def product_moments(rows: DataFrame, columns: Sequence[str], center: np.ndarray, spread: np.ndarray, terms: list[tuple[int, ...]]) -> np.ndarray:
    """Sums over rows of products of 1 and all terms (columns, in deviations, multiplied)."""
    ensure_importable(rows.sparkSession)
    size = 1 + len(terms)

    def run(batches):
        total = np.zeros((size, size))
        for b in batches:
            z = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]) if b.num_rows else np.zeros((0, len(columns)))
            u = _features((z - center) / spread, terms)
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["sums"])

    cells = rows.select(*columns).mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    out = np.zeros(size * size)
    for r in cells.groupBy("at").agg(F.sum("x").alias("x")).collect():  # the design's columns squared
        out[r["at"]] = r.x
    return out.reshape(size, size)


def _lasso(g: np.ndarray, c: np.ndarray, yy: float, n: float, steps: int, ratio: float) -> list[tuple[np.ndarray, float]]:
    """Coefficients and log-likelihood along falling penalties, from correlations g of the
    columns and covariances c with the outcome."""
    top = max(1e-9, float(np.abs(c).max(initial=0.0)))
    b, out = np.zeros(len(c)), []
    for lam in np.exp(np.linspace(math.log(top), math.log(top * ratio), steps)):
        for _ in range(1000):
            moved = 0.0
            for k in range(len(c)):
                if g[k, k] == 0:
                    continue
                pull = c[k] - g[k] @ b + g[k, k] * b[k]
                new = math.copysign(max(abs(pull) - lam, 0.0), pull) / g[k, k]
                moved, b[k] = max(moved, abs(new - b[k])), new
            if moved < 1e-9:
                break
        rss = max(yy - 2 * b @ c + b @ g @ b, 1e-12)
        out.append((b.copy(), -n / 2 * (math.log(2 * math.pi * rss) + 1)))
    return out


def _chosen(fits: list[tuple[np.ndarray, float]], n: float, gamma: float, threshold: bool) -> np.ndarray:
    """The coefficients of the least extended information criterion; small ones go."""
    width = max(len(fits[0][0]), 1)
    score = [-2 * ll + (k := int((b != 0).sum())) * math.log(n) + 2 * gamma * k * math.log(width) for b, ll in fits]
    b = fits[int(np.argmin(score))][0]
    if threshold:
        b = np.where(np.abs(b) < math.sqrt(2 * float((b**2).sum()) * math.log(width) / n), 0.0, b)
    return b


def fit(df: DataFrame, columns: Sequence[str], moderator: str, kinds: Sequence[str] | None = None, gamma: float = 0.25, rule: str = "AND", threshold: bool = True, steps: int = 100, ratio: float = 0.01) -> Moderated:
    """kinds: g (numeric) or c (0/1) for each column, numeric if not given. Rows with a missing
    value are left out."""
    columns, kinds = list(columns), list(kinds or ["g"] * len(columns))
    p, m = len(columns), columns.index(moderator)
    rows = complete(df, columns)
    about = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    n = float(about.n)
    if n < 2:
        raise ValueError("a network needs two complete rows at least")
    numeric = np.array([k == "g" for k in kinds])
    center = np.where(numeric, [about[f"m{i}"] for i in range(p)], 0.0)
    spread = np.where(numeric, [about[f"s{i}"] or 1.0 for i in range(p)], 1.0)
    terms: list[tuple[int, ...]] = [(i,) for i in range(p)] + list(itertools.combinations(range(p), 2))
    at = {t: k + 1 for k, t in enumerate(terms)}
    sums = product_moments(rows, columns, center, spread, terms) / n
    mean = sums[0]
    cov = sums - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    patterns = None
    sides = []
    for v in range(p):
        rest = [i for i in range(p) if i != v]
        pairs = list(itertools.combinations(rest, 2)) if v == m else [tuple(sorted((j, m))) for j in rest if j != m]
        design = [(i,) for i in rest] + pairs
        k = [at[t] for t in design]
        scale = np.where(sd[k] > 1e-12, sd[k], 1.0)
        if kinds[v] == "g":
            g, c = cov[np.ix_(k, k)] / np.outer(scale, scale), cov[k, at[v,]] / scale
            b = _chosen([(x / scale, ll) for x, ll in _lasso(g, c, cov[at[v,], at[v,]], n, steps, ratio)], n, gamma, False)
        else:
            if patterns is None:
                found = bounded(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), MOST_COMBINATIONS, "combinations of values")
                patterns = np.array([list(r) for r in sorted(found)], float)
            z, w = (patterns[:, :p] - center) / spread, patterns[:, p]
            x = _features(z, design)[:, 1:]
            slope = np.abs(((x - w @ x / n) * w[:, None]).T @ (z[:, v] - mean[at[v,]])) / n / scale
            top = max(1e-9, float(slope.max(initial=0.0)))
            fits = [(b, ll) for _, b, ll in logistic_path(x, z[:, v], np.exp(np.linspace(math.log(top), math.log(top * ratio), min(steps, 30))), w)]
            b = _chosen(fits, n, gamma, False) / 2  # of two classes each has half of the contrast
        # products of numeric columns alone count in their own deviations
        own = np.array([sd[i] * math.sqrt(n / (n - 1)) if len(t) == 2 and numeric[list(t)].all() else 1.0 for t, i in zip(design, k, strict=True)])
        b = b * own
        if threshold:
            b = np.where(np.abs(b) < math.sqrt(2 * float((b**2).sum()) * math.log(max(len(b), 2)) / n), 0.0, b)
        sides.append({t: float(x / o) for t, x, o in zip(design, b, own, strict=True)})
    main, product = np.ones((p, p), bool), np.ones((p, p), bool)
    if rule == "AND":
        main, product = np.zeros((p, p), bool), np.zeros((p, p), bool)
        for i, j in itertools.combinations(range(p), 2):
            main[i, j] = main[j, i] = sides[i][j,] != 0 and sides[j][i,] != 0
            if m not in (i, j):
                of = [sides[i].get(tuple(sorted((j, m))), 0.0), sides[j].get(tuple(sorted((i, m))), 0.0), sides[m].get((i, j), 0.0)]
                product[i, j] = product[j, i] = all(of)
    return Moderated(columns, kinds, m, sides, main, product, float(center[m]), float(spread[m]))


def conditioned(model: Moderated, value: float, rule: str = "AND") -> np.ndarray:
    """Edge weights between the other variables where the moderator has this value (in its own
    units): sizes of what both sides say, averaged; the moderator's own edges are 0."""
    p, m = len(model.columns), model.moderator
    z = (value - model.center) / model.spread
    side = np.zeros((p, p))
    for v, j in itertools.permutations([i for i in range(p) if i != m], 2):
        x = model.sides[v][j,] if model.main[v, j] else 0.0
        if model.product[v, j]:
            x += model.sides[v].get(tuple(sorted((j, m))), 0.0) * z
        side[v, j] = abs(x)
    out = (side + side.T) / 2
    return np.where((side > 0) & (side.T > 0), out, 0.0) if rule == "AND" else out


def networks(spark, model: Moderated, values: Sequence[float]) -> DataFrame:
    """moderator (its value), from, to, weight of the edges there are."""
    rows = []
    for value in values:
        w = conditioned(model, value)
        rows += [(float(value), model.columns[j], model.columns[i], float(w[i, j])) for i in range(len(w)) for j in range(i) if w[i, j] > 0]
    return spark.createDataFrame(rows, "moderator double, from string, to string, weight double")
