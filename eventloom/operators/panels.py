"""Resampling of numeric panels: bootstrap and comparison of association networks.

A replicate needs moments alone: how many rows, their sums, and their sums of products. Each
block of rows makes them for all replicates, and they add up; correlations, and models on
them, are made of p x p matrices afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.kernels import graphs, penalised
from eventloom.kernels.distributions import adjust
from eventloom.operators.association import complete
from eventloom.operators.resampling import correlation
from eventloom.storage import written

BLOCK = 20_000


def _moments(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x).reshape(-1)])


def _correlation(m: np.ndarray, p: int) -> np.ndarray:
    n, mean = m[0], m[1 : p + 1] / m[0]
    c = m[p + 1 :].reshape(p, p) / n - np.outer(mean, mean)
    d = np.sqrt(np.maximum(np.diag(c), 1e-300))
    return c / np.outer(d, d)


def moment_replicates(df: DataFrame, columns: Sequence[str], iterations: int, seed: int, share: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Moments of all rows, and iterations x moments of rows drawn with replacement, or of a
    share of them without. Blocks' parts of the draws come from generators seeded alike."""
    rows = complete(df, columns)
    blocks = max(1, rows.count() // BLOCK + 1)
    # the row's number keeps equal rows, however many, from meeting in one block
    dealt = written(rows.withColumn("block", F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(blocks)).cast("int")))
    sizes = {r.block: r["count"] for r in dealt.groupBy("block").count().collect()}
    order = sorted(sizes)
    total = sum(sizes.values())
    size = np.array([sizes[k] for k in order])
    names = list(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf.block.iloc[0])
        x = pdf[names].sort_values(names).to_numpy(float)
        out = [_moments(x, np.ones(len(x)))]
        for r in range(iterations):
            shared = np.random.default_rng((seed, r))
            part = shared.multinomial(total, size / total) if share is None else shared.multivariate_hypergeometric(size, max(1, round(total * share)))
            own = np.random.default_rng((seed, r, b + 1))
            n = int(part[order.index(b)])
            w = own.multinomial(n, np.full(len(x), 1 / len(x))) if share is None else np.bincount(own.permutation(len(x))[:n], minlength=len(x))
            out.append(_moments(x, w.astype(float)))
        return pd.DataFrame({"replicate": np.arange(-1, iterations, dtype=np.int32), "sums": out})

    cells = dealt.groupBy("block").applyInPandas(run, "replicate int, sums array<double>").select("replicate", F.posexplode("sums").alias("cell", "x"))
    got = cells.groupBy("replicate", "cell").agg(F.sum("x").alias("x")).orderBy("replicate", "cell").collect()
    m = np.array([r.x for r in got]).reshape(iterations + 1, -1)
    return m[0], m[1:]


def _model(method: str, n: float, **params) -> Callable[[np.ndarray], np.ndarray]:
    if method == "cor":
        return lambda r: r - np.eye(len(r))
    if method == "pcor":
        return penalised.partial_correlations
    return lambda r: penalised.sparse_partial(r, int(n), **params)[0]


def bootstrap_association(df: DataFrame, columns: Sequence[str], method: str = "glasso", iterations: int = 100, seed: int = 1, level: float = 0.05, **params) -> list[dict]:
    """For each pair of variables: the edge, its replicates' mean and interval, and how often
    it is there."""
    p = len(columns)
    whole, boot = moment_replicates(df, columns, iterations, seed)
    model = _model(method, whole[0], **params)
    observed, drawn = model(_correlation(whole, p)), np.array([model(_correlation(m, p)) for m in boot])
    return [{"from": columns[j], "to": columns[i], "weight": float(observed[i, j]), "mean": float(drawn[:, i, j].mean()), "low": float(np.quantile(drawn[:, i, j], level / 2)), "high": float(np.quantile(drawn[:, i, j], 1 - level / 2)), "inclusion": float((drawn[:, i, j] != 0).mean())} for i in range(p) for j in range(i)]


def strength_stability(df: DataFrame, columns: Sequence[str], method: str = "pcor", drops: Sequence[float] = (0.1, 0.3, 0.5, 0.7), iterations: int = 50, seed: int = 1, least: float = 0.7, certainty: float = 0.95) -> list[dict]:
    """How strength, when rows are dropped, correlates with that of all rows."""
    out, coefficient = [], 0.0
    for k, drop in enumerate(drops):
        whole, kept = moment_replicates(df, columns, iterations, seed + k, 1 - drop)
        model = _model(method, whole[0])
        of = lambda m: np.abs(model(_correlation(m, len(columns)))).sum(0)  # noqa: E731, B023
        r = np.array([correlation(of(whole), of(m)) for m in kept])
        good = float((r > least).mean())
        coefficient = drop if good > certainty else coefficient
        out.append({"drop": drop, "mean": float(r.mean()), "share_above": good})
    return [o | {"coefficient": coefficient} for o in out]


def compare_networks(x: DataFrame, y: DataFrame, columns: Sequence[str], method: str = "pcor", iterations: int = 100, seed: int = 1, p_adjust: str = "none", **params) -> dict:
    """Whether two groups' association networks differ: global strength, largest edge
    difference, and each edge, against relabelled rows.

    A relabelling draws the first group's rows from both; the second group's moments are what
    is left of the sum."""
    p = len(columns)
    a = moment_replicates(x, columns, 0, seed)[0]
    both, drawn = moment_replicates(complete(x, columns).unionByName(complete(y, columns)), columns, iterations, seed, a[0] / (a[0] + moment_replicates(y, columns, 0, seed)[0][0]))
    upper = np.triu_indices(p, 1)

    def statistics(m: np.ndarray) -> tuple[float, float, np.ndarray]:
        u, v = (_model(method, z[0], **params)(_correlation(z, p))[upper] for z in (m, both - m))
        return abs(np.abs(u).sum() - np.abs(v).sum()), float(np.abs(u - v).max()), np.abs(u - v)

    s, e, each = statistics(a)
    null = [statistics(m) for m in drawn]
    p_of = lambda seen, values: (1 + sum(v >= seen - 1e-15 for v in values)) / (iterations + 1)
    edges = adjust([p_of(each[k], [n[2][k] for n in null]) for k in range(len(each))], p_adjust)
    return {"strength": s, "p_strength": p_of(s, [n[0] for n in null]), "largest": e, "p_largest": p_of(e, [n[1] for n in null]), "edges": [(columns[i], columns[j], float(each[k]), edges[k]) for k, (i, j) in enumerate(zip(*upper, strict=True))]}


def composites(df: DataFrame, clusters: dict[str, Sequence[str]], weights: dict[str, float] | None = None) -> DataFrame:
    """One column for each cluster of items: the (weighted) mean of those that aren't missing."""
    weights = weights or {}
    out = []
    for name, items in clusters.items():
        # sums of arrays: a chain of additions over many items would be a plan that grows with each use
        tops = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * weights.get(c, 1.0) for c in items])
        lows = F.array(*[F.when(F.col(c).isNotNull(), abs(weights.get(c, 1.0))).otherwise(0.0) for c in items])
        add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        out.append((add(tops) / F.nullif(add(lows), F.lit(0.0))).alias(name))
    return df.select(*out)


def item_loadings(w: np.ndarray, clusters: dict[str, Sequence[str]]) -> list[dict]:
    """An item's mean absolute weight with its own cluster, and the other cluster it is closest to."""
    at = {c: i for i, c in enumerate(c for members in clusters.values() for c in members)}
    w = np.abs(w)
    out = []
    for name, members in clusters.items():
        for c in members:
            mean = {k: float(np.mean([w[at[c], at[m]] for m in ms if m != c])) if any(m != c for m in ms) else 0.0 for k, ms in clusters.items()}
            other = max((k for k in mean if k != name), key=mean.get, default=None)
            out.append({"item": c, "cluster": name, "own": mean[name], "other": other, "cross": mean.get(other, 0.0), "misfit": other is not None and mean[other] > mean[name]})
    return out


def loading_stability(df: DataFrame, clusters: dict[str, Sequence[str]], method: str = "pcor", iterations: int = 100, seed: int = 1, level: float = 0.05) -> list[dict]:
    """Each item's loading on its own cluster, its interval over resampled rows, and how often
    another cluster came closer."""
    items = [c for members in clusters.values() for c in members]
    whole, boot = moment_replicates(df, items, iterations, seed)
    model = _model(method, whole[0])
    observed = item_loadings(model(_correlation(whole, len(items))), clusters)
    drawn = [item_loadings(model(_correlation(m, len(items))), clusters) for m in boot]
    out = []
    for k, o in enumerate(observed):
        own = np.array([d[k]["own"] for d in drawn])
        out.append({"item": o["item"], "cluster": o["cluster"], "own": o["own"], "low": float(np.quantile(own, level / 2)), "high": float(np.quantile(own, 1 - level / 2)), "misfit_share": float(np.mean([d[k]["misfit"] for d in drawn]))})
    return out


def layered_association(df: DataFrame, clusters: dict[str, Sequence[str]], method: str = "pcor") -> dict[str, list[dict]]:
    """The network of clusters' composites (`macro`) and that of each cluster's items, and
    loadings: an item's mean weight with its own cluster and the most with another."""
    from eventloom.operators.association import correlations, network

    items = [c for members in clusters.values() for c in members]
    df = written(df.select(*items))
    r, n = correlations(df, items)
    loadings = item_loadings(_model(method, n)(r), clusters)
    out = {"macro": network(written(composites(df, clusters)), list(clusters), method), "loadings": loadings}
    for name, members in clusters.items():
        out[name] = network(df, list(members), method) if len(members) > 1 else []
    return out


def strengths(w: np.ndarray) -> dict[str, np.ndarray]:
    """Strength, expected influence, closeness and betweenness of an association network."""
    return {"strength": np.abs(w).sum(0), "expected_influence": w.sum(0), "closeness": graphs.closeness(w)["closeness"], "betweenness": graphs.betweenness(w, directed=False)}
