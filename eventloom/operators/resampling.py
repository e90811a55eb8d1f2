"""Inference by resampling sequences or rows.

Counting is done once, in Spark: each sequence's pair counts, packed as one row. Replicates
are tasks: a replicate draws sequences with its own seed and sums their counts. With counts
of n sequences over K states that is an n x K^2 matrix; replicates run where it is, in
blocks of sequences, so neither the driver nor one task holds a corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.kernels.distributions import adjust, beta_cdf, beta_quantile
from eventloom.operators.transitions import pairs
from eventloom.session import ensure_importable

#: Sequences whose counts are drawn together in a task.
BLOCK = 4096


def sequence_counts(df: DataFrame, seq: Sequence[str], states: Sequence[str], group: str | None = None) -> DataFrame:
    """One row for each sequence: block, counts (array of K * K), and group."""
    at = F.create_map(*[x for i, s in enumerate(states) for x in (F.lit(s), F.lit(i))])
    n = len(states)
    keys = [*seq, *([group] if group else [])]
    p = pairs(df, seq, [group] if group else []).select(*keys, (at[F.col("from")] * n + at[F.col("to")]).alias("cell"))
    per = p.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "c"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double"))
    return per.select(*keys, counts.alias("counts"))


def replicate_sums(counts: DataFrame, seq: Sequence[str], iterations: int, seed: int, cells: int, share: float | None = None) -> DataFrame:
    """replicate, sums: counts of as many sequences as there are, drawn with replacement (or
    of a share of them, without).

    A sequence's weight in a replicate is drawn in its block: blocks get multinomial shares
    of the draws (hypergeometric ones without replacement) from a generator that all tasks
    seed alike, so block totals add up exactly."""
    ensure_importable(counts.sparkSession)
    blocks = max(1, counts.count() // BLOCK + 1)
    dealt = counts.withColumn("block", F.pmod(F.xxhash64(*seq), F.lit(blocks)).cast("int"))
    sizes = {r.block: r["count"] for r in dealt.groupBy("block").count().collect()}
    order = sorted(sizes)
    total = sum(sizes.values())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf.block.iloc[0])
        rows = np.array(pdf.sort_values(list(seq)).counts.tolist())
        out = np.zeros((iterations, cells))
        for r in range(iterations):
            shared = np.random.default_rng((seed, r))
            size = np.array([sizes[k] for k in order])
            part = shared.multinomial(total, size / total) if share is None else shared.multivariate_hypergeometric(size, max(1, round(total * share)))
            own = np.random.default_rng((seed, r, b + 1))
            n = int(part[order.index(b)])
            weight = own.multinomial(n, np.full(len(rows), 1 / len(rows))) if share is None else np.bincount(own.permutation(len(rows))[:n], minlength=len(rows))
            out[r] = weight @ rows
        return pd.DataFrame({"replicate": np.arange(iterations, dtype=np.int32), "sums": list(out)})

    parts = dealt.groupBy("block").applyInPandas(run, "replicate int, sums array<double>")
    if blocks == 1:
        return parts
    cell = parts.select("replicate", F.posexplode("sums").alias("cell", "x")).groupBy("replicate", "cell").agg(F.sum("x").alias("x"))
    return cell.groupBy("replicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "x"))), lambda e: e["x"]).alias("sums"))


def row_shares(m: np.ndarray) -> np.ndarray:
    total = m.sum(-1, keepdims=True)
    return np.divide(m, total, out=np.zeros_like(m), where=total > 0)


def collect_replicates(counts: DataFrame, seq: Sequence[str], states: Sequence[str], iterations: int, seed: int, share: float | None = None, relative: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The observed matrix and iterations x K x K replicates: both small."""
    k = len(states)
    n = k * k
    whole = counts.select(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(n)]).first()
    observed = np.array([x or 0.0 for x in whole]).reshape(k, k)
    rows = replicate_sums(counts, seq, iterations, seed, n, share).orderBy("replicate").collect()
    boot = np.array([r.sums for r in rows]).reshape(len(rows), k, k)
    return (row_shares(observed), row_shares(boot)) if relative else (observed, boot)


def bootstrap_table(observed: np.ndarray, boot: np.ndarray, states: Sequence[str], level: float = 0.05, inference: str = "stability", band: tuple[float, float] = (0.75, 1.25), threshold: float | None = None, strict: bool = False, basic: bool = False) -> list[dict]:
    """For each edge: mean, sd, interval and p of its replicates."""
    n = len(boot)
    low, high = np.quantile(boot, [level / 2, 1 - level / 2], axis=0)
    if basic:
        low, high = 2 * observed - high, 2 * observed - low
    if inference == "stability":
        a, b = np.sort(np.stack([observed * band[0], observed * band[1]]), axis=0)
        out = ((boot < a) | (boot > b)) if strict else ((boot <= a) | (boot >= b))
    else:
        cut = threshold if threshold is not None else (np.quantile(np.abs(observed[observed != 0]), 0.1) if (observed != 0).any() else 0.0)
        out = np.abs(boot) < cut
    p = (1 + out.sum(0)) / (n + 1)
    return [{"from": f, "to": t, "weight": float(observed[i, j]), "mean": float(boot[:, i, j].mean()), "sd": float(boot[:, i, j].std(ddof=1)), "low": float(low[i, j]), "high": float(high[i, j]), "p_value": float(p[i, j])} for i, f in enumerate(states) for j, t in enumerate(states) if observed[i, j] != 0]


def permutation_table(a: np.ndarray, b: np.ndarray, states: Sequence[str], iterations: int = 500, seed: int = 1, paired: bool = False, method: str = "none", transform: Callable[[np.ndarray], np.ndarray] = row_shares) -> list[dict]:
    """Differences of two groups of sequences' counts (n x K x K), with the p of relabelling.

    Takes counts of sequences, so the two groups' sequences must fit a task; permutation_test
    samples replicates' labels in blocks for larger ones."""
    rng = np.random.default_rng(seed)
    observed = transform(a.sum(0)) - transform(b.sum(0))
    pool, k = np.concatenate([a, b]), len(a)
    hits, s1, s2 = np.zeros_like(observed), np.zeros_like(observed), np.zeros_like(observed)
    whole = pool.sum(0)
    flat = pool.reshape(len(pool), -1)
    for _ in range(iterations):
        if paired:
            pick = np.where(rng.random(k) < 0.5, np.arange(k), np.arange(k) + k)
        else:
            pick = rng.permutation(len(pool))[:k]
        x = flat[pick].sum(0).reshape(whole.shape)
        d = transform(x) - transform(whole - x)
        hits += np.abs(d) >= np.abs(observed) - 1e-15
        s1 += d
        s2 += d * d
    sd = np.sqrt(np.maximum(s2 / iterations - (s1 / iterations) ** 2, 0))
    p = (1 + hits) / (iterations + 1)
    adjusted = adjust(p.reshape(-1).tolist(), method)
    n = len(states)
    return [{"from": f, "to": t, "difference": float(observed[i, j]), "effect": float(observed[i, j] / sd[i, j]) if sd[i, j] > 0 else 0.0, "p_value": adjusted[i * n + j]} for i, f in enumerate(states) for j, t in enumerate(states)]


def permutation_test(counts: DataFrame, seq: Sequence[str], group: str, states: Sequence[str], iterations: int = 500, seed: int = 1, method: str = "none", transform: Callable[[np.ndarray], np.ndarray] = row_shares) -> list[dict]:
    """The same for any number of sequences: a replicate takes a random set of sequences of
    the first group's size, drawn block by block, as its first group."""
    k = len(states)
    labels = sorted(r[0] for r in counts.select(group).distinct().collect())[:2]
    two = counts.where(F.col(group).isin(labels))
    sums = {r[group]: (np.array([r[f"c{i}"] for i in range(k * k)]).reshape(k, k), r.n) for r in two.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(k * k)]).collect()}
    (a, na), (b, nb) = sums[labels[0]], sums[labels[1]]
    observed = transform(a) - transform(b)
    rows = replicate_sums(two, seq, iterations, seed, k * k, na / (na + nb)).orderBy("replicate").collect()
    x = np.array([r.sums for r in rows]).reshape(len(rows), k, k)
    d = np.array([transform(m) - transform(a + b - m) for m in x])
    sd = d.std(0)
    p = (1 + (np.abs(d) >= np.abs(observed) - 1e-15).sum(0)) / (iterations + 1)
    adjusted = np.array(adjust(p.reshape(-1).tolist(), method)).reshape(k, k)
    return [{"from": f, "to": t, "difference": float(observed[i, j]), "effect": float(observed[i, j] / sd[i, j]) if sd[i, j] > 0 else 0.0, "p_value": float(adjusted[i, j])} for i, f in enumerate(states) for j, t in enumerate(states)]


def _ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    _, place, counts = np.unique(x, return_inverse=True, return_counts=True)
    del order
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2)[place]


def correlation(x: np.ndarray, y: np.ndarray, method: str = "pearson") -> float:
    if method == "spearman":
        x, y = _ranks(x), _ranks(y)
    if method == "kendall":
        a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        low = np.sqrt((a * a).sum() * (b * b).sum())
        return float((a * b).sum() / low) if low else float("nan")
    if x.std() == 0 or y.std() == 0:
        return float("nan")
    return float(np.corrcoef(x, y)[0, 1])


def split_half(counts: DataFrame, seq: Sequence[str], states: Sequence[str], iterations: int = 200, seed: int = 1, share: float = 0.5) -> list[dict]:
    """For each iteration how two random halves' networks differ."""
    whole, halves = collect_replicates(counts, seq, states, iterations, seed, share, relative=False)
    out = []
    for h in halves:
        x, y = row_shares(h).reshape(-1), row_shares(whole - h).reshape(-1)
        d = np.abs(x - y)
        out.append({"mean_abs": float(d.mean()), "median_abs": float(np.median(d)), "pearson": correlation(x, y), "max_abs": float(d.max())})
    return out


def case_drop(counts: DataFrame, seq: Sequence[str], states: Sequence[str], iterations: int = 100, seed: int = 1, drops: Sequence[float] = (0.1, 0.3, 0.5, 0.7), least: float = 0.7, certainty: float = 0.95, method: str = "spearman", measure: Callable[[np.ndarray], np.ndarray] | None = None) -> list[dict]:
    """How edges (or a measure of the network) correlate with the whole's when sequences are
    dropped, and the stability coefficient: the largest share that may go."""
    out, coefficient = [], 0.0
    for k, drop in enumerate(drops):
        whole, kept = collect_replicates(counts, seq, states, iterations, seed + k, 1 - drop)
        of = measure or (lambda m: m[~np.eye(len(m), dtype=bool)])
        r = np.array([correlation(of(whole), of(x), method) for x in kept])
        r = r[~np.isnan(r)]
        good = float((r >= least).mean()) if len(r) else 0.0
        coefficient = drop if good >= certainty else coefficient
        out.append({"drop": drop, "mean": float(r.mean()) if len(r) else float("nan"), "sd": float(r.std(ddof=1)) if len(r) > 1 else 0.0, "share_above": good})
    return [o | {"coefficient": coefficient} for o in out]


def certainty(counts: np.ndarray, states: Sequence[str], prior: float = 0.5, level: float = 0.05, band: tuple[float, float] = (0.75, 1.25)) -> list[dict]:
    """Posterior of each transition share under a Dirichlet prior, without draws: mean, sd,
    interval, and the mass outside the band around the estimate."""
    alpha = counts + prior
    total = alpha.sum(1, keepdims=True)
    shares = row_shares(counts)
    out = []
    for i, f in enumerate(states):
        for j, t in enumerate(states):
            if counts[i, j] == 0:
                continue
            a, b = alpha[i, j], total[i, 0] - alpha[i, j]
            s = total[i, 0]
            low, high = sorted((shares[i, j] * band[0], shares[i, j] * band[1]))
            p = beta_cdf(low, a, b) + 1 - beta_cdf(min(high, 1.0), a, b)
            out.append({"from": f, "to": t, "weight": float(shares[i, j]), "mean": float(a / s), "sd": float(np.sqrt(a * b / (s * s * (s + 1)))), "low": beta_quantile(level / 2, a, b), "high": beta_quantile(1 - level / 2, a, b), "p_value": float(p)})
    return out


def bayes_compare(x: np.ndarray, y: np.ndarray, states: Sequence[str], prior: float = 0.5, draws: int = 4000, ci: float = 0.95, seed: int = 1) -> list[dict]:
    """Posterior differences of two networks' transition shares."""
    rng = np.random.default_rng(seed)
    a, b = x + prior, y + prior
    out = []
    for i, f in enumerate(states):
        for j, t in enumerate(states):
            d = rng.beta(a[i, j], a[i].sum() - a[i, j], draws) - rng.beta(b[i, j], b[i].sum() - b[i, j], draws)
            low, high = np.quantile(d, [(1 - ci) / 2, 1 - (1 - ci) / 2])
            pd_ = max((d > 0).mean(), 1 - (d > 0).mean())
            near = min(abs(low), abs(high))
            out.append({"from": f, "to": t, "difference": float(d.mean()), "low": float(low), "high": float(high), "direction": float(pd_), "p_value": float(2 * (1 - pd_)), "significant": bool(low * high > 0 and abs(d.mean()) > 0.01 and near > 0.001)})
    return out


def vertex_bootstrap(w: np.ndarray, statistics: dict[str, Callable[[np.ndarray], float]], iterations: int = 500, seed: int = 1, level: float = 0.05) -> list[dict]:
    """Statistics of networks on resampled nodes; a node met twice gets a random pair's weight."""
    rng = np.random.default_rng(seed)
    n = len(w)
    off = w[~np.eye(n, dtype=bool)]
    values = {k: [] for k in statistics}
    for _ in range(iterations):
        pick = rng.integers(n, size=n)
        m = w[np.ix_(pick, pick)].astype(float).copy()
        twice = (pick[:, None] == pick) & ~np.eye(n, dtype=bool)
        m[twice] = rng.choice(off, int(twice.sum()))
        for k, f in statistics.items():
            values[k].append(f(m))
    return [{"statistic": k, "observed": float(f(w)), "mean": float(np.mean(values[k])), "sd": float(np.std(values[k], ddof=1)), "low": float(np.quantile(values[k], level / 2)), "high": float(np.quantile(values[k], 1 - level / 2))} for k, f in statistics.items()]
