"""Grouping sequences: distances between them, clusters, mixtures of chains, and diagnostics.

Distances are rows (a, b, d) for pairs of *distinct* state strings: equal sequences are one
to begin with, with a count. Clustering by distances is quadratic by nature, so it asks for
a bound on the distinct sequences; mixtures of chains are linear and take any number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.expressions import average_ranks, bounded
from eventloom.session import ensure_importable

#: Distinct sequences that are clustered by their distances, and kinds of sequences that a
#: mixture is fitted to: their matrices are one machine's work.
MOST_SEQUENCES, MOST_KINDS = 5000, 200000
#: Code points that stand for states in one-character-a-state strings.
FIRST_SYMBOL = 0x100


def as_strings(trails: DataFrame, seq: Sequence[str], states: Sequence[str]) -> DataFrame:
    """text (one character for each state), n (sequences that have it), first (least key)."""
    code = F.create_map(*[x for i, s in enumerate(states) for x in (F.lit(s), F.lit(chr(FIRST_SYMBOL + i)))])
    text = F.array_join(F.transform("states", lambda x: code[x]), "")
    return trails.select(text.alias("text"), F.struct(*seq).alias("key")).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))


def _osa(a: str, b: str, transpose: bool = True) -> int:
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if transpose and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def _damerau(a: str, b: str) -> int:
    """Edits with transpositions of any two symbols, which further edits may come between."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), at
            if x == y:
                at = j
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[len(a), len(b)]


def _lcs(a: str, b: str) -> int:
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
        last = row
    return len(a) + len(b) - 2 * last[-1]


def _jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if not a or not b:
        return float(a != b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, common = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                common.append(x)
                break
    if not common:
        return 1.0
    other = [b[j] for j in range(len(b)) if taken[j]]
    m, t = len(common), sum(x != y for x, y in zip(common, other, strict=True)) / 2
    s = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return 1 - (s + prefix * weight * (1 - s))


EDITS = {"osa": _osa, "dl": _damerau, "lcs": _lcs, "jw": _jaro_winkler}


def _profile(text: Column, q: int) -> Column:
    return F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - (q - 1)), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def distances(texts: DataFrame, kind: str = "hamming", q: int = 2, decay: float | None = None, queries: DataFrame | None = None) -> DataFrame:
    """a < b, d for all pairs of texts, or, with queries (texts), a and d to each other text b
    for each query a. The pairs are the result, so their number is the caller's to bound."""
    ensure_importable(texts.sparkSession)
    x, y = (texts if queries is None else queries).select(F.col("text").alias("a")), texts.select(F.col("text").alias("b"))
    both = x.join(y, F.col("a") < F.col("b") if queries is None else F.col("a") != F.col("b"))
    if kind == "hamming":
        n = F.greatest(F.length("a"), F.length("b"))
        at = F.sequence(F.lit(1), n)
        cost = lambda i: F.exp(-decay * (i - 1)) if decay else F.lit(1.0)
        gap = F.aggregate(at, F.lit(0.0), lambda s, i: s + F.when(F.substring(F.col("a"), i, F.lit(1)) != F.substring(F.col("b"), i, F.lit(1)), cost(i)).otherwise(0.0))
        return both.select("a", "b", gap.alias("d"))
    if kind == "lv":
        return both.select("a", "b", F.levenshtein("a", "b").cast("double").alias("d"))
    if kind == "jaccard":
        p, r = _profile(F.col("a"), q), _profile(F.col("b"), q)
        union = F.size(F.array_union(p, r))
        return both.select("a", "b", F.when(union > 0, 1 - F.size(F.array_intersect(p, r)) / union).otherwise(0.0).alias("d"))
    if kind in ("qgram", "cosine"):
        counts = texts.select("text", F.explode(_profile(F.col("text"), q)).alias("gram")).groupBy("text", "gram").agg(F.count(F.lit(1)).alias("c"))
        norms = counts.groupBy("text").agg(F.sum("c").alias("n"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("r"))
        meet = counts.toDF("a", "gram", "ca").join(counts.toDF("b", "gram", "cb"), "gram").where("a <> b").groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("least"), F.sum(F.col("ca") * F.col("cb")).alias("dot"))
        full = both.join(meet, ["a", "b"], "left").join(norms.toDF("a", "na", "ra"), "a", "left").join(norms.toDF("b", "nb", "rb"), "b", "left").na.fill(0)
        d = F.col("na") + F.col("nb") - 2 * F.col("least") if kind == "qgram" else 1 - F.col("dot") / F.when(F.col("ra") * F.col("rb") == 0, 1).otherwise(F.col("ra") * F.col("rb"))
        return full.select("a", "b", d.cast("double").alias("d"))
    edit = EDITS[kind]

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(edit(s, t)) for s, t in zip(a, b, strict=True)])

    return both.select("a", "b", run("a", "b").alias("d"))


def distance_matrix(texts: DataFrame, kind: str = "lv") -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct texts (text, n) in order, how often each is there, and their distances."""
    rows = sorted(bounded(texts.select("text", "n"), MOST_SEQUENCES, "distinct sequences"))
    names = [r.text for r in rows]
    pairs = distances(texts, kind).toPandas()
    at = pd.Series(range(len(names)), index=names)
    d = np.zeros((len(names), len(names)))
    i, j = at[pairs.a].to_numpy(), at[pairs.b].to_numpy()
    d[i, j] = d[j, i] = pairs.d.to_numpy()
    return names, np.array([r.n for r in rows]), d


def matrix(texts: list[str], rows: list) -> np.ndarray:
    at = {t: i for i, t in enumerate(texts)}
    d = np.zeros((len(texts), len(texts)))
    for r in rows:
        d[at[r.a], at[r.b]] = d[at[r.b], at[r.a]] = r.d
    return d


def pam(d: np.ndarray, k: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Medoids and labels: greedy build, then the best swap as long as one helps."""
    n = len(d)
    w = np.ones(n) if weight is None else weight
    chosen = [int(np.argmin(w @ d))]
    while len(chosen) < k:
        near = d[:, chosen].min(1)
        gain = (w[:, None] * np.maximum(near[:, None] - d, 0)).sum(0)
        gain[chosen] = -1
        chosen.append(int(np.argmax(gain)))
    total = (w * d[:, chosen].min(1)).sum()
    while True:
        best = (total, None)
        for i in range(k):
            rest = d[:, [c for j, c in enumerate(chosen) if j != i]].min(1) if k > 1 else np.full(n, np.inf)
            cost = (w[:, None] * np.minimum(rest[:, None], d)).sum(0)
            cost[chosen] = np.inf
            j = int(np.argmin(cost))
            if cost[j] < best[0] - 1e-12:
                best = (cost[j], (i, j))
        if best[1] is None:
            break
        chosen[best[1][0]] = best[1][1]
        total = best[0]
    chosen = sorted(chosen)
    return np.array(chosen), d[:, chosen].argmin(1)


def linkage(d: np.ndarray, k: int, method: str = "ward.D2", weight: np.ndarray | None = None) -> np.ndarray:
    """Labels of k clusters by merging the nearest two: the update rules of Lance and Williams."""
    n = len(d)
    size = (np.ones(n) if weight is None else weight.astype(float)).copy()
    m = d.astype(float).copy()
    if method in ("ward.D2", "centroid", "median"):
        m = m**2
    if method.startswith("ward"):  # what merging so many equal ones would have made of it
        m *= 2 * np.outer(size, size) / np.add.outer(size, size)
    np.fill_diagonal(m, np.inf)
    members = [[i] for i in range(n)]
    live = list(range(n))
    while len(live) > k:
        sub = m[np.ix_(live, live)]
        i, j = divmod(int(np.argmin(sub)), len(live))
        i, j = live[min(i, j)], live[max(i, j)]
        others = [x for x in live if x not in (i, j)]
        a, b, c = size[i], size[j], size[others]
        x, y, z = m[i, others], m[j, others], m[i, j]
        if method == "single":
            new = np.minimum(x, y)
        elif method == "complete":
            new = np.maximum(x, y)
        elif method == "average":
            new = (a * x + b * y) / (a + b)
        elif method == "mcquitty":
            new = (x + y) / 2
        elif method == "median":
            new = (x + y) / 2 - z / 4
        elif method == "centroid":
            new = (a * x + b * y) / (a + b) - a * b * z / (a + b) ** 2
        else:  # ward.D, ward.D2
            new = ((a + c) * x + (b + c) * y - c * z) / (a + b + c)
        m[i, others] = m[others, i] = new
        size[i] += size[j]
        members[i] += members[j]
        live.remove(j)
    out = np.zeros(n, int)
    for label, i in enumerate(sorted(live, key=lambda i: min(members[i]))):
        out[members[i]] = label
    return out


def silhouette(d: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    w = np.ones(len(d)) if weight is None else weight.astype(float)
    sums = np.stack([(d * w * (labels == c)).sum(1) for c in range(labels.max() + 1)], 1)
    size = np.array([w[labels == c].sum() for c in range(labels.max() + 1)])
    own = size[labels] - 1
    a = np.where(own > 0, sums[np.arange(len(d)), labels] / np.maximum(own, 1), 0)
    means = sums / np.maximum(size, 1)
    means[np.arange(len(d)), labels] = np.inf
    b = means.min(1)
    return np.where((own > 0) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)


def chain_mixture(counts: np.ndarray, first: np.ndarray, k: int, starts: int = 10, steps: int = 200, tol: float = 1e-6, smooth: float = 0.01, seed: int = 1, weight: np.ndarray | None = None) -> dict:
    """Mixture of Markov chains by expectation-maximisation over sequences' pair counts
    (n x S x S) and first states: shares, chains, posteriors, log-likelihood, AIC, BIC."""
    n, s, _ = counts.shape
    w = np.ones(n) if weight is None else weight.astype(float)
    flat, start = counts.reshape(n, -1), np.eye(s)[first]
    best = None
    for r in range(starts):
        post = np.random.default_rng((seed, r)).dirichlet(np.ones(k), n)
        last = -math.inf
        for _ in range(steps):
            pw = post * w[:, None]
            mix = pw.sum(0) / w.sum()
            p = (pw.T @ flat).reshape(k, s, s) + smooth
            p /= p.sum(2, keepdims=True)
            init = pw.T @ start + smooth
            init /= init.sum(1, keepdims=True)
            logs = flat @ np.log(np.maximum(p, 1e-300)).reshape(k, -1).T + start @ np.log(np.maximum(init, 1e-300)).T + np.log(np.maximum(mix, 1e-300))
            top = logs.max(1, keepdims=True)
            lse = top[:, 0] + np.log(np.exp(logs - top).sum(1))
            post = np.exp(logs - lse[:, None])
            ll = float(w @ lse)
            if abs(ll - last) < tol:
                break
            last = ll
        if best is None or ll > best["log_likelihood"]:
            best = {"log_likelihood": ll, "share": mix, "chains": p, "initial": init, "posterior": post}
    free = k * s * (s - 1) + k * (s - 1) + k - 1
    best |= {"aic": 2 * free - 2 * best["log_likelihood"], "bic": free * math.log(w.sum()) - 2 * best["log_likelihood"], "labels": best["posterior"].argmax(1)}
    e = -w @ (best["posterior"] * np.log(np.maximum(best["posterior"], 1e-300))).sum(1)
    best["entropy"] = 1 - float(e / (w.sum() * math.log(k))) if k > 1 else 1.0
    return best


def mixture_counts(df: DataFrame, seq: Sequence[str], states: Sequence[str]) -> DataFrame:
    """first, counts (S * S), n: sequences of equal counts and first state are one row, so what
    a mixture is fitted to grows with the kinds of sequences and not with their number."""
    from eventloom.operators.resampling import sequence_counts

    rows = sequence_counts(df, seq, states)
    at = F.when(F.col("state").isNotNull(), F.col("pos"))
    first = df.groupBy(*seq).agg(F.min_by("state", at).alias("first"))
    return rows.join(first, list(seq)).groupBy("first", "counts").agg(F.count(F.lit(1)).alias("n"))


def profiles(df: DataFrame, cluster: str, numbers: Sequence[str] = (), labels: Sequence[str] = ()) -> tuple[DataFrame, DataFrame | None]:
    """Means, deviations and medians of numbers by cluster, and counts and shares of labels."""
    a = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{c}") for c in numbers for name, f in (("mean", F.avg), ("sd", F.stddev_samp), ("median", F.median))])
    b = None
    for c in labels:
        part = df.where(F.col(c).isNotNull()).groupBy(cluster, F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("count"))
        part = part.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(cluster)))
        b = part if b is None else b.unionByName(part)
    return a, b


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, count, expected, residual (standardised), of two categorical columns."""
    c = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy
    r, k, t = F.sum("count").over(w("row")), F.sum("count").over(w("column")), F.sum("count").over(w())
    e = r * k / t
    return c.select("row", "column", "count", e.alias("expected"), ((F.col("count") - e) / F.sqrt(e * (1 - r / t) * (1 - k / t))).alias("residual"))


def chi_square(cells: DataFrame) -> dict:
    """Statistic, freedom, p and Cramer's V of contingency()."""
    from eventloom.kernels.distributions import chi2_sf

    x = cells.agg(F.sum("count").alias("n"), F.sum(F.pow(F.col("count") - F.col("expected"), 2) / F.col("expected")).alias("seen"), F.sum("expected").alias("e"), F.countDistinct("row").alias("r"), F.countDistinct("column").alias("c")).first()
    stat = x.seen + (x.n - x.e)  # cells without cases add their expectation
    df = (x.r - 1) * (x.c - 1)
    return {"statistic": stat, "df": df, "p_value": chi2_sf(stat, df) if df else None, "cramers_v": math.sqrt(stat / (x.n * max(1, min(x.r, x.c) - 1)))}


def rank_test(df: DataFrame, group: str, value: str) -> dict:
    """Kruskal and Wallis' H with tie correction, its p and eta squared."""
    from eventloom.kernels.distributions import chi2_sf

    ranks = average_ranks(df, value)
    g = bounded(df.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n")), 10_000, "groups")
    n = sum(x.n for x in g)
    ties = ranks.agg(F.sum(F.pow("count", 3) - F.col("count"))).first()[0] or 0.0
    h = (12 / (n * (n + 1)) * sum(x.r**2 / x.n for x in g) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return {"statistic": h, "df": len(g) - 1, "p_value": chi2_sf(h, len(g) - 1), "eta_squared": max(0.0, min(1.0, h / (n - 1)))}
