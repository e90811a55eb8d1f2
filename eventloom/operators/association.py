"""Networks of numeric variables: correlations in one pass of Spark, models on the matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.expressions import average_ranks, bounded
from eventloom.kernels import penalised
from eventloom.kernels.distributions import normal_sf
from eventloom.operators.concordance import kendall
from eventloom.session import ensure_importable


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return out.dropna().where(~F.greatest(*[F.isnan(c).cast("int") for c in columns], F.lit(0)).cast("boolean"))


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with a value and a variance."""
    v = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if v[c] is not None and v[c] > 0]


def correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> tuple[np.ndarray, int]:
    """The correlation matrix of complete rows and their number: one aggregate, p * (p - 1) / 2
    values. Spearman ranks each column first, by counts of its distinct values; Kendall's
    tau-b counts by ranges of values (see concordance)."""
    rows = complete(df, columns)
    if method == "spearman":
        for c in columns:
            ranks = average_ranks(rows, c).select(c, F.col("rank").alias("_r"))
            rows = rows.join(ranks, c).drop(c).withColumnRenamed("_r", c)
    if method == "kendall":
        r = np.eye(len(columns))
        for i in range(len(columns)):
            for j in range(i):
                r[i, j] = r[j, i] = kendall(rows, columns[i], columns[j])
        return r, rows.count()
    if len(columns) > WIDE:
        return _wide_correlations(rows, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    x = rows.agg(F.count(F.lit(1)).alias("n"), *[F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(columns))
    for i, j in pairs:
        r[i, j] = r[j, i] = x[f"c{i}_{j}"]
    return r, x.n


#: Beyond so many columns one aggregate for each pair would be too much code for a plan.
WIDE = 12


def _wide_correlations(rows: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """The same from a matrix of products, which tasks add up a batch at a time."""
    ensure_importable(rows.sparkSession)
    about = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    center, p = np.array([about[f"m{i}"] or 0.0 for i in range(len(columns))]), len(columns)

    def run(batches):
        total = np.zeros((p, p))
        for b in batches:
            if b.num_rows:
                z = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)]) - center
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["sums"])

    cells = rows.select(*columns).mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    flat = np.zeros(p * p)
    for r in cells.groupBy("at").agg(F.sum("x").alias("x")).collect():  # columns squared
        flat[r["at"]] = r.x
    m = flat.reshape(p, p)
    d = np.sqrt(np.maximum(np.diag(m), 1e-300))
    return m / np.outer(d, d), about.n


def network(df: DataFrame, columns: Sequence[str], method: str = "cor", threshold: float = 0.0, **params) -> list[dict]:
    """Undirected edges by cor, pcor or glasso (information criterion)."""
    columns = varying(df, columns)
    r, n = correlations(df, columns, params.pop("cor_method", "pearson"))
    m = r - np.eye(len(r)) if method == "cor" else penalised.partial_correlations(r) if method == "pcor" else penalised.sparse_partial(r, n, **params)[0]
    return [{"from": columns[j], "to": columns[i], "weight": float(m[i, j])} for i in range(len(r)) for j in range(i) if abs(m[i, j]) > threshold]


def between_within(df: DataFrame, id_column: str, columns: Sequence[str], level: str) -> DataFrame:
    """Persons' means (between), or rows less their person's mean for persons with two rows
    or more (within)."""
    if level == "between":
        return df.groupBy(id_column).agg(*[F.avg(c).alias(c) for c in columns])
    w = Window.partitionBy(id_column)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 2").select(id_column, *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in columns])


def lagged_grid(df: DataFrame, id_column: str, day: str, beep: str, columns: Sequence[str], lag: int = 1) -> DataFrame:
    """Rows of a panel on the full grid of beeps of each person and day, with values a lag
    before (inside the day), centred on the person, and the person's means: complete rows."""
    keys = [id_column, day]
    grid = df.groupBy(*keys).agg(F.min(beep).alias("lo"), F.max(beep).alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi")).alias(beep))
    rows = grid.join(df.select(*keys, beep, *columns).dropDuplicates([*keys, beep]), [*keys, beep], "left")
    by, person = Window.partitionBy(*keys).orderBy(beep), Window.partitionBy(id_column)
    rows = rows.select("*", *[F.lag(c, lag).over(by).alias(f"lag_{c}") for c in columns])
    rows = rows.select(*keys, beep, *columns, *[(F.col(f"lag_{c}") - F.avg(f"lag_{c}").over(person)).alias(f"lag_{c}") for c in columns], *[F.avg(c).over(person).alias(f"mean_{c}") for c in columns])
    return rows.dropna(subset=[*columns, *[f"lag_{c}" for c in columns]])


def panel_moments(rows: DataFrame, id_column: str, design: Sequence[str]) -> tuple[np.ndarray, list[tuple[float, float, np.ndarray, np.ndarray]]]:
    """Sums of products of design over all rows, and for each number of rows a person can have:
    that number, the persons, and the sums of their sums and of products of these. A random
    intercept's likelihood needs no more, and no more leaves Spark, however many persons."""
    d = len(design)
    cells = [(i, j) for i in range(d) for j in range(i + 1)]
    square = lambda x: np.array([[x[f"m{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(d)] for i in range(d)], float)
    whole = rows.agg(*[F.sum(F.col(design[i]) * F.col(design[j])).alias(f"m{i}_{j}") for i, j in cells]).first()
    per = rows.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(design)])
    kinds = per.groupBy("n").agg(F.count(F.lit(1)).alias("persons"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in cells])
    return square(whole), [(float(x.n), float(x.persons), np.array([x[f"s{i}"] for i in range(d)], float), square(x)) for x in bounded(kinds.orderBy("n"), 100_000, "lengths of series")]


def random_intercept(whole: np.ndarray, kinds: list, x: list[int], y: int) -> dict:
    """Maximum likelihood of y on columns x with an intercept for each person: coefficients,
    their standard errors, residual deviation, and the ratio of variances (0 if none helps)."""
    rows = sum(n * k for n, k, _, _ in kinds)

    def fit(ratio):
        xx, xy, yy, penalty = whole[np.ix_(x, x)].copy(), whole[x, y].copy(), whole[y, y], 0.0
        for n, k, _, m in kinds:
            shrink = ratio / (1 + n * ratio)
            xx -= shrink * m[np.ix_(x, x)]
            xy -= shrink * m[x, y]
            yy -= shrink * m[y, y]
            penalty += k * np.log1p(n * ratio)
        b = np.linalg.lstsq(xx, xy, rcond=None)[0]
        rss = max(yy - b @ xy, 1e-300)
        return rows * np.log(rss / rows) + penalty, b, rss, xx

    low, high = -14.0, 8.0
    for _ in range(80):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if fit(np.exp(a))[0] < fit(np.exp(b))[0] else (a, high)
    ratio = float(np.exp((low + high) / 2))
    if fit(0.0)[0] <= fit(ratio)[0]:
        ratio = 0.0
    _, b, rss, xx = fit(ratio)
    sigma2 = rss / rows
    return {"beta": b, "se": np.sqrt(np.maximum(sigma2 * np.diag(np.linalg.pinv(xx)), 0)), "sigma": float(np.sqrt(sigma2)), "ratio": ratio}


def multilevel_lag_network(df: DataFrame, id_column: str, day: str, beep: str, columns: Sequence[str], lag: int = 1) -> dict:
    """Temporal coefficients (outcome x predictor), contemporaneous partial correlations of
    residuals, partial correlations between persons, and a table of coefficients.

    Each outcome is modelled on all lagged columns, centred on the person, and on the persons'
    means of the other columns, with a random intercept. Networks: the lagged effects; the
    residuals', persons' intercepts taken off; and, from the effects G of the means and the
    variances v of the intercepts, what (I - G) / v says of the means. Without variance of
    some intercept the last is 0."""
    p = len(columns)
    design = ["one", *[f"lag_{c}" for c in columns], *[f"mean_{c}" for c in columns], *columns]
    whole, kinds = panel_moments(lagged_grid(df, id_column, day, beep, columns, lag).withColumn("one", F.lit(1.0)), id_column, design)
    temporal, means, spread, table, fits = np.zeros((p, p)), np.zeros((p, p)), np.zeros(p), [], []
    for o in range(p):
        x = [0, *range(1, p + 1), *[p + 1 + j for j in range(p) if j != o]]
        found = random_intercept(whole, kinds, x, 2 * p + 1 + o)
        fits.append((x, found))
        temporal[o] = found["beta"][1 : p + 1]
        means[o, [j for j in range(p) if j != o]] = found["beta"][p + 1 :]
        spread[o] = found["sigma"] * math.sqrt(found["ratio"])
        for j, c in enumerate(columns):
            beta, se = float(found["beta"][1 + j]), float(found["se"][1 + j])
            t = beta / se if se else math.nan
            table.append({"outcome": columns[o], "predictor": c, "beta": beta, "se": se, "t": t, "p": float(2 * normal_sf(abs(t))), "low": beta - 1.959963984540054 * se, "high": beta + 1.959963984540054 * se})
    # residuals as rows times contrasts, less the intercepts, which are shares of persons' sums
    contrast = np.zeros((p, len(design)))
    for o, (x, found) in enumerate(fits):
        contrast[o, x] = -found["beta"]
        contrast[o, 2 * p + 1 + o] = 1.0
    ratios = np.array([found["ratio"] for _, found in fits])
    products, sums, rows = contrast @ whole @ contrast.T, np.zeros(p), 0.0
    for n, k, s, m in kinds:
        share, own = ratios / (1 + n * ratios), contrast @ m @ contrast.T
        products += (n * np.outer(share, share) - share[:, None] - share) * own
        sums += (1 - n * share) * (contrast @ s)
        rows += n * k
    residual = products - np.outer(sums, sums) / max(rows, 1.0)
    return {"temporal": temporal, "contemporaneous": penalised.precision_to_partial(np.linalg.pinv(residual)), "between": _between(means, spread), "coefficients": table}


def _between(effects: np.ndarray, spread: np.ndarray) -> np.ndarray:
    if (spread == 0).any():
        return np.zeros_like(effects)
    inverse = (np.eye(len(spread)) - effects) / spread[:, None] ** 2
    inverse = (inverse + inverse.T) / 2
    least = np.linalg.eigvalsh(inverse).min()
    if least < 0:  # the shift that the published estimator makes, off the diagonal too
        inverse = inverse - least * np.eye(len(spread)) + 0.001
    return penalised.precision_to_partial(np.linalg.pinv(np.linalg.pinv(inverse)))


def magnitude_difference(df: DataFrame, seq: Sequence[str]) -> DataFrame:
    """from, to, count_share, probability, difference: how large an edge is among all pairs
    against how likely it is from its state."""
    from eventloom.operators.transitions import frequency

    e = frequency(df, seq)
    p = F.col("weight") / F.sum("weight").over(Window.partitionBy("from"))
    c = F.col("weight") / F.max("weight").over(Window.partitionBy())
    return e.select("from", "to", c.alias("count_share"), p.alias("probability"), F.abs(c - p).alias("difference"))
