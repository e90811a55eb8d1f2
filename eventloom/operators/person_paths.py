"""Path models of each person's series, with paths that most persons share.

A person's variables are regressed on one another and on themselves a step before. First
paths are added for all: in each round every person's model is fitted and names what each
missing path would gain, and the path that enough persons gain significantly from is added,
until there is none; paths that too few keep significant are taken out again. Then each
person's own paths are added as long as the model doesn't fit well.

A person's series enters as its covariances with its past, sums that Spark aggregates, so no
person's rows meet in one place. A round is one pass over persons, whose small models are
fitted side by side; of it one row comes to the driver, the round's best path.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.kernels.distributions import chi2_quantile
from eventloom.kernels.paths import PathModels
from eventloom.session import ensure_importable
from eventloom.storage import written

#: What counts as an excellent fit, by measure, and how many of these are enough.
CUTOFFS = {"rmsea": 0.05, "srmr": 0.05, "nnfi": 0.95, "cfi": 0.95}
EXCELLENT = 2
#: Persons whose models are fitted side by side.
BATCH = 1000


def person_moments(df: DataFrame, person: str, time: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """person, n, cov (array, 2 p squared): covariances of the columns and of themselves a row
    before, of rows that have all of them; persons with two such rows or more, whose variables vary."""
    p = len(columns)
    by = Window.partitionBy(person).orderBy(*time)
    rows = df.select(person, *time, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    rows = rows.select(person, *[f"v{i}" for i in range(p)], *[F.lag(f"v{i}").over(by).alias(f"v{p + i}") for i in range(p)])
    rows = rows.dropna(subset=[f"v{i}" for i in range(2 * p)]).where(F.col(person).isNotNull())
    cells = [(i, j) for i in range(2 * p) for j in range(i + 1)]
    per = rows.groupBy(F.col(person).alias("person")).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in cells])
    cov = F.array(*[F.col(f"c{max(i, j)}_{min(i, j)}") for i in range(2 * p) for j in range(2 * p)])
    varies = [F.col(f"c{i}_{i}") > 0 for i in range(2 * p)]
    keep = F.col("n") >= 2
    for v in varies:
        keep = keep & v
    return per.where(keep).select("person", "n", cov.alias("cov"))


def candidate_paths(p: int, exogenous: Sequence[int] = (), fixed: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """All paths there could be: to each outcome from the others and from all a step before."""
    return [(i, j) for i in range(p) if i not in exogenous for j in range(2 * p) if i != j and (i, j) not in fixed]


def _models(pdf: pd.DataFrame, p: int, exogenous: Sequence[int], all_: Sequence[tuple[int, int]], free: np.ndarray) -> PathModels:
    """Persons' models, of which all may have the paths all_ and have those that are free."""
    at = _places(p, exogenous)
    order = sorted(at, key=at.get)
    cov = np.array(pdf["cov"].tolist(), float).reshape(-1, 2 * p, 2 * p)
    return PathModels(cov[:, order][:, :, order], pdf["n"].to_numpy(), p - len(exogenous), [(at[i], at[j]) for i, j in all_], np.broadcast_to(free, (len(cov), len(all_))))


def _places(p: int, exogenous: Sequence[int]) -> dict[int, int]:
    """Where variables are in a model: outcomes first, then exogenous ones and the past."""
    order = [i for i in range(p) if i not in exogenous] + list(exogenous) + list(range(p, 2 * p))
    return {v: k for k, v in enumerate(order)}


def _search(m: PathModels, cutoff: float, z_cut: float, cutoffs: dict, excellent: int) -> np.ndarray:
    """Adds persons' own paths to models that have those of all: for each the round in
    which it came, 0 if none. All persons take a step at once: m.converged tells which have a model."""
    added, barred = np.zeros(m.free.shape, int), np.zeros(m.free.shape, bool)
    left, turn = np.flatnonzero(m.converged), 0
    while len(left):
        turn += 1
        now = m.of(left)
        fits = now.fit_measures()
        good = np.sum([fits[k] <= c if k in ("rmsea", "srmr") else fits[k] >= c for k, c in cutoffs.items()], axis=0) if cutoffs else np.zeros(len(left), int)
        could = ~now.free & ~barred[left]
        full = (good >= excellent) | ~could.any(1) | (fits["df"] <= 0)
        # a path that is weak at the end is taken out, and not tried again
        z = np.where(full[:, None] & (added[left] > 0), np.abs(now.z()), np.inf)
        gains = np.where(could & ~full[:, None], now.modification(), -1.0)
        path = np.where(full, z.argmin(1), gains.argmax(1))
        each = np.arange(len(left))
        go = np.where(full, z[each, path] < z_cut, gains[each, path] >= cutoff)
        left, path, full = left[go], path[go], full[go]
        free = m.free[left]
        free[np.arange(len(left)), path] = ~full
        new = PathModels(m.s[left], m.n[left], m.p, m.paths, free)
        fine = full | (new.converged & new.stable())
        m.put(left[fine], new, fine)
        barred[left[full | ~fine], path[full | ~fine]] = True
        added[left[fine], path[fine]] = np.where(full[fine], 0, turn)
        left = left[m.converged[left]]
    return added


def _batches(frames, most: int = BATCH):
    for pdf in frames:
        for k in range(0, len(pdf), most):
            yield pdf.iloc[k : k + most]


def shared_paths(moments: DataFrame, p: int, fixed: Sequence[tuple[int, int]], exogenous: Sequence[int] = (), share: float = 0.75) -> list[tuple[int, int]]:
    """The paths that enough persons have, in the order they were found."""
    ensure_importable(moments.sparkSession)
    persons = moments.count()
    if not persons:
        return []
    cutoff, z_cut = chi2_quantile(1 - 0.05 / persons, 1), abs(NormalDist().inv_cdf(0.025 / persons))
    found: list[tuple[int, int]] = []

    def round_of(paths, asked, gains: bool):
        all_ = [*paths, *(a for a in asked if a not in paths)]
        which = [all_.index(a) for a in asked]

        def run(frames):
            for pdf in _batches(frames):
                m = _models(pdf, p, exogenous, all_, np.arange(len(all_)) < len(paths))
                m = m.of(np.flatnonzero(m.converged))
                x = (m.modification() if gains else np.abs(m.z()))[:, which]
                yield pd.DataFrame({"at": np.tile(np.arange(len(which)), len(x)), "x": x.reshape(-1)})

        rows = moments.mapInPandas(run, "at int, x double").groupBy("at")
        if gains:
            return rows.agg(F.count_if(F.col("x") >= cutoff).alias("k"), F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("k"), F.desc("mean"), "at").first()
        return rows.agg(F.count_if(F.col("x") < z_cut).alias("k"), F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("k"), "mean", "at").first()

    while left := [c for c in candidate_paths(p, exogenous, fixed) if c not in found]:
        best = round_of([*fixed, *found], left, True)
        if best is None or best.n <= persons / 2 or best.k <= share * best.n:
            break
        found.append(left[best["at"]])
    while found:
        worst = round_of([*fixed, *found], found, False)
        if worst is None or worst.k <= (1 - share) * worst.n:
            break
        del found[worst["at"]]
    return found


def person_paths(df: DataFrame, person: str, time: Sequence[str], columns: Sequence[str], own_past: bool = True, paths: Sequence[tuple[str, str, int]] = (), exogenous: Sequence[str] = (), share: float = 0.75, cutoffs: dict[str, float] | None = None, excellent: int = EXCELLENT) -> DataFrame:
    """person, outcome, predictor, lag (1: a row before), level (fixed, group or own), estimate
    (in deviations), and the person's chisq, df, rmsea, srmr, nnfi, cfi.

    own_past: each variable depends on itself a row before; paths: more that all persons have,
    as (outcome, predictor, lag); exogenous: variables that nothing predicts; share: of persons
    that a path of the group needs. Persons whose model can't be fitted have no rows."""
    columns, p = list(columns), len(columns)
    exo = [columns.index(c) for c in exogenous]
    if len(exo) == p or p < 2:
        raise ValueError("two variables are needed, and one that isn't exogenous")
    fixed = list(dict.fromkeys([*((i, p + i) for i in range(p) if own_past and i not in exo), *((columns.index(o), columns.index(x) + p * lag) for o, x, lag in paths)]))
    # a person's search takes a while and its covariances few bytes: spread persons, not bytes
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    moments = written(person_moments(df, person, time, columns).repartition(tasks, "person"))
    group = shared_paths(moments, p, fixed, exo, share)
    candidates = candidate_paths(p, exo, fixed)
    cutoff = chi2_quantile(1 - 0.05 / max(1, len(candidates)), 1)
    z_cut = abs(NormalDist().inv_cdf(0.05 / max(1, len(candidates))))
    limits = cutoffs or CUTOFFS
    measures = ("chisq", "df", "rmsea", "srmr", "nnfi", "cfi")

    all_ = [*fixed, *group, *(c for c in candidates if c not in group)]
    given = len(fixed) + len(group)
    at = _places(p, exo)

    def run(frames):
        for pdf in _batches(frames):
            m = _models(pdf, p, exo, all_, np.arange(len(all_)) < given)
            added = _search(m, cutoff, z_cut, limits, excellent)
            beta, fits = m.standardised(), m.fit_measures()
            # rows by person: paths of all, then own ones as they came
            rank = np.where(m.free & m.converged[:, None], np.where(added > 0, given + added, np.arange(len(all_))), -1)
            who, path = np.nonzero(rank >= 0)
            order = np.lexsort((rank[who, path], who))
            who, path = who[order], path[order]
            i, j = np.array([x for x, _ in all_], int)[path], np.array([x for _, x in all_], int)[path]
            place, name = np.array([at[x] for x in range(2 * p)]), np.array(columns, object)
            level = np.where(path < len(fixed), "fixed", np.where(path < given, "group", "own")).astype(object)
            out = {"person": pdf["person"].to_numpy()[who], "outcome": name[i], "predictor": name[j % p], "lag": (j >= p).astype(np.int32), "level": level, "estimate": beta[who, place[i], place[j]]}
            yield pd.DataFrame(out | {k: fits[k][who] for k in measures})

    kind = df.schema[person].dataType.simpleString()
    return moments.mapInPandas(run, f"person {kind}, outcome string, predictor string, lag int, level string, estimate double, " + ", ".join(f"{k} double" for k in measures))


def path_shares(found: DataFrame) -> DataFrame:
    """outcome, predictor, lag, level, persons, share, mean_estimate over persons."""
    all_ = found.agg(F.countDistinct("person").alias("_all"))
    per = found.groupBy("outcome", "predictor", "lag", "level").agg(F.countDistinct("person").alias("persons"), F.avg("estimate").alias("mean_estimate"))
    both = per.withColumn("_one", F.lit(1)).join(all_.withColumn("_one", F.lit(1)), "_one")
    return both.select("outcome", "predictor", "lag", "level", "persons", (F.col("persons") / F.col("_all")).alias("share"), "mean_estimate")
