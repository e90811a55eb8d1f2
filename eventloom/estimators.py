"""The registry of network estimators, and the front door that runs one by name.

An estimator takes long sequences (or a numeric frame) and returns edges from, to, weight.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.expressions import bounded
from eventloom.kernels import penalised
from eventloom.operators import association, networks, sequences, transitions
from eventloom.storage import written


@dataclass(frozen=True)
class Estimator:
    name: str
    run: Callable[..., DataFrame]
    description: str
    directed: bool


_ESTIMATORS: dict[str, Estimator] = {}
#: Other names that users type for the methods.
ALIASES = {
    "tna": "relative",
    "transition": "relative",
    "ftna": "frequency",
    "counts": "frequency",
    "atna": "attention",
    "cna": "co_occurrence",
    "cooccurrence": "co_occurrence",
    "corr": "cor",
    "correlation": "cor",
    "partial": "pcor",
    "ebicglasso": "glasso",
    "regularized": "glasso",
    "isingfit": "ising",
    "mixed": "mgm",
    "onehot": "wtna",
}


def register_estimator(name: str, run: Callable[..., DataFrame], description: str = "", directed: bool = True) -> None:
    _ESTIMATORS[name] = Estimator(name, run, description, directed)


def get_estimator(name: str) -> Estimator:
    name = ALIASES.get(name, name)
    if name not in _ESTIMATORS:
        raise KeyError(f"no estimator {name!r}; there are {', '.join(sorted(_ESTIMATORS))}")
    return _ESTIMATORS[name]


def remove_estimator(name: str) -> None:
    get_estimator(name)
    del _ESTIMATORS[name]


def list_estimators() -> list[Estimator]:
    return [_ESTIMATORS[k] for k in sorted(_ESTIMATORS)]


#: Groups that one call makes networks of.
MOST_GROUPS = 1000


def build_network(df: DataFrame, method: str = "relative", seq: Sequence[str] = (), start: str | None = None, end: str | None = None, scaling: str | None = None, threshold: float = 0.0, group: str | None = None, level: str | None = None, id_column: str | None = None, **params) -> DataFrame:
    """Edges of the network that `method` makes of df: markers first, then the estimator,
    then scaling and the threshold.

    group: a network for each of its values, all over the same nodes, those of any group; the
    result has the column `group`, and weight 0 where a group lacks an edge. level: `between`
    (persons' means) or `within` (deviations from these) of numeric columns, by id_column."""
    if group is not None:
        return _by_group(df, group, method=method, seq=seq, start=start, end=end, scaling=scaling, threshold=threshold, level=level, id_column=id_column, **params)
    estimator = get_estimator(method)
    if level is not None:
        if id_column is None or "columns" not in params:
            raise ValueError("a level needs id_column and columns")
        df = association.between_within(df.select(id_column, *params["columns"]), id_column, params["columns"], level)
    if (start or end) and seq:
        df = sequences.with_markers(df, seq, start, end)
    edges = estimator.run(df, seq, **params) if seq else estimator.run(df, **params)
    if scaling:
        edges = networks.scaled(edges, scaling)
    return networks.threshold(edges, threshold) if threshold else edges


def _by_group(df: DataFrame, group: str, **how) -> DataFrame:
    """The networks of all groups, filled up over the nodes of all of them."""
    kind = df.schema[group].dataType
    values = sorted(r[0] for r in bounded(df.where(F.col(group).isNotNull()).select(group).distinct(), MOST_GROUPS, "groups"))
    found = None
    for v in values:
        part = build_network(df.where(F.col(group) == F.lit(v)), **how).select(F.lit(v).cast(kind).alias("group"), "from", "to", F.col("weight").cast("double").alias("weight"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], f"group {kind.simpleString()}, from string, to string, weight double")
    found = written(found)
    labels = found.select(F.explode(F.array("from", "to")).alias("node")).agg(F.collect_set("node").alias("n"))  # the pooled alphabet
    groups = df.sparkSession.createDataFrame([(v,) for v in values], found.select("group").schema)
    grid = groups.withColumn("_one", F.lit(1)).join(labels.withColumn("_one", F.lit(1)), "_one").select("group", F.explode("n").alias("from"), "n").select("group", "from", F.explode("n").alias("to"))
    return grid.join(found, ["group", "from", "to"], "left").select("group", "from", "to", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def _numeric(method):
    def run(df: DataFrame, columns: Sequence[str], **params) -> DataFrame:
        rows = [(e["from"], e["to"], e["weight"]) for e in association.network(df, columns, method, **params)]
        return df.sparkSession.createDataFrame(rows, "from string, to string, weight double")

    return run


register_estimator("relative", transitions.relative, "shares of transitions from each state")
register_estimator("frequency", transitions.frequency, "counts of transitions")
register_estimator("attention", transitions.attention, "transitions of all distances, decayed")
register_estimator("co_occurrence", transitions.co_occurrence, "pairs of positions of a sequence", directed=False)
register_estimator("windowed", transitions.windowed, "positions of neighbouring windows")
register_estimator("wtna", transitions.window_network, "window network of 0/1 columns")
def _ising(df: DataFrame, columns: Sequence[str], **params) -> DataFrame:
    """Of 0/1 columns: their patterns with counts, at most 2 to the number of columns, are fitted."""
    rows = df.dropna(subset=list(columns)).groupBy(*[F.col(c).cast("int").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    x = np.array([list(r) for r in sorted(bounded(rows, 1 << 16, "patterns"))], float)
    return _undirected(df, columns, penalised.ising(x[:, :-1], weight=x[:, -1], **params))


def _mgm(df: DataFrame, columns: Sequence[str], kinds: Sequence[str], **params) -> DataFrame:
    """kinds: g (numeric) or c (0/1) for each column. Combinations of values with counts are
    fitted; with more than 200,000 of them, round the numeric columns."""
    rows = df.dropna(subset=list(columns)).groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    x = np.array([list(r) for r in sorted(bounded(rows, 200_000, "combinations of values"))], float)
    return _undirected(df, columns, penalised.mixed(x[:, :-1], list(kinds), weight=x[:, -1], **params))


def _undirected(df: DataFrame, columns: Sequence[str], m: np.ndarray) -> DataFrame:
    rows = [(columns[j], columns[i], float(m[i, j])) for i in range(len(m)) for j in range(i) if m[i, j] != 0]
    return df.sparkSession.createDataFrame(rows, "from string, to string, weight double")


register_estimator("ising", _ising, "couplings of 0/1 columns", directed=False)
register_estimator("mgm", _mgm, "mixed numeric and 0/1 columns", directed=False)
for _m, _d in (("cor", "correlations"), ("pcor", "partial correlations"), ("glasso", "sparse partial correlations")):
    register_estimator(_m, _numeric(_m), _d, directed=False)
