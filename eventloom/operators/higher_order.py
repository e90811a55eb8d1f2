"""Longer memory: k-grams of sequences and the models that are made of them.

Inputs are long sequences (seq columns, pos, state). `trails` makes one row for each
sequence with its states as an array; k-grams are slices of it, so a sequence's grams of
any order come from one exchange. What grows with data is counted in Spark; contexts are
bounded by states to the power of the order and go on as DataFrames too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.expressions import benjamini_hochberg
from eventloom.kernels.distributions import chi2_sf, hypergeometric_tails
from eventloom.session import ensure_importable
from eventloom.storage import written


def trails(df: DataFrame, seq: Sequence[str], missing: str = "close", keep: Sequence[str] = ()) -> DataFrame:
    """seq, states. missing: `close` leaves null states out, `trailing` only those at the
    end, `keep` keeps all."""
    items = F.array_sort(F.collect_list(F.struct("pos", "state")))
    states = F.transform(items, lambda x: x["state"])
    out = df.groupBy(*seq, *keep).agg(states.alias("states"))
    if missing == "close":
        out = out.withColumn("states", F.filter("states", lambda x: x.isNotNull()))
    elif missing == "trailing":
        last = F.aggregate(F.transform("states", lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        out = out.withColumn("states", F.slice("states", F.lit(1), last))
    return out.where(F.size("states") > 0)


def collapsed(states: Column) -> Column:
    """Consecutive repeats of a state as one."""
    return F.filter(states, lambda x, i: (i == 0) | (x != F.element_at(states, F.when(i > 0, i).otherwise(1))))


def grams(rows: DataFrame, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """keep, at (from 1), gram: all k consecutive states of each sequence."""
    return rows.where(F.size("states") >= k).select(*keep, "states", F.explode(F.sequence(F.lit(1), F.size("states") - (k - 1))).alias("at")).select(*keep, "at", F.slice("states", F.col("at"), F.lit(k)).alias("gram"))


def path_counts(rows: DataFrame, k: int = 2) -> DataFrame:
    """path, count, proportion of k-grams."""
    found = grams(rows, k).groupBy(F.array_join("gram", " -> ").alias("path")).agg(F.count(F.lit(1)).alias("count"))
    return found.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy()))


def state_frequencies(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """state, count, proportion, over everything or in each group."""
    found = df.where("state IS NOT NULL AND state <> ''").groupBy(*by, "state").agg(F.count(F.lit(1)).alias("count"))
    return found.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def gram_transitions(rows: DataFrame, k: int) -> DataFrame:
    """from, to (k-grams one step apart), count, probability."""
    both = grams(rows, k + 1)
    found = both.select(F.slice("gram", 1, k).alias("from"), F.slice("gram", 2, k).alias("to")).groupBy("from", "to").agg(F.count(F.lit(1)).alias("count"))
    return found.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("from")))


def order_log_likelihood(rows: DataFrame, k: int) -> DataFrame:
    """One row: log_likelihood of all sequences under order k, and the number of states.

    The first state has its share of all states; a later one its share after as many states
    before it as there are, up to k. One count of contexts of each length serves it all."""
    total = F.sum("n").over(Window.partitionBy())
    marginal = rows.select(F.explode("states").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).select("s", F.log(F.col("n") / total).alias("lp"))
    from_marginal = F.explode("states") if k == 0 else F.col("states")[0]
    first = rows.select(from_marginal.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m"))
    out = first.join(marginal, "s").agg(F.sum(F.col("m") * F.col("lp")).alias("ll"))
    for j in range(1, k + 1):
        g = grams(rows, j + 1)
        counts = g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("at") == 1).cast("int") if j < k else F.lit(1)).alias("used"))
        of = F.sum("n").over(Window.partitionBy(F.slice("gram", 1, j)))
        part = counts.select("used", F.log(F.col("n") / of).alias("lp")).agg(F.sum(F.col("used") * F.col("lp")).alias("ll"))
        out = out.union(part)
    size = rows.agg(F.sum(F.size("states")).alias("n_states"))
    return out.agg(F.sum("ll").alias("log_likelihood")).withColumn("one", F.lit(1)).join(size.withColumn("one", F.lit(1)), "one").drop("one")


def order_freedom(rows: DataFrame, k: int) -> int:
    """Free parameters of the layer of order k: for each k-gram its followers less one."""
    if k == 0:
        return rows.select(F.explode("states")).distinct().count() - 1
    per = grams(rows, k + 1).select(F.slice("gram", 1, k).alias("c"), "gram").distinct().groupBy("c").agg((F.count(F.lit(1)) - 1).alias("n"))
    return per.agg(F.sum("n")).first()[0] or 0


def multi_order_table(rows: DataFrame, max_order: int = 3) -> list[dict]:
    """For each order: log_likelihood, freedom (summed over layers), aic, bic, and the
    likelihood-ratio p against the order below."""
    out, freedom, before = [], 0, None
    for k in range(max_order + 1):
        layer = order_freedom(rows, k)
        freedom += layer
        row = order_log_likelihood(rows, k).first()
        p = chi2_sf(max(0.0, 2 * (row.log_likelihood - before)), layer) if before is not None and layer > 0 else None
        out.append({"order": k, "log_likelihood": row.log_likelihood, "freedom": freedom, "aic": 2 * freedom - 2 * row.log_likelihood, "bic": math.log(row.n_states) * freedom - 2 * row.log_likelihood, "p_value": p})
        before = row.log_likelihood
    return out


def order_tests(rows: DataFrame, k: int) -> DataFrame:
    """context (k - 1 states), g2, df: whether the state k steps back still tells something
    of the next, given the states between."""
    cells = grams(rows, k + 1).groupBy(F.slice("gram", 2, k - 1).alias("context"), F.col("gram")[0].alias("x"), F.element_at("gram", -1).alias("s")).agg(F.count(F.lit(1)).alias("o"))
    w = Window.partitionBy("context")
    x, s, n = F.sum("o").over(Window.partitionBy("context", "x")), F.sum("o").over(Window.partitionBy("context", "s")), F.sum("o").over(w)
    rows_ = cells.select("context", "x", "s", (2 * F.col("o") * F.log(F.col("o") * n / (x * s))).alias("g"))
    return rows_.groupBy("context").agg(F.sum("g").alias("g2"), ((F.countDistinct("x") - 1) * (F.countDistinct("s") - 1)).alias("df"))


def path_dependence(rows: DataFrame, k: int = 2, min_count: int = 5, base: float = 2.0) -> DataFrame:
    """context (k states), n, entropy_1, entropy_k, drop, divergence (of the next state given
    the context from given its last state), most_likely_1, most_likely_k, flips."""

    def shares(j: int) -> DataFrame:
        g = grams(rows, j + 1).groupBy(F.slice("gram", 1, j).alias("context"), F.element_at("gram", -1).alias("next")).agg(F.count(F.lit(1)).alias("c"))
        return g.withColumn("n", F.sum("c").over(Window.partitionBy("context"))).withColumn("p", F.col("c") / F.col("n"))

    def log(x: Column) -> Column:
        return F.log(x) / math.log(base)

    one, long = shares(1), shares(k).where(F.col("n") >= min_count)
    h1 = one.groupBy(F.element_at("context", 1).alias("last")).agg((-F.sum(F.col("p") * log(F.col("p")))).alias("entropy_1"), F.max_by("next", F.struct("c", "next")).alias("most_likely_1"))
    p1 = one.select(F.element_at("context", 1).alias("last"), "next", F.col("p").alias("q"))
    joined = long.withColumn("last", F.element_at("context", -1)).join(p1, ["last", "next"])
    per = joined.groupBy("context", "last").agg(F.max("n").alias("n"), (-F.sum(F.col("p") * log(F.col("p")))).alias("entropy_k"), F.sum(F.col("p") * log(F.col("p") / F.col("q"))).alias("divergence"), F.max_by("next", F.struct("c", "next")).alias("most_likely_k"))
    out = per.join(h1, "last")
    return out.select(F.array_join("context", " -> ").alias("context"), "n", "entropy_1", "entropy_k", (F.col("entropy_1") - F.col("entropy_k")).alias("drop"), "divergence", "most_likely_1", "most_likely_k", (F.col("most_likely_1") != F.col("most_likely_k")).alias("flips"))


def gram_pathways(rows: DataFrame, k: int = 1, min_count: int = 1, min_probability: float = 0.0) -> DataFrame:
    """path ("a b -> c"), count, probability of the steps that k-grams take."""
    g = gram_transitions(rows, k)
    path = F.concat_ws(" -> ", F.array_join("from", " "), F.element_at("to", -1))
    return g.where((F.col("count") >= min_count) & (F.col("probability") >= min_probability)).select(path.alias("path"), "count", "probability")


def anomaly_pathways(found: DataFrame, kind: str = "all") -> DataFrame:
    """kind, path ("a b -> c") of the paths of hypa() that are over or under what is expected."""
    kinds = ["over", "under"] if kind == "all" else [kind]
    return found.where(F.col("kind").isin(kinds)).select("kind", F.regexp_replace("path", r" (\S+)$", " -> $1").alias("path"))


def sequence_statistics(compared: DataFrame) -> DataFrame:
    """length, pattern, statistic, df of what sequence_compare() gives: chi-square of each
    pattern against all others by group, with the continuity correction for two groups."""
    by = Window.partitionBy("length", "pattern")
    n = F.count(F.lit(1)).over(by)
    rows = compared.withColumn("_groups", n)
    cells = rows.select("length", "pattern", "_groups", F.explode(F.array(F.struct(F.col("count").alias("o"), F.col("expected").alias("e")), F.struct((F.col("total") - F.col("count")).alias("o"), (F.col("total") - F.col("expected")).alias("e")))).alias("c"))
    gap = F.abs(F.col("c.o") - F.col("c.e"))
    # the correction is the same for all cells: no more than the least gap
    least = F.min(gap).over(Window.partitionBy("length", "pattern"))
    gap = F.when(F.col("_groups") == 2, gap - F.least(F.lit(0.5), least)).otherwise(gap)
    parts = cells.select("length", "pattern", "_groups", (gap * gap / F.col("c.e")).alias("x"))
    return parts.groupBy("length", "pattern").agg(F.sum("x").alias("statistic"), (F.max("_groups") - 1).alias("df"))


def sequence_compare(rows: DataFrame, group: str, sizes: Sequence[int] = (3, 4, 5), min_freq: int = 5) -> DataFrame:
    """length, pattern, group, count, expected, total (of the group), residual: k-grams by group
    with standardised residuals.

    Totals are of all patterns of a length; patterns rarer than min_freq in any group are
    then left out."""
    out = None
    for k in sizes:
        c = grams(rows, k, [group]).groupBy(F.array_join("gram", " -> ").alias("pattern"), F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("count"))
        every = c.select("group").distinct()
        # absent combinations count 0: pair each pattern with the few groups
        grid = c.select("pattern").distinct().join(every.agg(F.collect_set("group").alias("gs")).withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).select("pattern", F.explode("gs").alias("group"))
        full = grid.join(c, ["pattern", "group"], "left").na.fill(0, ["count"])
        w = Window.partitionBy
        full = full.select("*", F.sum("count").over(w("pattern")).alias("r"), F.sum("count").over(w("group")).alias("c"), F.sum("count").over(w()).alias("t"), F.min("count").over(w("pattern")).alias("least"))
        e = F.col("r") * F.col("c") / F.col("t")
        part = full.where(F.col("least") >= min_freq).select(F.lit(k).alias("length"), "pattern", "group", "count", e.alias("expected"), F.col("c").alias("total"), ((F.col("count") - e) / F.sqrt(e * (1 - F.col("r") / F.col("t")) * (1 - F.col("c") / F.col("t")))).alias("residual"))
        out = part if out is None else out.unionByName(part)
    return out


def hypa(rows: DataFrame, k: int = 2, alpha: float = 0.05, min_count: int = 5) -> DataFrame:
    """Paths of k + 1 states that are more or less frequent than the strengths of the k-grams
    at their ends allow: path, observed, expected, p_under, p_over (tails of the
    hypergeometric null), adjusted_under, adjusted_over (for the false discovery rate), kind.

    Paths stay tables: tails are taken where they are, p-values are adjusted by ranges."""
    ensure_importable(rows.sparkSession)
    e = gram_transitions(rows, k).select(F.array_join("from", " ").alias("f"), F.concat_ws(" ", F.array_join("from", " "), F.element_at("to", -1)).alias("path"), F.array_join("to", " ").alias("t"), "count")
    e = e.withColumn("xi", F.sum("count").over(Window.partitionBy("f")) * F.sum("count").over(Window.partitionBy("t"))).select("path", F.col("count").alias("observed"), "xi")
    total = e.agg(F.sum("observed").alias("n"), F.sum("xi").alias("xi")).first()
    n, all_xi = int(total.n or 0), int(total.xi or 0)

    def tails(frames):
        for pdf in frames:
            both = [hypergeometric_tails(int(x), all_xi, int(m), n) for x, m in zip(pdf.observed, pdf.xi, strict=True)]
            yield pdf.assign(expected=n * pdf.xi / max(all_xi, 1), p_under=[b[0] for b in both], p_over=[b[1] for b in both])

    found = written(e.mapInPandas(tails, "path string, observed long, xi long, expected double, p_under double, p_over double"))
    for tail in ("under", "over"):
        found = found.join(benjamini_hochberg(found, f"p_{tail}").withColumnRenamed("adjusted", f"adjusted_{tail}"), f"p_{tail}")
    kind = F.when((F.col("adjusted_over") < alpha) & (F.col("observed") >= min_count), "over").when((F.col("adjusted_under") < alpha) & (F.col("expected") >= min_count), "under").otherwise("normal")
    return found.select("path", "observed", "expected", "p_under", "p_over", "adjusted_under", "adjusted_over", kind.alias("kind"))


def contexts(rows: DataFrame, max_order: int, min_freq: int = 1) -> DataFrame:
    """context, next, count, probability of all contexts of 1 to max_order states."""
    lengths = F.sequence(F.lit(1), F.least(F.lit(max_order), F.size("states") - 1))
    g = rows.where(F.size("states") > 1).select("states", F.explode(lengths).alias("k")).select("states", "k", F.explode(F.sequence(F.lit(1), F.size("states") - F.col("k"))).alias("at"))
    g = g.select(F.slice("states", F.col("at"), F.col("k")).alias("context"), F.expr("states[at + k - 1]").alias("next"))
    counts = g.groupBy("context", "next").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_freq)
    return counts.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("context")))


def embedding(edges: list[dict], dims: int = 8, max_power: int = 10) -> tuple[list[str], np.ndarray, float]:
    """Nodes, coordinates and explained share: a truncated decomposition of discounted powers."""
    nodes = sorted({e["from"] for e in edges} | {e["to"] for e in edges})
    at = {n: i for i, n in enumerate(nodes)}
    d = np.zeros((len(nodes), len(nodes)))
    for e in edges:
        d[at[e["from"]], at[e["to"]]] += e["probability"]
    s, power, z = np.zeros_like(d), np.eye(len(nodes)), 0.0
    for k in range(max_power + 1):
        power = power @ d
        s += math.exp(-k) * power
        z += math.exp(-k)
    u, sigma, _ = np.linalg.svd(s / z)
    dims = min(dims, len(nodes))
    return nodes, u[:, :dims] * np.sqrt(sigma[:dims]), float((sigma[:dims] ** 2).sum() / (sigma**2).sum())
