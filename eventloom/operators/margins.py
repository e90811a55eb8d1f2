"""Random tables of counts with fixed margins, and the tests that rest on them.

To permute one of two labels of all rows is to draw a table with the same margins: row by
row and column by column from hypergeometric distributions. Only tables of counts are
needed, however many rows were counted. A table's draws are dealt to tasks in blocks of
replicates, each with its own generator (of the seed, the table and the block), so that
results don't depend on tasks, one large table keeps all of them busy, and none is at the
driver. A task adds up its tables before anything is exchanged.

A table's cells are as many as pairs of its labels, and one task holds them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.kernels.distributions import chi2_sf
from eventloom.operators.higher_order import grams, order_tests
from eventloom.session import ensure_importable

#: Replicates that a task draws of a table at once.
BLOCK = 64
#: From here on the library's exact draws give out: a normal one, rounded, takes their place,
#: whose error is below a ten-thousandth of its deviation.
LARGEST = 10**9 - 1


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    if (good + bad).max(initial=0) <= LARGEST:
        return rng.hypergeometric(good, bad, drawn)
    total = (good + bad).astype(float)
    mean = drawn * good / np.maximum(total, 1)
    var = mean * bad / np.maximum(total, 1) * (total - drawn) / np.maximum(total - 1, 1)
    return np.clip(np.rint(rng.normal(mean, np.sqrt(var))), np.maximum(0, drawn - bad), np.minimum(good, drawn)).astype(np.int64)


def draw_tables(rng: np.random.Generator, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """n random tables (n x rows x columns) with the given margins, each as likely as by
    permuting the columns' labels."""
    left, out = np.tile(columns.astype(np.int64), (n, 1)), np.zeros((n, len(rows), len(columns)), np.int64)
    for i, r in enumerate(rows.tolist()):
        need = np.full(n, r, np.int64)
        rest = left.sum(1)
        for j in range(len(columns)):
            rest = rest - left[:, j]
            x = _hypergeometric(rng, left[:, j], rest, need)
            out[:, i, j] = x
            need = need - x
        left = left - out[:, i]
    return out


def _dense(cells: list) -> np.ndarray:
    """A table from its cells that aren't 0: (row, column, count)."""
    rows, columns = ({x: i for i, x in enumerate(sorted({c[end] for c in cells}))} for end in ("r", "c"))
    out = np.zeros((len(rows), len(columns)), np.int64)
    for c in cells:
        out[rows[c["r"]], columns[c["c"]]] += c["n"]
    return out


def g_squared(tables: np.ndarray) -> np.ndarray:
    """2 sum o log(o / e) of each table of a stack."""
    r, c, t = tables.sum(2, keepdims=True), tables.sum(1, keepdims=True), tables.sum((1, 2), keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(tables > 0, tables * np.log(tables * t / (r * c)), 0.0)
    return 2 * parts.sum((1, 2))


def null_sums(cells: DataFrame, by: str, row: str, column: str, count: str, n: int, seed: int = 1) -> DataFrame:
    """replicate, statistic: G squared summed over the tables of all values of `by`, of n
    draws of each with its margins."""
    ensure_importable(cells.sparkSession)
    blocks = -(-n // BLOCK)
    tables = cells.groupBy(by).agg(F.collect_list(F.struct(F.col(row).cast("string").alias("r"), F.col(column).cast("string").alias("c"), F.col(count).cast("long").alias("n"))).alias("cells"))
    tables = tables.select(F.xxhash64(by).alias("key"), "cells").where(F.size("cells") > 1)
    dealt = tables.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("key", "block")

    def run(frames):
        sums: dict[int, np.ndarray] = {}
        for pdf in frames:
            for key, cells_, b in zip(pdf.key, pdf.cells, pdf.block, strict=True):
                t = _dense(list(cells_))
                size = min(BLOCK, n - b * BLOCK)
                drawn = draw_tables(np.random.default_rng((seed, key & 0xFFFFFFFFFFFFFFFF, b)), t.sum(1), t.sum(0), size)
                sums[b] = sums.get(b, 0.0) + g_squared(drawn)
        if sums:
            yield pd.DataFrame({"replicate": np.concatenate([b * BLOCK + np.arange(len(x)) for b, x in sums.items()]), "statistic": np.concatenate(list(sums.values()))})

    return dealt.mapInPandas(run, "replicate long, statistic double").groupBy("replicate").agg(F.sum("statistic").alias("statistic"))


def markov_order(rows: DataFrame, max_order: int = 3, n_perm: int = 200, alpha: float = 0.05, seed: int = 1) -> list[dict]:
    """For orders 1 to max_order: g2, df, asymptotic p, and the p of permuting next states
    inside contexts; `chosen` grows while p < alpha. Four numbers an order come to the driver."""
    out, chosen, open_ = [], 0, True
    for k in range(1, max_order + 1):
        tests = order_tests(rows, k).agg(F.sum("g2").alias("g2"), F.sum("df").alias("df")).first()
        g2, df = tests.g2 or 0.0, int(tests.df or 0)
        cells = grams(rows, k + 1).groupBy(F.slice("gram", 2, k - 1).alias("context"), F.col("gram")[0].alias("x"), F.element_at("gram", -1).alias("s")).agg(F.count(F.lit(1)).alias("n"))
        reached = null_sums(cells, "context", "x", "s", "n", n_perm, seed + k).agg(F.count_if(F.col("statistic") >= g2 - 1e-9).alias("hits"), F.count(F.lit(1)).alias("drawn")).first()
        # replicates of tables with one cell alone are all 0, as their G squared is
        hits = reached.hits + (n_perm - reached.drawn if g2 <= 1e-9 else 0)
        p = (1 + hits) / (n_perm + 1)
        open_ = open_ and p < alpha
        chosen = k if open_ else chosen
        out.append({"order": k, "g2": g2, "df": df, "p_asymptotic": chi2_sf(g2, df) if df else None, "p_permutation": p})
    return [o | {"chosen": chosen} for o in out]


# ---- two categorical columns ---------------------------------------------------------


def mosaic_cells(df: DataFrame, row: str, column: str, min_count: int = 10, base: str = "total") -> DataFrame:
    """row, column, count, expected, residual (standardised), percent of all cells, those
    without cases too, of the categories that are there min_count times or more. base: what
    percents are of, total, row or column."""
    c = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy
    c = c.withColumns({"_r": F.sum("n").over(w("row")), "_c": F.sum("n").over(w("column"))}).where((F.col("_r") >= min_count) & (F.col("_c") >= min_count)).select("row", "column", "n")
    labels = c.agg(F.collect_set("row").alias("rs"), F.collect_set("column").alias("cs"))  # the table's own labels
    grid = labels.select(F.explode("rs").alias("row"), "cs").select("row", F.explode("cs").alias("column"))
    c = grid.join(c, ["row", "column"], "left").select("row", "column", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
    r, k, t = F.sum("count").over(w("row")), F.sum("count").over(w("column")), F.sum("count").over(w())
    e = r * k / t
    of = {"total": t, "row": r, "column": k}[base]
    return c.select("row", "column", "count", e.alias("expected"), ((F.col("count") - e) / F.sqrt(e * (1 - r / t) * (1 - k / t))).alias("residual"), (100 * F.col("count") / of).alias("percent"))


def mosaic_permutation(cells: DataFrame, n_perm: int = 500, seed: int = 1) -> DataFrame:
    """row, column, count, z, fisher_p: how many deviations a cell is from its mean over tables
    with the same margins, and the simulated p of Fisher's exact test of the whole table: the
    share of tables that are no likelier than this one. cells: row, column, count of all cells."""
    if n_perm < 2:
        raise ValueError("n_perm is at least 2")
    ensure_importable(cells.sparkSession)
    blocks = -(-n_perm // BLOCK)
    one = cells.agg(F.collect_list(F.struct(F.col("row").cast("string").alias("r"), F.col("column").cast("string").alias("c"), F.col("count").alias("n"))).alias("cells")).where(F.size("cells") > 0)
    dealt = one.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "block")

    def run(frames):
        lgamma = np.vectorize(math.lgamma, otypes=[float])
        for pdf in frames:
            for cells_, b in zip(pdf.cells, pdf.block, strict=True):
                cells_ = list(cells_)
                t = _dense(cells_)
                names = sorted({c["r"] for c in cells_}), sorted({c["c"] for c in cells_})
                drawn = draw_tables(np.random.default_rng((seed, b)), t.sum(1), t.sum(0), min(BLOCK, n_perm - b * BLOCK))
                own = -lgamma(t + 1.0).sum()
                rarer = int((-lgamma(drawn + 1.0).sum((1, 2)) <= own / (1 + 64 * np.finfo(float).eps)).sum())
                gap = drawn - t  # sums of small numbers, not of counts
                yield pd.DataFrame([(x, y, float(gap[:, i, j].sum()), float((gap[:, i, j].astype(float) ** 2).sum()), rarer) for i, x in enumerate(names[0]) for j, y in enumerate(names[1])], columns=["row", "column", "s", "q", "rarer"])

    sums = dealt.mapInPandas(run, "row string, column string, s double, q double, rarer long").groupBy("row", "column").agg(*[F.sum(c).alias(c) for c in ("s", "q", "rarer")])
    found = cells.select(F.col("row").cast("string").alias("row"), F.col("column").cast("string").alias("column"), "count").join(sums, ["row", "column"])
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / n_perm) / (n_perm - 1))
    z = F.when(sd > 0, -F.col("s") / n_perm / sd).otherwise(0.0)
    return found.select("row", "column", "count", z.alias("z"), ((1 + F.col("rarer")) / (n_perm + 1)).alias("fisher_p"))
