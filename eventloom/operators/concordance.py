"""Kendall's tau-b of columns with any number of values.

Two rows agree if both values rise from one to the other, and disagree if one falls. Rows are
first counted by pair of values. Each column is cut into ranges at approximate quantiles; a
cut's own value is a range by itself, so that a value that many rows share never fills one
with others. Pairs of rows in unlike ranges of both columns follow from the counts of the
grid of ranges alone. Pairs in one range of x are counted in that range's task, by merging
sorted halves; pairs in unlike ranges of x but one range of y in that range's task, with the
range's number in x's place. A range of a single value has no pairs to add in its column and
is passed over. Cuts decide nothing but who counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import ensure_importable
from eventloom.storage import written

PARTS = 64


def _agreement(y: np.ndarray, w: np.ndarray) -> int:
    """Sum over a before b of w_a w_b sign(y_b - y_a)."""
    if len(y) <= 64:
        return int((np.triu(np.sign(y[None] - y[:, None]), 1).astype(np.int64) * np.outer(w, w)).sum())
    half = len(y) // 2
    left, right = slice(0, half), slice(half, len(y))
    by = np.argsort(y[left], kind="stable")
    ordered, total = y[left][by], np.r_[0, np.cumsum(w[left][by])]
    less = total[np.searchsorted(ordered, y[right], "left")]
    more = total[-1] - total[np.searchsorted(ordered, y[right], "right")]
    return int(w[right] @ (less - more)) + _agreement(y[left], w[left]) + _agreement(y[right], w[right])


def signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Pairs that agree less those that disagree, of weighted rows."""
    by = np.lexsort((y, x))
    x, y, w = x[by], y[by], w[by].astype(np.int64)
    # rows of one x stand in order of y, so they were counted as agreeing; take them out
    ends = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    cell = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    whole, single = np.add.reduceat(w, ends), np.add.reduceat(w, cell)
    tied = (int((whole.astype(object) ** 2).sum()) - int((single.astype(object) ** 2).sum())) // 2
    return _agreement(y, w) - tied


def _range_of(df: DataFrame, column: str, parts: int) -> tuple[Column, int]:
    """2 k for values between cuts k - 1 and k, 2 k + 1 for cut k itself."""
    cuts = sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.005)))
    cut = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    below = F.size(F.filter(cut, lambda c: c < F.col(column)))
    return 2 * below + F.when(F.array_contains(cut, F.col(column)), 1).otherwise(0), 2 * len(cuts) + 1


def kendall(df: DataFrame, x: str, y: str, parts: int = PARTS) -> float:
    """Tau-b of two numeric columns, of rows where both have values; nan if one is constant."""
    ensure_importable(df.sparkSession)
    cells = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    cells = written(cells.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    ties = []
    for c in ("x", "y"):
        n = cells.groupBy(c).agg(F.sum("w").cast("decimal(19,0)").alias("n"))
        ties.append(int(n.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0))
    total = int(cells.agg(F.sum("w")).first()[0] or 0)
    low = (total * total - ties[0]) * (total * total - ties[1])
    if not low:
        return math.nan
    (rx, nx), (ry, ny) = (_range_of(cells, c, parts) for c in ("x", "y"))
    ranged = cells.select("x", "y", "w", rx.cast("int").alias("rx"), ry.cast("int").alias("ry"))
    grid = np.zeros((nx, ny), object)
    for r in ranged.groupBy("rx", "ry").agg(F.sum("w").alias("w")).collect():  # at most 4 parts squared
        grid[r.rx, r.ry] = int(r.w)
    # each cell with those of later x ranges, in later y ranges less in earlier ones
    behind = np.vstack([np.cumsum(grid[::-1], 0)[::-1][1:], np.zeros((1, ny), object)])
    right = np.cumsum(behind[:, ::-1], 1)[:, ::-1] - behind
    left = np.cumsum(behind, 1) - behind
    agree = int((grid * (right - left)).sum())

    def inside(key, table):
        a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
        return pa.table([pa.array([str(signed_pairs(a, b, w))])], names=["s"])

    own = ranged.where("rx % 2 = 0").select(F.col("rx").alias("r"), F.col("x").alias("a"), F.col("y").alias("b"), "w")
    other = ranged.where("ry % 2 = 0").select((-1 - F.col("ry")).alias("r"), F.col("rx").cast("double").alias("a"), F.col("y").alias("b"), "w")
    # rows alike in the range of x and in y are one row there
    other = other.groupBy("r", "a", "b").agg(F.sum("w").alias("w"))
    sums = own.unionByName(other).groupBy("r").applyInArrow(inside, "s string")
    agree += sum(int(r.s) for r in sums.collect())  # a number for each range
    return 2 * agree / math.sqrt(low)
