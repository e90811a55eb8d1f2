"""Column expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.storage import written


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1, equal values sharing the mean of theirs."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def average_ranks(df: DataFrame, value: str, parts: int = 64, weight: str | None = None) -> DataFrame:
    """value, count, rank of each distinct value: ranks from 1, equal values sharing the mean
    of theirs. Values are cut into ranges at approximate quantiles; counts below are summed in
    each range, and the ranges' totals, of which there are `parts`, are added to them. A cut
    anywhere gives the same ranks, so quantiles need not be exact. weight: a column of how many
    times a row counts."""
    counts = written(df.where(F.col(value).isNotNull()).groupBy(value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("count")))
    cuts = sorted(set(counts.approxQuantile(value, [i / parts for i in range(1, parts)], 0.005)))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    ranged = counts.withColumn("_range", at)
    totals = ranged.groupBy("_range").agg(F.sum("count").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over `parts` rows
    totals = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("count").over(inside), F.lit(0))
    return ranged.withColumn("_below", below).join(totals, "_range").select(value, "count", (F.col("_before") + F.col("_below") + (F.col("count") + 1) / 2).alias("rank"))


def benjamini_hochberg(df: DataFrame, p: str, parts: int = 64) -> DataFrame:
    """The distinct values of p, with `adjusted`: the least of p' n / rank over all p' that are
    no smaller, at most 1. Ranges of p are counted and cut like those of average_ranks; the
    least of the ranges behind, of which there are `parts`, is added to that of each."""
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    cuts = sorted(set(counts.approxQuantile(p, [i / parts for i in range(1, parts)], 0.005)))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(p))) if cuts else F.lit(0)
    ranged = counts.withColumn("_range", at)
    totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_m"))
    order = Window.orderBy("_range")  # over `parts` rows
    totals = totals.select("_range", F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_range").orderBy(p)
    rank = F.col("_before") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    raw = ranged.join(totals, "_range").withColumn("_raw", F.col(p) * F.col("_total") / rank)
    behind = raw.groupBy("_range").agg(F.min("_raw").alias("_least"))
    behind = behind.select("_range", F.min("_least").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"))
    own = F.min("_raw").over(inside.rowsBetween(0, Window.unboundedFollowing))
    return raw.withColumn("_own", own).join(behind, "_range").select(p, F.least(F.lit(1.0), "_own", F.coalesce("_behind", F.lit(1.0))).alias("adjusted"))


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of df, which are the driver's to work on, or an error if there are too many."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}: too many for one matrix")
    return rows


def share_of(value: str, *by: str) -> Column:
    """The value over its partition's sum; 0 where that is 0."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return F.when(total != 0, F.col(value) / total).otherwise(0.0)


def entropy(share: Column, base: float = 2.0) -> Column:
    """An aggregate: the entropy of shares."""
    import math

    return -F.sum(F.when(share > 0, share * F.log(share))) / math.log(base)
