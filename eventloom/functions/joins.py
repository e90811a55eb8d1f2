"""Self-joins whose work no key can pile up in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that meet in one task, on each side.
MOST = 1000


def pairs_by_key(rows: DataFrame, keys: Sequence[str], item: str, most: int = MOST) -> DataFrame:
    """keys, and the other columns of both rows as a_... and b_..., of all ordered pairs of rows
    that share keys, each with itself too.

    A key of n rows is dealt into n / most parts by a hash of `item`, and each pair of parts is
    joined by itself: a row goes to as many places as its key has parts, and of a key of any
    size no task makes more than most squared pairs at once. Keys with few rows have one part."""
    others = [c for c in rows.columns if c not in keys]
    heavy = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    r = rows.join(heavy, list(keys), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64(item), F.col("_parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    a = r.select(*keys, own.alias("_p"), every.alias("_q"), *[F.col(c).alias(f"a_{c}") for c in others])
    b = r.select(*keys, every.alias("_p"), own.alias("_q"), *[F.col(c).alias(f"b_{c}") for c in others])
    return a.join(b, [*keys, "_p", "_q"]).drop("_p", "_q")
