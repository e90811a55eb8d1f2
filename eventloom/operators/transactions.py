"""Items that occur together: co-occurrence with similarities, and association rules.

Transactions are (tid, item) rows without repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.joins import MOST, pairs_by_key
from eventloom.storage import forget, written


def from_delimited(df: DataFrame, tid: str, columns: Sequence[str], separator: str) -> DataFrame:
    """Items of text columns, split at a literal separator, trimmed, empty ones left out."""
    import re

    parts = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), re.escape(separator)) for c in columns]))
    items = F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(F.col(tid).alias("tid"), F.explode(items).alias("item"))


def from_long(df: DataFrame, tid: str, item: str) -> DataFrame:
    return df.where(F.col(item).isNotNull() & F.col(tid).isNotNull()).select(F.col(tid).alias("tid"), F.col(item).alias("item")).distinct()


def from_binary(df: DataFrame, tid: str, columns: Sequence[str]) -> DataFrame:
    items = F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.select(F.col(tid).alias("tid"), F.explode(items).alias("item"))


def from_wide(df: DataFrame, tid: str, columns: Sequence[str]) -> DataFrame:
    """Items that stand in columns of their own; null and empty ones are none."""
    return from_arrays(df.select(F.col(tid).alias("tid"), F.array(*[F.col(c).cast("string") for c in columns]).alias("items")), "tid", "items")


def from_arrays(df: DataFrame, tid: str, column: str) -> DataFrame:
    """Items of an array column, each once; null and empty ones are none."""
    items = F.array_distinct(F.filter(F.transform(column, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != "")))
    return df.select(F.col(tid).alias("tid"), F.explode(items).alias("item"))


def _similarity(kind: str, n: Column, a: Column, b: Column, row: Column) -> Column:
    low = {"jaccard": a + b - n, "cosine": F.sqrt(a * b), "inclusion": F.least(a, b), "association": a * b, "dice": a + b, "equivalence": a * b, "relative": row}
    top = {"dice": 2 * n, "equivalence": n * n}.get(kind, n)
    return n if kind == "none" else top / F.when(low[kind] == 0, 1).otherwise(low[kind])


def cooccurrence(rows: DataFrame, similarity: str = "none", least: float = 0.0, min_occur: int = 1, diagonal: bool = True, top_n: int | None = None, most: int = MOST) -> DataFrame:
    """from, to, weight: transactions that hold both items, under a similarity.

    The join is by transaction; its size is the sum of squared transaction sizes, so items
    rarer than min_occur go before it, and large transactions are joined in parts."""
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_occur)
    kept = rows.join(counts, "item") if min_occur > 1 else rows
    met = pairs_by_key(kept.select("tid", "item"), ["tid"], "item", most)
    both = met.groupBy(F.col("a_item").alias("from"), F.col("b_item").alias("to")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = both if diagonal else both.where(F.col("from") != F.col("to"))
    both = both.join(counts.select(F.col("item").alias("from"), F.col("n").cast("double").alias("fa")), "from").join(counts.select(F.col("item").alias("to"), F.col("n").cast("double").alias("fb")), "to")
    row = F.sum("n").over(Window.partitionBy("from"))
    out = both.select("from", "to", _similarity(similarity, F.col("n"), F.col("fa"), F.col("fb"), row).alias("weight")).where((F.col("weight") >= least) & (F.col("weight") > 0))
    if top_n:
        # the weight of the last of the top pairs, by a sort of each part's top alone; ties stay
        top = out.where(F.col("from") <= F.col("to")).orderBy(F.desc("weight")).limit(top_n).agg(F.min("weight").alias("_least"))
        out = out.join(F.broadcast(top), F.col("weight") >= F.col("_least")).select("from", "to", "weight")
    return out


def _candidates(sets: DataFrame, k: int) -> DataFrame:
    """Sets of k items made of two of `sets` that share their first k - 2, all of whose parts
    of k - 1 items are there."""
    head = F.slice("items", 1, k - 2) if k > 2 else F.array().cast(sets.schema["items"].dataType)
    a, b = sets.select(head.alias("head"), F.element_at("items", -1).alias("x")), sets.select(head.alias("head"), F.element_at("items", -1).alias("y"))
    made = a.join(b, "head").where("x < y").select(F.concat("head", F.array("x", "y")).alias("made"))
    if k == 2:
        return made.select(F.col("made").alias("items"))
    parts = made.select("made", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.slice("made", 1, i - 1), F.slice("made", i + 1, k)))).alias("items"))
    return parts.join(sets, "items").groupBy("made").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(F.col("made").alias("items"))


def frequent_itemsets(rows: DataFrame, min_support: float, max_length: int = 5) -> tuple[DataFrame, int]:
    """items (sorted array), count of itemsets in at least min_support of all transactions.

    Level by level: two frequent sets that differ in their last items make a candidate if all
    its parts are frequent; transactions that hold one of the two are extended by candidates
    alone. What a transaction holds is written once a level, in the shared folder."""
    rows = written(rows)
    total = rows.select("tid").distinct().count()
    least = max(1, -int(-min_support * total // 1))
    single = rows.groupBy("item").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
    single = written(single)
    kept = rows.join(single.select("item"), "item", "left_semi")
    held = kept.select("tid", F.array("item").alias("items"))
    found = level = single.select(F.array("item").alias("items"), "count")
    for k in range(2, max_length + 1):
        candidates = written(_candidates(level.select("items"), k))
        if candidates.isEmpty():
            break
        pairs = candidates.select(F.slice("items", 1, k - 1).alias("items"), F.element_at("items", -1).alias("next"))
        last = held
        held = written(held.join(pairs, "items").join(kept.withColumnRenamed("item", "next"), ["tid", "next"]).select("tid", F.concat("items", F.array("next")).alias("items")))
        if k > 2:
            forget(last)
        level = written(held.groupBy("items").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least))
        forget(candidates)
        found = found.unionByName(level)
    return found, total


def association_rules(rows: DataFrame, min_support: float = 0.1, min_confidence: float = 0.5, min_lift: float = 1.0, max_length: int = 5) -> DataFrame:
    """antecedent, consequent, support, confidence, lift, conviction, count of the rules that
    split a frequent itemset in two; itemsets are few, so their subsets are made in place."""
    sets, total = frequent_itemsets(rows, min_support, max_length)
    n = F.size("items")
    masks = F.expr("sequence(1, shiftleft(1, size(items)) - 2)")
    part = lambda bit: F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1) = {bit})")
    rules = sets.where(n > 1).select("items", "count", F.explode(masks).alias("mask")).select(F.col("count"), part(1).alias("antecedent"), part(0).alias("consequent"))
    a, b = sets.select(F.col("items").alias("antecedent"), F.col("count").alias("na")), sets.select(F.col("items").alias("consequent"), F.col("count").alias("nb"))
    rules = rules.join(a, "antecedent").join(b, "consequent")
    confidence, share = F.col("count") / F.col("na"), F.col("nb") / F.lit(total)
    out = rules.select("antecedent", "consequent", (F.col("count") / F.lit(total)).alias("support"), confidence.alias("confidence"), (confidence / share).alias("lift"), F.when(confidence >= 1, float("inf")).otherwise((1 - share) / (1 - confidence)).alias("conviction"), "count")
    return out.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def rule_pathways(rules: DataFrame) -> DataFrame:
    """The rule of highest lift for each set of items, as text."""
    key = F.array_sort(F.array_union("antecedent", "consequent"))
    best = rules.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("lift"), F.desc("confidence"), "antecedent"))).where("_r = 1")
    return best.select(F.concat_ws(" -> ", F.concat_ws(" ", "antecedent"), F.concat_ws(" ", "consequent")).alias("path"), "lift", "confidence")
