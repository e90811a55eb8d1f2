"""Higher-order rules: a tree of contexts that grows level by level as tables.

A context is the states that lead to a next one. From each single state a context may be
extended by one state further back. What a context "now" is compared with is "valid", the
longest of its ends whose next states have proved to differ. An extension proves valid if the divergence of
its next states from those of valid is more than its order / log2(1 + its count). Growth
stops where even the largest divergence that now allows - of its rarest next state, had that
probability one - stays below that bound, and where nothing extends now.

A level is two joins: of the contexts that grow with the sequences' grams, which counts only
what extends them, and of the extensions with the next states of valid. Levels are written
tables, so there is no bound on contexts and nothing of them on the driver. All prefixes of a context
that growth ended in are rules too.

In the network a rule leads to the longest context with at least two states that is a rule
and ends the path of the rule, or else to its next state alone. This is what redirecting
edges one by one comes to: the edge from a prefix to a context's last state goes to the
context, then any tail that a longer context ends goes there; both are one join with the
ends of paths.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.higher_order import grams
from eventloom.storage import written


def next_counts(rows: DataFrame, k: int, among: DataFrame | None = None, min_freq: int = 1) -> DataFrame:
    """context (k states), next, count, probability, total: of contexts that `among` (context)
    has, or of all. Counts below min_freq are not there, nor in total."""
    g = grams(rows, k + 1).select(F.slice("gram", 1, k).alias("context"), F.element_at("gram", -1).alias("next"))
    found = g if among is None else g.join(among, "context", "left_semi")
    found = found.groupBy("context", "next").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_freq)
    total = F.sum("count").over(Window.partitionBy("context"))
    return found.select("context", "next", "count", (F.col("count") / total).alias("probability"), total.alias("total"))


def _extending(rows: DataFrame, k: int, now: DataFrame, min_freq: int) -> DataFrame:
    """next_counts of the contexts of k + 1 states that end with one of `now` (k states)."""
    g = grams(rows, k + 2).select(F.slice("gram", 2, k).alias("now"), "gram").join(now, "now", "left_semi")
    found = g.groupBy(F.slice("gram", 1, k + 1).alias("context"), F.element_at("gram", -1).alias("next")).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_freq)
    total = F.sum("count").over(Window.partitionBy("context"))
    return found.select("context", "next", "count", (F.col("count") / total).alias("probability"), total.alias("total"))


def grown(rows: DataFrame, max_order: int = 5, min_freq: int = 1) -> DataFrame:
    """context: where growth ended, and all single states."""
    level = written(next_counts(rows, 1, min_freq=min_freq))
    known = level.select(F.col("context").alias("valid"), "next", F.col("probability").alias("q"))
    live = level.select(F.col("context").alias("now"), F.col("context").alias("valid")).distinct()
    ended = [live.select("valid")]
    for order in range(1, max_order):
        # the rarest next state of now; of equally rare ones the one that valid makes least likely
        state = level.join(live, level["context"] == live["now"]).select("now", "valid", "next", "probability", "total")
        rarest = state.withColumn("least", F.min("probability").over(Window.partitionBy("now"))).where("probability = least")
        largest = F.max(F.coalesce(-F.log2("q"), F.lit(math.inf)))
        checked = rarest.join(known, ["valid", "next"], "left").groupBy("now", "valid").agg(largest.alias("largest"), F.max("total").alias("total"))
        checked = written(checked.select("now", "valid", (F.col("largest") < (order + 1) / F.log2(1 + F.col("total"))).alias("stops")))
        grows = checked.where("NOT stops").select("now", "valid")
        longer = written(_extending(rows, order, grows.select("now"), min_freq))
        parent = F.slice("context", 2, order).alias("now")
        has_more = longer.select(parent).distinct()
        ended += [checked.where("stops").select("valid"), grows.join(has_more, "now", "left_anti").select("valid")]
        against = longer.withColumn("now", F.slice("context", 2, order)).join(grows, "now").join(known, ["valid", "next"], "left")
        gap = F.sum(F.when(F.col("q").isNull(), math.inf).otherwise(F.col("probability") * F.log2(F.col("probability") / F.col("q"))))
        tested = against.groupBy("context", "valid").agg(gap.alias("gap"), F.max("total").alias("total"))
        better = F.col("gap") > (order + 1) / F.log2(1 + F.col("total"))
        live = written(tested.select(F.col("context").alias("now"), F.when(better, F.col("context")).otherwise(F.col("valid")).alias("valid")))
        known = known.unionByName(longer.select(F.col("context").alias("valid"), "next", F.col("probability").alias("q")))
        level = longer
        if live.isEmpty():
            break
    ended.append(live.select("valid"))
    out = ended[0]
    for x in ended[1:]:
        out = out.unionByName(x)
    return out.select(F.col("valid").alias("context")).distinct()


def rules(rows: DataFrame, max_order: int = 5, min_freq: int = 1) -> DataFrame:
    """context (array), next, count, probability, order: the contexts that growth ended in and
    all their prefixes, with their next states. rows: states (see trails)."""
    if max_order < 1 or min_freq < 1:
        raise ValueError("max_order and min_freq are at least 1")
    rows = written(rows.select("states").where(F.size("states") > 1))
    ends = grown(rows, max_order, min_freq)
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size("context")), lambda i: F.slice("context", F.lit(1), i)))
    wanted = written(ends.select(prefix.alias("context")).distinct())
    deepest = wanted.agg(F.max(F.size("context"))).first()[0] or 1
    out = None
    for k in range(1, deepest + 1):
        part = next_counts(rows, k, wanted.where(F.size("context") == k), min_freq)
        part = part.select("context", "next", "count", "probability", F.lit(k).alias("order"))
        out = part if out is None else out.unionByName(part)
    return written(out)


def network(found: DataFrame) -> DataFrame:
    """from, to (arrays), count, probability, from_order, to_order: edges between the rules'
    contexts. found: what rules() gives."""
    nodes = found.select(F.col("context").alias("to")).distinct().where(F.size("to") > 1)
    paths = found.withColumn("path", F.concat("context", F.array("next")))
    ends = paths.select("context", "next", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("at"), "path")
    ends = ends.select("context", "next", F.slice("path", F.col("at"), F.size("path")).alias("to")).join(nodes, "to")
    longest = ends.groupBy("context", "next").agg(F.max_by("to", F.size("to")).alias("to"))
    edges = found.join(longest, ["context", "next"], "left").withColumn("to", F.coalesce("to", F.array("next")))
    return edges.select(F.col("context").alias("from"), "to", "count", "probability", F.col("order").alias("from_order"), F.size("to").alias("to_order"))


def pathways(found: DataFrame, min_count: int = 1, min_probability: float = 0.0, order: int | None = None) -> DataFrame:
    """path ("a b -> c"), order, count, probability of the rules with more than one state."""
    kept = found.where((F.col("order") > 1) & (F.col("count") >= min_count) & (F.col("probability") >= min_probability))
    kept = kept if order is None else kept.where(F.col("order") == order)
    return kept.select(F.concat_ws(" -> ", F.array_join("context", " "), "next").alias("path"), "order", "count", "probability")
