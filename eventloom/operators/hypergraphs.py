"""Measures of hypergraphs given as incidence rows (node, hyperedge, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clique_expansion(incidence: DataFrame, weighted: bool = True) -> DataFrame:
    """from, to, weight: over shared hyperedges the sum of weight products, or their number."""
    a = incidence.select("hyperedge", F.col("node").alias("from"), F.col("weight").alias("wa"))
    b = incidence.select("hyperedge", F.col("node").alias("to"), F.col("weight").alias("wb"))
    value = F.sum(F.col("wa") * F.col("wb")) if weighted else F.count(F.lit(1)).cast("double")
    return a.join(b, "hyperedge").where(F.col("from") != F.col("to")).groupBy("from", "to").agg(value.alias("weight"))


def node_measures(incidence: DataFrame) -> DataFrame:
    """node, degree (hyperedges), strength (weights), mean_edge_size."""
    sizes = incidence.groupBy("hyperedge").agg(F.count(F.lit(1)).alias("size"))
    return incidence.join(sizes, "hyperedge").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"), F.avg("size").alias("mean_edge_size"))


def edge_overlap(incidence: DataFrame) -> DataFrame:
    """edge_a < edge_b, shared nodes and their Jaccard share, for pairs that share any."""
    sizes = incidence.groupBy("hyperedge").agg(F.count(F.lit(1)).alias("size"))
    rows = incidence.join(sizes, "hyperedge")
    a = rows.select("node", F.col("hyperedge").alias("edge_a"), F.col("size").alias("sa"))
    b = rows.select("node", F.col("hyperedge").alias("edge_b"), F.col("size").alias("sb"))
    both = a.join(b, "node").where("edge_a < edge_b").groupBy("edge_a", "edge_b", "sa", "sb").agg(F.count(F.lit(1)).alias("shared"))
    return both.select("edge_a", "edge_b", "shared", (F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).alias("jaccard"))


def density(incidence: DataFrame) -> DataFrame:
    """One row: nodes, hyperedges, mean_size, density (sum of sizes over nodes times hyperedges)."""
    return incidence.agg(F.countDistinct("node").alias("nodes"), F.countDistinct("hyperedge").alias("hyperedges"), (F.count(F.lit(1)) / F.countDistinct("hyperedge")).alias("mean_size"), (F.count(F.lit(1)) / (F.countDistinct("node") * F.countDistinct("hyperedge"))).alias("density"))
