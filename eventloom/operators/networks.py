"""Operations on networks given as edges (from, to, weight).

Edges are as many as pairs of states, small beside the data they came from; what is absent
weighs 0. Windows without partition below run over edges alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all() -> Window:
    return Window.partitionBy()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from").alias("node")).union(edges.select(F.col("to").alias("node"))).distinct()


def filled(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Every ordered pair of nodes, absent ones with weight 0. The grid is built in one row
    from the set of nodes and exploded, so nothing is joined without a key."""
    nodes = nodes if nodes is not None else nodes_of(edges)
    one = nodes.agg(F.array_sort(F.collect_set("node")).alias("n"))
    grid = one.select(F.explode("n").alias("from"), "n").select("from", F.explode("n").alias("to"))
    return grid.join(edges, ["from", "to"], "left").select("from", "to", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def from_matrix(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """Edges of a matrix that is given as rows: `row` names where they start, columns where they end."""
    cells = F.array(*[F.struct(F.lit(c).alias("to"), F.col(c).cast("double").alias("weight")) for c in columns])
    return df.select(F.col(row).cast("string").alias("from"), F.explode(cells).alias("e")).select("from", "e.to", "e.weight").where("weight <> 0")


def validated(edges: DataFrame) -> DataFrame:
    """The edges, if they are a network: ends that are not null, weights that are numbers, and
    each pair of nodes once; else an error that says what is wrong."""
    missing = {"from", "to", "weight"} - set(edges.columns)
    if missing:
        raise ValueError(f"no columns {', '.join(sorted(missing))}")
    w = F.col("weight").cast("double")
    x = edges.agg(F.count_if(F.col("from").isNull() | F.col("to").isNull()).alias("ends"), F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))).alias("weights")).first()
    twice = edges.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    found = [what for what, n in (("edges without an end", x.ends), ("weights that are no numbers", x.weights), ("a pair of nodes twice", twice)) if n]
    if found:
        raise ValueError("not a network: " + ", ".join(found))
    return edges


def pruned(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """edges with `pruned`: whether they are not among `kept`, which any pruning gives."""
    mark = kept.where("weight <> 0").select("from", "to", F.lit(True).alias("_kept"))
    return edges.join(mark, ["from", "to"], "left").withColumn("pruned", F.col("_kept").isNull() & (F.col("weight") != 0)).drop("_kept")


def depruned(marked: DataFrame) -> DataFrame:
    """All edges as they were before pruned()."""
    return marked.select("from", "to", "weight")


def repruned(marked: DataFrame) -> DataFrame:
    """The edges that pruned() has left."""
    return marked.where("NOT pruned").select("from", "to", "weight")


def assigned(clusters: DataFrame) -> DataFrame:
    """node, cluster, if no node has two clusters; else an error that names one."""
    twice = clusters.groupBy("node").agg(F.countDistinct("cluster").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"node {twice[0].node!r} is in {twice[0].n} clusters")
    return clusters.select("node", "cluster").distinct()


def edge_list_layers(edges: DataFrame, clusters: DataFrame, method: str = "sum") -> tuple[DataFrame, DataFrame]:
    """The network between clusters and those inside them, of an edge list and the nodes'
    clusters, one each."""
    of = assigned(clusters)
    return macro(edges, of, method), within(edges, of)


def scaled(edges: DataFrame, method: str, zeros: bool = False) -> DataFrame:
    """Weights by minmax, max, rank (average ties) or normalize (row by absolute sum).

    minmax: with `zeros` over all cells given (fill them first), else non-zero weights into
    (sqrt of the machine epsilon, 1]."""
    w = F.col("weight")
    if method == "minmax" and zeros:
        low, high = F.min(w).over(_all()), F.max(w).over(_all())
        return edges.withColumn("weight", F.when(high > low, (w - low) / (high - low)).otherwise(w))
    if method == "minmax":
        some = F.when(w != 0, w)
        low, high, least = F.min(some).over(_all()), F.max(some).over(_all()), 2.0**-26
        return edges.withColumn("weight", F.when((w != 0) & (high > low), least + (1 - least) * (w - low) / (high - low)).otherwise(w))
    if method == "max":
        top = F.max(F.abs(w)).over(_all())
        return edges.withColumn("weight", F.when(top > 0, w / top).otherwise(w))
    if method == "rank":
        rank = F.rank().over(Window.partitionBy(w != 0).orderBy(w)) + (F.count(F.lit(1)).over(Window.partitionBy("weight")) - 1) / 2
        return edges.withColumn("weight", F.when(w != 0, rank).otherwise(0.0))
    if method == "normalize":
        total = F.sum(F.abs(w)).over(Window.partitionBy("from"))
        return edges.withColumn("weight", F.when(total > 0, w / total).otherwise(w))
    raise ValueError(f"unknown scaling {method!r}")


def threshold(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.abs("weight") >= least)


def extract_edges(edges: DataFrame, least: float = 0.0, loops: bool = False) -> DataFrame:
    """All ordered pairs that weigh at least `least`, zero-weight ones with least 0."""
    out = filled(edges).where(F.col("weight") >= least)
    return out if loops else out.where(F.col("from") != F.col("to"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("weight") != 0) & (F.col("from") <= F.col("to")))


def aligned(x: DataFrame, y: DataFrame) -> DataFrame:
    """from, to, x, y over the pairs that either has."""
    a, b = x.withColumnRenamed("weight", "x"), y.withColumnRenamed("weight", "y")
    return a.join(b, ["from", "to"], "full").na.fill(0.0, ["x", "y"])


def subtract(x: DataFrame, y: DataFrame) -> DataFrame:
    return aligned(x, y).select("from", "to", (F.col("x") - F.col("y")).alias("weight"))


def comparison_scaling(edges: DataFrame, method: str) -> DataFrame:
    """Scalings that a comparison may apply to all cells first."""
    w = F.col("weight")
    if method == "none":
        return edges
    if method == "row":
        total = F.sum("weight").over(Window.partitionBy("from"))
        new = F.when(total != 0, w / total).otherwise(0.0)
    elif method == "frobenius":
        new = w / F.sqrt(F.sum(w * w).over(_all()))
    elif method == "zscore":
        new = (w - F.avg(w).over(_all())) / F.stddev_samp(w).over(_all())
    elif method == "robust":
        middle = edges.agg(F.median("weight")).first()[0]
        spread = edges.agg(F.median(F.abs(w - middle))).first()[0] * 1.4826
        new = (w - middle) / (spread or 1.0)
    elif method == "log":
        new = F.log(w)
    elif method == "log1p":
        new = F.log1p(w)
    elif method == "softmax":
        new = F.exp(w - F.max(w).over(_all()))
        return edges.withColumn("weight", new).withColumn("weight", w / F.sum("weight").over(_all()))
    elif method == "quantile":
        new = (F.rank().over(Window.orderBy("weight")) + (F.count(F.lit(1)).over(Window.partitionBy("weight")) - 1) / 2) / F.count(F.lit(1)).over(_all())
    else:
        return scaled(edges, method, zeros=True)
    return edges.withColumn("weight", new)


def similarity(cells: DataFrame) -> DataFrame:
    """One row of measures between columns x and y of aligned, filled cells."""
    x, y = F.col("x"), F.col("y")
    d = F.abs(x - y)
    out = cells.agg(
        F.corr("x", "y").alias("pearson"),
        F.sum(d).alias("manhattan"),
        F.sqrt(F.sum(d * d)).alias("euclidean"),
        F.max(d).alias("chebyshev"),
        F.avg(d).alias("mean_abs_difference"),
        F.median(d).alias("median_abs_difference"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        (F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"),
        F.sum(F.when(F.abs(x) + F.abs(y) > 0, d / (F.abs(x) + F.abs(y)))).alias("canberra"),
        (F.sum(d) / F.sum(F.abs(x) + F.abs(y))).alias("bray_curtis"),
        (F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("weighted_jaccard"),
        (F.sum(((x != 0) & (y != 0)).cast("int")) / F.sum(((x != 0) | (y != 0)).cast("int"))).alias("edge_jaccard"),
        (2 * F.sum(((x != 0) & (y != 0)).cast("int")) / (F.sum((x != 0).cast("int")) + F.sum((y != 0).cast("int")))).alias("edge_dice"),
        F.avg((F.signum(x) == F.signum(y)).cast("double")).alias("sign_agreement"),
        (F.sum(x * y) / F.sum(x * x)).alias("slope"),
    )
    return out


def disparity(edges: DataFrame, level: float) -> DataFrame:
    """Edges whose weight is unlikely, at one of their ends, if a node spread its strength evenly."""
    w = F.col("weight")

    def at(side: str) -> Column:
        by = Window.partitionBy(side)
        return F.pow(1 - w / F.sum("weight").over(by), F.count(F.lit(1)).over(by) - 1)

    out = edges.where(w > 0).withColumn("p", F.least(at("from"), at("to")))
    return out.where((F.col("p") < level) | (F.col("from") == F.col("to")))


def strengths(edges: DataFrame) -> DataFrame:
    """node, out_strength, in_strength, out_degree, in_degree."""
    w = F.col("weight")
    a = edges.select(F.col("from").alias("node"), w.alias("o"), F.lit(0.0).alias("i"), F.lit(1).alias("od"), F.lit(0).alias("id"))
    b = edges.select(F.col("to").alias("node"), F.lit(0.0).alias("o"), w.alias("i"), F.lit(0).alias("od"), F.lit(1).alias("id"))
    return a.union(b).groupBy("node").agg(F.sum("o").alias("out_strength"), F.sum("i").alias("in_strength"), F.sum("od").alias("out_degree"), F.sum("id").alias("in_degree"))


def aggregate_weights(edges: DataFrame, keys: Sequence[str], method: str, n_possible: Column | None = None) -> DataFrame:
    """Non-zero weights reduced for each key: sum, mean, median, max, min, prod, density, geomean."""
    w = F.col("weight")
    how = {"sum": F.sum(w), "mean": F.avg(w), "median": F.median(w), "max": F.max(w), "min": F.min(w), "prod": F.product(w), "geomean": F.exp(F.avg(F.log(w)))}
    value = F.sum(w) / (F.max(n_possible) if n_possible is not None else F.count(w)) if method == "density" else how[method]
    return edges.where((w != 0) & ~F.isnan(w)).groupBy(*keys).agg(value.alias("weight"))


def macro(edges: DataFrame, clusters: DataFrame, method: str = "sum") -> DataFrame:
    """Edges between clusters (node, cluster): all edges, loops included, reduced by cluster
    pair; density divides by the product of cluster sizes."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    of = clusters.join(sizes, "cluster")
    a = of.select(F.col("node").alias("from"), F.col("cluster").alias("cf"), F.col("size").alias("sf"))
    b = of.select(F.col("node").alias("to"), F.col("cluster").alias("ct"), F.col("size").alias("st"))
    joined = edges.join(a, "from").join(b, "to").withColumn("possible", F.col("sf") * F.col("st"))
    return aggregate_weights(joined, ["cf", "ct"], method, F.col("possible")).toDF("from", "to", "weight")


def within(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, from, to, weight: edges inside clusters, rows normalised."""
    a = clusters.select(F.col("node").alias("from"), "cluster")
    b = clusters.select(F.col("node").alias("to"), F.col("cluster").alias("ct"))
    inner = edges.join(a, "from").join(b, "to").where(F.col("cluster") == F.col("ct"))
    total = F.sum("weight").over(Window.partitionBy("cluster", "from"))
    return inner.select("cluster", "from", "to", (F.col("weight") / total).alias("weight"))
