"""More registered queries: comparisons, prunings, layers, and views of results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eventloom.functions.expressions import bounded
from eventloom.kernels import graphs, likeness, regression, topology
from eventloom.operators import clustering as cl
from eventloom.operators import higher_order as ho
from eventloom.operators import hypergraphs as hg
from eventloom.operators import networks as nw
from eventloom.operators import resampling as rs
from eventloom.operators import sequences as sq
from eventloom.operators import transactions as ta
from eventloom.operators import transitions as tr
from eventloom.plans.model_queries import _chain, _complex, _counts, _edge_rows, _matrix, _quarters
from eventloom.plans.network_queries import _RULES, _TWO, _two
from eventloom.plans.sequence_queries import _T, DAY_STATES, SEQ, P, S, _wide_turns, event_sequences
from eventloom.registry import register
from eventloom.session import read_table


@register(
    "mark_first_state",
    f"WITH {_T}, y AS (SELECT conv_id, pos, CASE WHEN pos > 2 THEN state END AS state FROM x), e AS (SELECT conv_id, min(pos) AS first FROM y WHERE state IS NOT NULL GROUP BY conv_id) SELECT y.conv_id, y.pos, CASE WHEN y.pos < e.first THEN 'Start' ELSE state END AS state FROM y LEFT JOIN e USING (conv_id)",
)
def mark_first_state(spark, sf_dir):
    late = _wide_turns(spark, sf_dir).withColumn("state", F.when(F.col("pos") > 2, F.col("state")))
    return sq.mark_ends(late, ["conv_id"], start="Start").select("conv_id", "pos", "state")


@register("parse_time", "SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events")
def parse_time(spark, sf_dir):
    text = read_table(spark, sf_dir, "events").select("event_id", F.date_format(F.date_trunc("second", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("t"))
    return sq.parse_time(text, "t").select("event_id", F.unix_seconds("t").alias("seconds"))


@register("transition_matrix_filled", f"WITH {P}, n AS (SELECT f AS s FROM c UNION SELECT t FROM c) SELECT a.s AS from_state, b.s AS to_state, round(coalesce(w / sum(w) OVER (PARTITION BY a.s), 0), 9) AS weight FROM n a CROSS JOIN n b LEFT JOIN c ON c.f = a.s AND c.t = b.s")
def transition_matrix_filled(spark, sf_dir):
    out = nw.filled(tr.relative(event_sequences(spark, sf_dir), SEQ))
    return out.select(F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.round("weight", 9).alias("weight"))


_SCALED = {
    "row": "w / sum(w) OVER (PARTITION BY f)", "frobenius": "w / sqrt(sum(w * w) OVER ())", "zscore": "(w - avg(w) OVER ()) / stddev_samp(w) OVER ()", "log": "ln(w)", "log1p": "ln(1 + w)",
    "quantile": "(rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0) / count(*) OVER ()", "robust": "(w - (SELECT median(w) FROM c)) / (1.4826 * (SELECT median(abs(w - (SELECT median(w) FROM c))) FROM c))",
}


def _comparison(method, sql):
    @register(f"compare_scaling_{method}", f"WITH {P} SELECT f AS from_state, t AS to_state, round({sql}, 6) AS weight FROM c")
    def query(spark, sf_dir):
        out = nw.comparison_scaling(tr.frequency(event_sequences(spark, sf_dir), SEQ), method)
        return out.select(F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.round("weight", 6).alias("weight"))


for _method, _sql in _SCALED.items():
    _comparison(_method, _sql)


@register("compare_likeness")
def compare_likeness(spark, sf_dir):
    x, y = (_matrix(e, DAY_STATES)[0] for e in _two(spark, sf_dir))
    a, b = x.reshape(-1), y.reshape(-1)
    rows = [(m, rs.correlation(a, b, m)) for m in ("pearson", "spearman", "kendall")] + [("distance_correlation", likeness.distance_correlation(x, y)), ("rv", likeness.rv(x, y))]
    return spark.createDataFrame(rows, "metric string, value double")


@register("compare_edges", f"{_TWO} SELECT f AS from_state, t AS to_state, round(x, 9) AS x, round(y, 9) AS y, round(x - y, 9) AS difference, round(abs(x - y), 9) AS distance FROM q")
def compare_edges(spark, sf_dir):
    a = nw.aligned(*_two(spark, sf_dir))
    d = F.col("x") - F.col("y")
    return a.select(F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round(d, 9).alias("difference"), F.round(F.abs(d), 9).alias("distance"))


@register("pruning_details")
def pruning_details(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    gone = (graphs.prune(p, 0.19) == 0) & (p != 0)
    return _edge_rows(spark, [{"from": states[i], "to": states[j], "weight": p[i, j]} for i, j in zip(*np.nonzero(gone), strict=True)], ["weight"])


@register("random_path_betweenness")
def random_path_betweenness(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    return spark.createDataFrame([(s, float(x)) for s, x in zip(states, graphs.random_path_betweenness(p), strict=True)], "state string, betweenness double")


@register("edge_betweenness_test")
def edge_betweenness_test(spark, sf_dir):
    out = rs.permutation_test(_counts(spark, sf_dir, True), SEQ, "grp", DAY_STATES, 30, transform=lambda m: graphs.edge_betweenness(rs.row_shares(m)))
    return _edge_rows(spark, out, ["difference", "effect", "p_value"])


@register("vertex_compare")
def vertex_compare(spark, sf_dir):
    x, y = (_matrix(e, DAY_STATES)[0] for e in _two(spark, sf_dir))
    stats = {"mean_weight": lambda w: float(w[w != 0].mean()) if (w != 0).any() else 0.0, "reciprocity": lambda w: float(np.minimum(w, w.T).sum() / w.sum()) if w.sum() else 0.0}
    out = []
    for a, b in zip(rs.vertex_bootstrap(x, stats, 200, 1), rs.vertex_bootstrap(y, stats, 200, 2), strict=True):
        sd = (a["sd"] ** 2 + b["sd"] ** 2) ** 0.5
        z = (a["observed"] - b["observed"]) / sd if sd else 0.0
        out.append((a["statistic"], a["observed"], b["observed"], z, 2 * rs_normal(abs(z))))
    return spark.createDataFrame(out, "statistic string, x double, y double, z double, p_value double")


def rs_normal(z):
    from eventloom.kernels.distributions import normal_sf

    return float(normal_sf(z))


@register("cluster_network")
def cluster_network(spark, sf_dir):
    """Sequences grouped by distance, then a network for each group."""
    rows = _quarters(spark, sf_dir)
    names, weight, d = cl.distance_matrix(rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")))
    labels = cl.linkage(d, 2, "ward.D2", weight)
    of = spark.createDataFrame([(t, int(k)) for t, k in zip(names, labels, strict=True)], "text string, cluster int")
    long = rows.join(F.broadcast(of), "text").select("o_custkey", "cluster", F.posexplode(F.split("text", "")).alias("pos", "state")).where("state <> ''")
    e = tr.relative(long.withColumn("state", F.when(F.col("state") != "-", F.col("state"))), ["o_custkey"], ["cluster"])
    return e.select("cluster", F.col("from").alias("from_state"), F.col("to").alias("to_state"), "weight")


@register("covariate_model")
def covariate_model(spark, sf_dir):
    """Which of two kinds of order a covariate goes with: counts of combinations are all that
    the model is given, however many orders there are."""
    o = read_table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("price"))
    o = sorted(bounded(o, 1000, "combinations"), key=lambda r: (r.o_orderstatus, r.o_orderpriority))
    levels = sorted({r.o_orderpriority for r in o})
    x = np.array([[1.0, *[float(r.o_orderpriority == v) for v in levels[1:]]] for r in o])
    y, n = np.array([int(r.o_orderstatus == "O") for r in o]), np.array([r.n for r in o], float)
    out = []
    for firth in (False, True):
        fit = regression.multinomial(x, y, n, firth)
        out += [("firth" if firth else "plain", term, float(fit["beta"][0, i]), float(fit["se"][0, i]), float(fit["odds_ratio"][0, i]), float(fit["p_value"][0, i])) for i, term in enumerate(["intercept", *levels[1:]])]
    return spark.createDataFrame(out, "kind string, term string, beta double, se double, odds_ratio double, p_value double")


@register("hypergraph_of_cliques")
def hypergraph_of_cliques(spark, sf_dir):
    w, states = _complex(spark, sf_dir)
    found = [c for c in topology.cliques(w >= np.median(w[w > 0]), 3) if len(c) > 1]
    rows = [(states[v], "+".join(states[u] for u in c), 1.0) for c in found for v in c]
    return hg.node_measures(spark.createDataFrame(rows, "node string, hyperedge string, weight double"))


@register("persistence_landscape")
def persistence_landscape(spark, sf_dir):
    w, _ = _complex(spark, sf_dir)
    pairs = topology.persistence(topology.filtration(np.where(w > 0, w.max() - w, np.inf)))
    grid = np.linspace(0, float(w.max()), 20)
    layers = topology.landscape([(b, d) for k, b, d in pairs if k == 0], grid, 3)
    return spark.createDataFrame([(float(t), *[float(x[i]) for x in layers]) for i, t in enumerate(grid)], "t double, first double, second double, third double")


@register("bottleneck_distance")
def bottleneck_distance(spark, sf_dir):
    diagrams = []
    for e in _two(spark, sf_dir):
        m, _ = _matrix(e, DAY_STATES)
        w = np.maximum(m, m.T)
        np.fill_diagonal(w, 0)
        diagrams.append([(b, d) for k, b, d in topology.persistence(topology.filtration(np.where(w > 0, 1 - w, np.inf))) if k == 0])
    return spark.createDataFrame([(0, float(topology.bottleneck(*diagrams)))], "dimension int, distance double")


@register("simplicial_degree")
def simplicial_degree(spark, sf_dir):
    w, states = _complex(spark, sf_dir)
    d = topology.simplicial_degree(topology.cliques(w >= np.median(w[w > 0])), len(states))
    return spark.createDataFrame([(s, *[int(x) for x in row]) for s, row in zip(states, d, strict=True)], "state string" + "".join(f", d{i} int" for i in range(d.shape[1])))


@register("rule_pathways", f"WITH {_RULES.split('SELECT array_to_string(lhs')[0].rstrip()}, z AS (SELECT lhs, rhs, k / ka AS conf, (k / ka) / (kb / total) AS lift, list_sort(list_concat(lhs, rhs)) AS items FROM v WHERE k / ka >= 0.3), y AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY items ORDER BY lift DESC, conf DESC, lhs) = 1) SELECT array_to_string(lhs, ' ') || ' -> ' || array_to_string(rhs, ' ') AS path, round(lift, 9) AS lift, round(conf, 9) AS confidence FROM y")
def rule_pathways(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return ta.rule_pathways(ta.association_rules(ta.from_long(lines.join(parts, "l_partkey"), "l_orderkey", "p_type"), 0.05, 0.3, 0.0, 3)).withColumns({c: F.round(c, 9) for c in ("lift", "confidence")})


@register("network_groups", f"WITH {P}, d AS (SELECT user_id % 3 AS g, f, t, count(*) AS n FROM p GROUP BY ALL) SELECT 'group ' || g AS model, f AS from_state, t AS to_state, CAST(n AS DOUBLE) AS weight FROM d")
def network_groups(spark, sf_dir):
    s = event_sequences(spark, sf_dir).withColumn("g", F.col("user_id") % 3)
    return tr.frequency(s, SEQ, ["g"]).select(F.concat(F.lit("group "), "g").alias("model"), F.col("from").alias("from_state"), F.col("to").alias("to_state"), "weight")


@register("expected_influence", f"WITH {P}, r AS (SELECT f, t, w / sum(w) OVER (PARTITION BY f) AS q FROM c) SELECT t AS state, round(sum(q), 9) AS influence FROM r WHERE f <> t GROUP BY t")
def expected_influence(spark, sf_dir):
    e = tr.relative(event_sequences(spark, sf_dir), SEQ).where(F.col("from") != F.col("to"))
    return e.groupBy(F.col("to").alias("state")).agg(F.round(F.sum("weight"), 9).alias("influence"))


@register("sojourn_lengths", f"WITH {S}, b AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY pos)), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id, session ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM b), l AS (SELECT state, count(*) AS k FROM r GROUP BY user_id, session, run, state) SELECT state, count(*) AS runs, round(avg(k), 9) AS mean_length, max(k) AS longest FROM l GROUP BY state")
def sojourn_lengths(spark, sf_dir):
    s = event_sequences(spark, sf_dir)
    w = sq.Window.partitionBy(*SEQ).orderBy("pos")
    s = s.withColumn("n", F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)).withColumn("run", F.sum("n").over(w.rowsBetween(sq.Window.unboundedPreceding, 0)))
    runs = s.groupBy(*SEQ, "run", "state").agg(F.count(F.lit(1)).alias("k"))
    return runs.groupBy("state").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("k"), 9).alias("mean_length"), F.max("k").alias("longest"))


