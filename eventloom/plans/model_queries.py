"""Registered queries whose last step is mathematics on small matrices, or resampling.

Some of what leads there can be said in SQL and is; the rest is tested against known
answers and properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eventloom.functions.expressions import bounded
from eventloom.kernels import chains, graphs, penalised, topology
from eventloom.operators import association as asn
from eventloom.operators import clustering as cl
from eventloom.operators import margins as mg
from eventloom.operators import mixtures as mx
from eventloom.operators import moderated as md
from eventloom.operators import near_sequences as ns
from eventloom.operators import networks as nw
from eventloom.operators import person_paths as pp
from eventloom.operators import resampling as rs
from eventloom.operators import transitions as tr
from eventloom.plans.graph_queries import dependencies_sql
from eventloom.plans.sequence_queries import DAY_STATES, SEQ, P, S, event_sequences
from eventloom.registry import register
from eventloom.session import read_table

EDGE = "from_state string, to_state string"


def _matrix(edges, states=None):
    """The dense matrix of a network's edges: as many rows as states."""
    rows = bounded(edges.select("from", "to", "weight"), 250_000, "edges")
    states = states or sorted({r["from"] for r in rows} | {r["to"] for r in rows})
    at = {s: i for i, s in enumerate(states)}
    m = np.zeros((len(states), len(states)))
    for r in rows:
        m[at[r["from"]], at[r["to"]]] = r.weight
    return m, states


def _chain(spark, sf_dir):
    return _matrix(tr.relative(event_sequences(spark, sf_dir), SEQ))


def _counts(spark, sf_dir, group=False):
    s = event_sequences(spark, sf_dir)
    if group:
        s = s.withColumn("grp", F.col("user_id") % 2)
    return rs.sequence_counts(s, SEQ, DAY_STATES, "grp" if group else None)


def _cells(spark, names, matrix, states, value="value"):
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(states) for j, b in enumerate(states)]
    return spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string, {value} double")


def _edge_rows(spark, rows, columns):
    return spark.createDataFrame([(r["from"], r["to"], *[float(r[c]) for c in columns]) for r in rows], EDGE + "".join(f", {c} double" for c in columns))


# ---- chains ---------------------------------------------------------------------------


@register("passage_time")
def passage_time(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    return _cells(spark, ("from_state", "to_state"), chains.passage_times(p), states, "steps")


@register("markov_stability")
def markov_stability(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    x = chains.stability(p)
    return spark.createDataFrame([(s, *[float(v[i]) for v in x.values()]) for i, s in enumerate(states)], "state string" + "".join(f", {k} double" for k in x))


@register("row_entropy", f"WITH {P}, r AS (SELECT f, w / sum(w) OVER (PARTITION BY f) AS p FROM c) SELECT f AS state, round(-sum(p * log2(p)), 9) AS row_entropy FROM r GROUP BY f")
def row_entropy(spark, sf_dir):
    return transition_entropy(spark, sf_dir).select("state", F.round("row_entropy", 9).alias("row_entropy"))


@register(
    "stationary_distribution",
    f"""WITH RECURSIVE {P}, r AS (SELECT f, t, w / sum(w) OVER (PARTITION BY f) AS p FROM c), n AS (SELECT DISTINCT f AS s FROM r),
    v AS (SELECT 0 AS i, s, 1.0 / (SELECT count(*) FROM n) AS x FROM n UNION ALL SELECT i + 1, s, x FROM (SELECT v.i, r.t AS s, sum(v.x * r.p) AS x FROM v JOIN r ON r.f = v.s WHERE v.i < 200 GROUP BY v.i, r.t))
    SELECT s AS state, round(x, 6) AS probability FROM v WHERE i = 200""",
)
def stationary_distribution(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    return spark.createDataFrame([(s, float(x)) for s, x in zip(states, chains.stationary(p), strict=True)], "state string, probability double").withColumn("probability", F.round("probability", 6))


@register("transition_entropy")
def transition_entropy(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    x = chains.entropies(p)
    return spark.createDataFrame([(s, float(x["rows"][i]), x["stationary_entropy"], x["entropy_rate"], x["redundancy"], x["maximum"]) for i, s in enumerate(states)], "state string, row_entropy double, stationary_entropy double, entropy_rate double, redundancy double, maximum double")


@register("chain_structure")
def chain_structure(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    x = chains.structure(p)
    rows = [(s, states[x["classes"][i]], x["recurrent"][i], x["absorbing"][i], x["period"][i], x["irreducible"], x["regular"], x["reversible"]) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "state string, class string, recurrent boolean, absorbing boolean, period int, irreducible boolean, regular boolean, reversible boolean")


@register("hitting_probabilities")
def hitting_probabilities(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    return _cells(spark, ("from_state", "to_state"), chains.hitting(p), states, "probability")


# ---- graphs ---------------------------------------------------------------------------


@register("net_centrality")
def net_centrality(spark, sf_dir):
    m, states = _matrix(tr.frequency(event_sequences(spark, sf_dir), SEQ))
    x = graphs.centralities(m)
    return spark.createDataFrame([(s, *[float(v[i]) for v in x.values()]) for i, s in enumerate(states)], "state string" + "".join(f", {k} double" for k in x))


#: The chain of states as a network of its own, whose states are all sources.
_STATES = f"u AS MATERIALIZED (WITH {P} SELECT f, t, w / z AS w FROM (SELECT f, t, w, sum(w) OVER (PARTITION BY f) AS z FROM c) WHERE f <> t)"
_ALL_STATES = f"v AS MATERIALIZED (WITH {P} SELECT f AS src FROM c UNION SELECT t FROM c)"


@register("net_edge_betweenness", f"WITH {dependencies_sql(_STATES, _ALL_STATES)} SELECT k.src AS from_state, l.src AS to_state, round(coalesce(sum(x.n), 0), 6) AS betweenness FROM v k CROSS JOIN v l LEFT JOIN x ON x.a = k.src AND x.b = l.src GROUP BY 1, 2")
def net_edge_betweenness(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    return _cells(spark, ("from_state", "to_state"), graphs.edge_betweenness(p), states, "betweenness").withColumn("betweenness", F.round("betweenness", 6))


def _shorter(k):
    return f"d{k} AS (SELECT f, t, min(d) AS d FROM (SELECT * FROM d{k - 1} UNION ALL SELECT a.f, b.t, a.d + b.d FROM d{k - 1} a JOIN d{k - 1} b ON a.t = b.f AND a.f <> b.t) GROUP BY f, t)"


@register(
    "network_summary",
    f"""WITH {P}, q AS (SELECT f, t, w / sum(w) OVER (PARTITION BY f) AS w FROM c), n AS (SELECT f AS s FROM q UNION SELECT t FROM q), m AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM n),
    d0 AS (SELECT f, t, w AS d FROM q WHERE f <> t), {_shorter(1)}, {_shorter(2)}, {_shorter(3)},
    i AS (SELECT s, coalesce((SELECT sum(w) FROM q WHERE f = s), 0) AS a, coalesce((SELECT sum(w) FROM q WHERE t = s), 0) AS b FROM n),
    r AS (SELECT sum(least(x.w, coalesce(y.w, 0))) / sum(x.w) AS r FROM q x LEFT JOIN q y ON y.f = x.t AND y.t = x.f WHERE x.f <> x.t),
    o AS (SELECT 'nodes' AS metric, n AS value FROM m UNION ALL SELECT 'edges', CAST(count(*) AS DOUBLE) FROM q UNION ALL SELECT 'density', least(1, (SELECT count(*) FROM q) / (n * (n - 1))) FROM m UNION ALL SELECT 'mean_distance', avg(d) FROM d3
    UNION ALL SELECT 'mean_in_strength', avg(a) FROM i UNION ALL SELECT 'sd_in_strength', stddev_samp(a) FROM i UNION ALL SELECT 'mean_out_strength', avg(b) FROM i UNION ALL SELECT 'sd_out_strength', stddev_samp(b) FROM i
    UNION ALL SELECT 'centralisation_in', sum(t - a) / ((count(*) - 1) * max(t)) FROM (SELECT a, max(a) OVER () AS t FROM i) UNION ALL SELECT 'centralisation_out', sum(t - b) / ((count(*) - 1) * max(t)) FROM (SELECT b, max(b) OVER () AS t FROM i) UNION ALL SELECT 'reciprocity', r FROM r)
    SELECT metric, round(value, 9) + 0.0 AS value FROM o""",
)
def network_summary(spark, sf_dir):
    m, _ = _chain(spark, sf_dir)
    rows = spark.createDataFrame([(k, float(v)) for k, v in graphs.summary(m).items()], "metric string, value double")
    return rows.withColumn("value", F.round("value", 9) + 0.0)


@register("net_prune")
def net_prune(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    return _cells(spark, ("from_state", "to_state"), graphs.prune(p, 0.19), states, "weight")


def _complex(spark, sf_dir):
    p, states = _chain(spark, sf_dir)
    w = np.maximum(p, p.T)
    np.fill_diagonal(w, 0)
    return w, states


@register("simplicial_complex")
def simplicial_complex(spark, sf_dir):
    w, states = _complex(spark, sf_dir)
    s = topology.cliques(w >= np.median(w[w > 0]))
    b = topology.betti(s)
    rows = [(d, sum(len(x) == d + 1 for x in s), b[d], topology.euler(s)) for d in range(len(b))]
    return spark.createDataFrame(rows, "dimension int, simplices int, betti int, euler int")


@register("persistent_homology")
def persistent_homology(spark, sf_dir):
    w, _ = _complex(spark, sf_dir)
    pairs = topology.persistence(topology.filtration(np.where(w > 0, w.max() - w, np.inf)))
    return spark.createDataFrame([(int(d), float(b), float(e)) for d, b, e in pairs], "dimension int, birth double, death double")


@register("q_analysis")
def q_analysis(spark, sf_dir):
    w, _ = _complex(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(topology.q_vector(topology.cliques(w >= np.median(w[w > 0]))))), "q int, components int")


@register("hypergraph_centrality")
def hypergraph_centrality(spark, sf_dir):
    """Nations that send orders of the same priorities, on the days they do."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", F.dayofweek("o_orderdate").alias("day"))
    o = orders.join(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    e = bounded(o.groupBy(F.col("c_nationkey").alias("u"), F.concat_ws("-", "o_orderpriority", "day").alias("kind")).agg(F.count(F.lit(1)).cast("double").alias("n")), 100_000, "cells of a hypergraph")
    users, kinds = sorted({r.u for r in e}), sorted({r.kind for r in e})
    m = np.zeros((len(users), len(kinds)))
    for r in e:
        m[users.index(r.u), kinds.index(r.kind)] = r.n
    x = {k: topology.hypergraph_centrality(m, k) for k in ("clique", "Z", "H")}
    return spark.createDataFrame([(int(u), *[float(v[i]) for v in x.values()]) for i, u in enumerate(users)], "node int, clique double, z double, h double")


# ---- association ----------------------------------------------------------------------

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[:i]]


@register("correlation_network", " UNION ALL ".join(f"SELECT '{b}' AS from_state, '{a}' AS to_state, round(corr({a}, {b}), 6) AS weight FROM lineitem WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NUMBERS)}" for a, b in _PAIRS))
def correlation_network(spark, sf_dir):
    rows = asn.network(read_table(spark, sf_dir, "lineitem").select(*NUMBERS), NUMBERS, "cor")
    return _edge_rows(spark, rows, ["weight"]).withColumn("weight", F.round("weight", 6))


@register("partial_correlation_network")
def partial_correlation_network(spark, sf_dir):
    return _edge_rows(spark, asn.network(read_table(spark, sf_dir, "lineitem").select(*NUMBERS), NUMBERS, "pcor"), ["weight"])


THREE = NUMBERS[:3]
_R3 = f"r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem WHERE {' AND '.join(f'{c} IS NOT NULL' for c in THREE)})"


@register(
    "partial_correlation_of_three",
    f"WITH {_R3} SELECT 'l_quantity' AS from_state, 'l_extendedprice' AS to_state, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS weight FROM r UNION ALL SELECT 'l_quantity', 'l_discount', round((b - a * c) / sqrt((1 - a * a) * (1 - c * c)), 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_discount', round((c - a * b) / sqrt((1 - a * a) * (1 - b * b)), 6) FROM r",
)
def partial_correlation_of_three(spark, sf_dir):
    rows = asn.network(read_table(spark, sf_dir, "lineitem").select(*THREE), THREE, "pcor")
    return _edge_rows(spark, rows, ["weight"]).withColumn("weight", F.round("weight", 6))


@register(
    "predictability_of_three",
    f"WITH {_R3} SELECT 'l_quantity' AS node, round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) AS r2 FROM r UNION ALL SELECT 'l_extendedprice', round((a * a + c * c - 2 * a * b * c) / (1 - b * b), 6) FROM r UNION ALL SELECT 'l_discount', round((b * b + c * c - 2 * a * b * c) / (1 - a * a), 6) FROM r",
)
def predictability_of_three(spark, sf_dir):
    r, _ = asn.correlations(read_table(spark, sf_dir, "lineitem").select(*THREE), THREE)
    return spark.createDataFrame([(c, float(x)) for c, x in zip(THREE, penalised.predictability(np.linalg.inv(r)), strict=True)], "node string, r2 double").withColumn("r2", F.round("r2", 6))


@register(
    "prediction_errors",
    f"WITH {_R3}, v AS (SELECT stddev_samp(l_quantity) AS q, stddev_samp(l_extendedprice) AS p, stddev_samp(l_discount) AS d FROM lineitem WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NUMBERS)}) SELECT 'l_quantity' AS node, round(q * sqrt(1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)), 5) AS rmse FROM r, v UNION ALL SELECT 'l_extendedprice', round(p * sqrt(1 - (a * a + c * c - 2 * a * b * c) / (1 - b * b)), 5) FROM r, v UNION ALL SELECT 'l_discount', round(d * sqrt(1 - (b * b + c * c - 2 * a * b * c) / (1 - a * a)), 5) FROM r, v",
)
def prediction_errors(spark, sf_dir):
    rows = asn.complete(read_table(spark, sf_dir, "lineitem").select(*NUMBERS), NUMBERS)
    r, _ = asn.correlations(rows.select(*THREE), THREE)
    sd = np.array(rows.agg(*[F.stddev_samp(c) for c in THREE]).first())
    error = penalised.prediction_error(penalised.predictability(np.linalg.inv(r)), sd)
    return spark.createDataFrame([(c, round(float(x), 5)) for c, x in zip(THREE, error, strict=True)], "node string, rmse double")


_RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUMBERS)


@register("rank_correlation_network", f"WITH k AS (SELECT {_RANKED} FROM lineitem WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NUMBERS)}) " + " UNION ALL ".join(f"SELECT '{b}' AS from_state, '{a}' AS to_state, round(corr({a}, {b}), 6) AS weight FROM k" for a, b in _PAIRS))
def rank_correlation_network(spark, sf_dir):
    rows = asn.network(read_table(spark, sf_dir, "lineitem").select(*NUMBERS), NUMBERS, "cor", cor_method="spearman")
    return _edge_rows(spark, rows, ["weight"]).withColumn("weight", F.round("weight", 6))


@register(
    "concordance_network",
    """WITH c AS (SELECT l_discount AS x, l_tax AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT a.n * b.n AS w, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM c a CROSS JOIN c b) SELECT 'l_discount' AS from_state, 'l_tax' AS to_state, round(sum(w * dx * dy) / sqrt(sum(w * dx * dx) * sum(w * dy * dy)), 6) AS weight FROM p""",
)
def concordance_network(spark, sf_dir):
    names = ["l_discount", "l_tax"]
    rows = asn.network(read_table(spark, sf_dir, "lineitem").select(*names), names, "cor", cor_method="kendall")
    return _edge_rows(spark, rows, ["weight"]).withColumn("weight", F.round("weight", 6))


@register(
    "concordance_of_prices",
    """WITH r AS (SELECT l_quantity AS q, l_extendedprice AS p, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY ALL), k AS (SELECT DISTINCT q FROM r), v AS (SELECT DISTINCT p FROM r),
    g AS (SELECT v.p, k.q, coalesce(r.n, 0) AS n FROM v CROSS JOIN k LEFT JOIN r ON r.p = v.p AND r.q = k.q), c AS (SELECT p, q, n, sum(n) OVER (PARTITION BY q ORDER BY p) - n AS less, sum(n) OVER (PARTITION BY q) AS total FROM g),
    u AS (SELECT p, q, n, less, total - less - n AS more FROM c), z AS (SELECT n, sum(less - more) OVER (PARTITION BY p ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM u),
    a AS (SELECT CAST(sum(n * s) AS DOUBLE) AS s, CAST(sum(n) AS DOUBLE) AS t FROM z), x AS (SELECT CAST(sum(m * m) AS DOUBLE) AS x FROM (SELECT sum(n) AS m FROM r GROUP BY q)), y AS (SELECT CAST(sum(m * m) AS DOUBLE) AS y FROM (SELECT sum(n) AS m FROM r GROUP BY p))
    SELECT 'l_quantity' AS from_state, 'l_extendedprice' AS to_state, round(2 * s / sqrt((t * t - x) * (t * t - y)), 6) AS weight FROM a, x, y""",
)
def concordance_of_prices(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice"]
    rows = asn.network(read_table(spark, sf_dir, "lineitem").select(*names), names, "cor", cor_method="kendall")
    return _edge_rows(spark, rows, ["weight"]).withColumn("weight", F.round("weight", 6))


def _order_measures(spark, sf_dir):
    """Each order's lines, those returned, and sums over them: numbers that go together."""
    li = read_table(spark, sf_dir, "lineitem")
    back = F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("returned")
    per = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("lines"), back, F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"))
    return per.drop("l_orderkey"), ["lines", "returned", "quantity", "price"]


_MEASURES = "o AS (SELECT CAST(count(*) AS DOUBLE) AS lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS returned, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey)"
_MEASURED = ["lines", "returned", "quantity", "price"]


@register("order_correlations", f"WITH {_MEASURES} " + " UNION ALL ".join(f"SELECT '{b}' AS from_state, '{a}' AS to_state, round(corr({a}, {b}), 6) AS weight FROM o" for i, a in enumerate(_MEASURED) for b in _MEASURED[:i]))
def order_correlations(spark, sf_dir):
    df, columns = _order_measures(spark, sf_dir)
    return _edge_rows(spark, asn.network(df, columns, "cor"), ["weight"]).withColumn("weight", F.round("weight", 6))


@register("glasso_network")
def glasso_network(spark, sf_dir):
    df, columns = _order_measures(spark, sf_dir)
    return _edge_rows(spark, asn.network(df, columns, "glasso"), ["weight"])


def _patterns(spark, sf_dir):
    """Which states a sequence has, as 0/1 columns, and how many sequences have just these."""
    hot = event_sequences(spark, sf_dir).groupBy(*SEQ).agg(*[F.max((F.col("state") == x).cast("int")).alias(x) for x in DAY_STATES])
    return hot.groupBy(*DAY_STATES).agg(F.count(F.lit(1)).alias("n"))


_HOT = ", ".join(f"CAST(max(CASE WHEN state = '{x}' THEN 1 ELSE 0 END) AS INTEGER) AS {x}" for x in DAY_STATES)


@register("presence_patterns", f"WITH {S}, hot AS (SELECT user_id, session, {_HOT} FROM s GROUP BY user_id, session) SELECT {', '.join(DAY_STATES)}, count(*) AS n FROM hot GROUP BY {', '.join(DAY_STATES)}")
def presence_patterns(spark, sf_dir):
    return _patterns(spark, sf_dir)


@register("ising_network")
def ising_network(spark, sf_dir):
    rows = bounded(_patterns(spark, sf_dir), 1 << len(DAY_STATES), "patterns")
    x = np.array([list(r) for r in sorted(rows)], float)
    w = penalised.ising(x[:, :-1], steps=20, weight=x[:, -1])
    rows = [{"from": DAY_STATES[j], "to": DAY_STATES[i], "weight": w[i, j]} for i in range(len(w)) for j in range(i)]
    return _edge_rows(spark, rows, ["weight"])


@register("mixed_network")
def mixed_network(spark, sf_dir):
    # an order has few lines, so combinations of their numbers and of the flag are few too
    names = ["suppliers", "open", "accepted", "returned"]
    line = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, 1.0).otherwise(0.0))
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").cast("double").alias("suppliers"), line("N").alias("open"), line("A").alias("accepted"), (line("R") > 0).cast("double").alias("returned"))
    x = np.array([list(r) for r in sorted(bounded(li.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), 20000, "combinations of values"))], float)
    w = penalised.mixed(x[:, :-1], ["g"] * 3 + ["c"], steps=20, weight=x[:, -1])
    return _edge_rows(spark, [{"from": names[j], "to": names[i], "weight": w[i, j]} for i in range(4) for j in range(i)], ["weight"])


@register("moderated_network")
def moderated_network(spark, sf_dir):
    """Edges between an order's other measures where none, one and three of its lines came back."""
    df, columns = _order_measures(spark, sf_dir)
    model = md.fit(df, columns, "returned")
    return md.networks(spark, model, [0.0, 1.0, 3.0]).withColumnsRenamed({"from": "from_state", "to": "to_state"})


@register(
    "moderated_moments",
    f"""WITH {_MEASURES}, a AS (SELECT avg(lines) AS ml, stddev_samp(lines) AS sl, avg(quantity) AS mq, stddev_samp(quantity) AS sq, avg(price) AS mp, stddev_samp(price) AS sp FROM o),
    z AS (SELECT (lines - ml) / sl AS l, (quantity - mq) / sq AS q, (price - mp) / sp AS p FROM o, a)
    SELECT x AS term, y AS "with", round(v, 6) AS mean_product FROM (SELECT 'quantity' AS x, 'lines*price' AS y, avg(q * l * p) AS v FROM z UNION ALL SELECT 'lines*quantity', 'lines*price', avg(l * q * l * p) FROM z UNION ALL SELECT 'price', 'quantity', avg(p * q) FROM z)""",
)
def moderated_moments(spark, sf_dir):
    """Three of the sums of products that the moderated network is fitted to."""
    df, _ = _order_measures(spark, sf_dir)
    names = ["lines", "quantity", "price"]
    rows = asn.complete(df, names)
    about = rows.agg(*[f(c) for c in names for f in (F.avg, F.stddev_samp)]).first()
    terms = [(0,), (1,), (2,), (0, 1), (0, 2)]
    x = md.product_moments(rows, names, np.array(about[::2]), np.array(about[1::2]), terms)
    x = x / x[0, 0]
    out = [("quantity", "lines*price", x[2, 5]), ("lines*quantity", "lines*price", x[4, 5]), ("price", "quantity", x[3, 2])]
    return spark.createDataFrame([(a, b, round(float(v), 6)) for a, b, v in out], "term string, with string, mean_product double")


def _days(spark, sf_dir):
    """Each user's days: events, their mean value and the hours between the first and last."""
    e = read_table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    hours = (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 3.6e9
    return e.agg(F.count(F.lit(1)).cast("double").alias("events"), F.avg("value").alias("value"), hours.alias("hours"))


DAY_MEASURES = ["events", "value", "hours"]
_DAYS = "d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS events, avg(value) AS value, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours FROM events GROUP BY ALL)"


@register(
    "person_moments",
    f"""WITH {_DAYS}, l AS (SELECT *, lag(events) OVER w AS events0, lag(value) OVER w AS value0, lag(hours) OVER w AS hours0 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    c AS (SELECT * FROM l WHERE events IS NOT NULL AND value IS NOT NULL AND hours IS NOT NULL AND events0 IS NOT NULL AND value0 IS NOT NULL AND hours0 IS NOT NULL)
    SELECT user_id AS person, count(*) AS n, round(covar_pop(events, events0), 6) AS events_events0, round(covar_pop(hours, value0), 6) AS hours_value0, round(var_pop(hours), 6) AS hours_hours FROM c GROUP BY user_id
    HAVING count(*) >= 2 AND var_pop(events) > 0 AND var_pop(value) > 0 AND var_pop(hours) > 0 AND var_pop(events0) > 0 AND var_pop(value0) > 0 AND var_pop(hours0) > 0""",
)
def person_moments(spark, sf_dir):
    """Some of the covariances that a person's path model is fitted to."""
    m = pp.person_moments(_days(spark, sf_dir), "user_id", ["day"], DAY_MEASURES)
    return m.select("person", "n", *[F.round(F.col("cov")[6 * i + j], 6).alias(name) for i, j, name in ((0, 3, "events_events0"), (2, 4, "hours_value0"), (2, 2, "hours_hours"))])


@register("person_paths")
def person_paths(spark, sf_dir):
    return pp.person_paths(_days(spark, sf_dir), "user_id", ["day"], DAY_MEASURES)


@register("path_shares")
def path_shares(spark, sf_dir):
    return pp.path_shares(person_paths(spark, sf_dir))


@register("predictability")
def predictability(spark, sf_dir):
    r, _ = asn.correlations(read_table(spark, sf_dir, "lineitem").select(*NUMBERS), NUMBERS)
    return spark.createDataFrame([(c, float(x)) for c, x in zip(NUMBERS, penalised.predictability(np.linalg.inv(r)), strict=True)], "node string, r2 double")


def _embedding_columns(spark, sf_dir):
    """All components of the vectors."""
    e = read_table(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    return e.select(*[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(n)]), [f"v{i}" for i in range(n)]


@register("multilevel_between", "SELECT user_id, round(avg(value), 6) AS value FROM events GROUP BY user_id")
def multilevel_between(spark, sf_dir):
    return asn.between_within(read_table(spark, sf_dir, "events").select("user_id", "value"), "user_id", ["value"], "between").withColumn("value", F.round("value", 6))


@register("multilevel_within", "SELECT user_id, round(value - m, 9) AS value FROM (SELECT user_id, value, avg(value) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 2")
def multilevel_within(spark, sf_dir):
    return asn.between_within(read_table(spark, sf_dir, "events").select("user_id", "value"), "user_id", ["value"], "within").withColumn("value", F.round("value", 9))


def _panel(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), F.hour("ts").alias("h"), "value", F.length("event_type").cast("double").alias("size"))
    return e.groupBy((F.col("user_id") % 30).alias("person"), F.dayofmonth("d").alias("day"), (F.col("h") / 4).cast("int").alias("beep")).agg(F.avg("value").alias("value"), F.avg("size").alias("size"))


_PANEL = "b AS (SELECT user_id % 30 AS person, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) // 4 AS INTEGER) AS beep, avg(value) AS value, avg(length(event_type)) AS size FROM events GROUP BY 1, 2, 3)"


@register(
    "lagged_grid",
    f"""WITH {_PANEL}, g AS (SELECT person, day, CAST(unnest(range(min(beep), max(beep) + 1)) AS INTEGER) AS beep FROM b GROUP BY person, day), j AS (SELECT g.person, g.day, g.beep, b.value FROM g LEFT JOIN b USING (person, day, beep)),
    l AS (SELECT *, lag(value) OVER (PARTITION BY person, day ORDER BY beep) AS lv FROM j), c AS (SELECT *, lv - avg(lv) OVER (PARTITION BY person) AS lag_value, avg(value) OVER (PARTITION BY person) AS mean_value FROM l)
    SELECT person, day, beep, round(value, 6) AS value, round(lag_value, 6) AS lag_value, round(mean_value, 6) AS mean_value FROM c WHERE value IS NOT NULL AND lag_value IS NOT NULL""",
)
def lagged_grid(spark, sf_dir):
    out = asn.lagged_grid(_panel(spark, sf_dir), "person", "day", "beep", ["value"])
    return out.select("person", "day", "beep", *[F.round(c, 6).alias(c) for c in ("value", "lag_value", "mean_value")])


@register("multilevel_lag_network")
def multilevel_lag_network(spark, sf_dir):
    names = ["value", "size"]
    x = asn.multilevel_lag_network(_panel(spark, sf_dir), "person", "day", "beep", names)
    rows = [(kind, a, b, float(x[kind][i, j])) for kind in ("temporal", "contemporaneous", "between") for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "network string, outcome string, predictor string, weight double")


@register("multilevel_coefficients")
def multilevel_coefficients(spark, sf_dir):
    x = asn.multilevel_lag_network(_panel(spark, sf_dir), "person", "day", "beep", ["value", "size"])
    return spark.createDataFrame([tuple(r.values()) for r in x["coefficients"]], "outcome string, predictor string, beta double, se double, t double, p double, low double, high double")


@register("magnitude_difference", f"WITH {P} SELECT f AS from_state, t AS to_state, round(w / max(w) OVER (), 9) AS count_share, round(w / sum(w) OVER (PARTITION BY f), 9) AS probability, round(abs(w / max(w) OVER () - w / sum(w) OVER (PARTITION BY f)), 9) AS difference FROM c")
def magnitude_difference(spark, sf_dir):
    out = asn.magnitude_difference(event_sequences(spark, sf_dir), SEQ)
    return out.select(F.col("from").alias("from_state"), F.col("to").alias("to_state"), *[F.round(c, 9).alias(c) for c in ("count_share", "probability", "difference")])


# ---- resampling -----------------------------------------------------------------------


@register("bootstrap_network")
def bootstrap_network(spark, sf_dir):
    observed, boot = rs.collect_replicates(_counts(spark, sf_dir), SEQ, DAY_STATES, 200, 7)
    return _edge_rows(spark, rs.bootstrap_table(observed, boot, DAY_STATES), ["weight", "mean", "sd", "low", "high", "p_value"])


@register("permutation_test")
def permutation_test(spark, sf_dir):
    rows = rs.permutation_test(_counts(spark, sf_dir, True), SEQ, "grp", DAY_STATES, 200, 3, "BH")
    return _edge_rows(spark, rows, ["difference", "effect", "p_value"])


@register("network_reliability")
def network_reliability(spark, sf_dir):
    rows = rs.split_half(_counts(spark, sf_dir), SEQ, DAY_STATES, 100)
    return spark.createDataFrame([(i, *[float(v) for v in r.values()]) for i, r in enumerate(rows)], "iteration int, mean_abs double, median_abs double, pearson double, max_abs double")


@register("casedrop_reliability")
def casedrop_reliability(spark, sf_dir):
    rows = rs.case_drop(_counts(spark, sf_dir).cache(), SEQ, DAY_STATES, 50)
    return spark.createDataFrame([tuple(float(v) for v in r.values()) for r in rows], "drop double, mean double, sd double, share_above double, coefficient double")


@register("centrality_stability")
def centrality_stability(spark, sf_dir):
    rows = rs.case_drop(_counts(spark, sf_dir).cache(), SEQ, DAY_STATES, 50, method="pearson", measure=lambda m: m.sum(0))
    return spark.createDataFrame([tuple(float(v) for v in r.values()) for r in rows], "drop double, mean double, sd double, share_above double, coefficient double")


def _count_matrix(spark, sf_dir, where="true"):
    return _matrix(tr.frequency(event_sequences(spark, sf_dir).where(where), SEQ), DAY_STATES)[0]


@register("certainty")
def certainty(spark, sf_dir):
    return _edge_rows(spark, rs.certainty(_count_matrix(spark, sf_dir), DAY_STATES), ["weight", "mean", "sd", "low", "high", "p_value"])


@register("bayes_compare")
def bayes_compare(spark, sf_dir):
    rows = rs.bayes_compare(_count_matrix(spark, sf_dir, "user_id % 2 = 0"), _count_matrix(spark, sf_dir, "user_id % 2 = 1"), DAY_STATES)
    return _edge_rows(spark, rows, ["difference", "low", "high", "direction", "p_value"])


@register("vertex_bootstrap")
def vertex_bootstrap(spark, sf_dir):
    m, _ = _chain(spark, sf_dir)
    rows = rs.vertex_bootstrap(m, {"density": lambda w: float((w != 0).mean()), "mean_weight": lambda w: float(w[w != 0].mean()) if (w != 0).any() else 0.0}, 200)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "statistic string, observed double, mean double, sd double, low double, high double")


# ---- clusters -------------------------------------------------------------------------


QUARTERS = ["1", "2", "3", "4", "5", "-"]


def _quarters(spark, sf_dir):
    """Customers as sequences of four: their commonest order priority in each quarter of a
    year, or none. There are 6 ** 4 kinds of these however many customers there are."""
    o = read_table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL")
    n = o.groupBy("o_custkey", F.quarter("o_orderdate").alias("pos"), F.substring("o_orderpriority", 1, 1).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("o_custkey", "pos").agg(F.min(F.struct(-F.col("n"), "state")).alias("top")).select("o_custkey", "pos", "top.state")
    wide = best.groupBy("o_custkey").agg(*[F.coalesce(F.max(F.when(F.col("pos") == k, F.col("state"))), F.lit("-")).alias(f"q{k}") for k in range(1, 5)])
    return wide.select("o_custkey", F.concat("q1", "q2", "q3", "q4").alias("text"))


def _texts(spark, sf_dir):
    return _quarters(spark, sf_dir).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


_QUARTERS = """m AS (SELECT o_custkey, quarter(o_orderdate) AS pos, substr(o_orderpriority, 1, 1) AS state, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL),
b AS (SELECT o_custkey, pos, state FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey, pos ORDER BY n DESC, state) = 1),
w AS (SELECT o_custkey, concat(coalesce(max(state) FILTER (WHERE pos = 1), '-'), coalesce(max(state) FILTER (WHERE pos = 2), '-'), coalesce(max(state) FILTER (WHERE pos = 3), '-'), coalesce(max(state) FILTER (WHERE pos = 4), '-')) AS x FROM b GROUP BY o_custkey),
q AS (SELECT x, count(*) AS n FROM w GROUP BY x)"""


@register("distinct_sequences", f"WITH {_QUARTERS} SELECT x AS text, n FROM q")
def distinct_sequences(spark, sf_dir):
    return _texts(spark, sf_dir)


def _session_texts(spark, sf_dir):
    """Sessions as texts, a letter for each event."""
    s = event_sequences(spark, sf_dir)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.substring("state", 1, 1).alias("c")))), lambda e: e["c"]), "")
    return s.groupBy(*SEQ).agg(letters.alias("text")).select("text")


_SESSION_TEXTS = S + ", x AS (SELECT DISTINCT string_agg(state[1], '' ORDER BY pos) AS t FROM s GROUP BY user_id, session)"


@register("near_sequences", f"WITH {_SESSION_TEXTS} SELECT a.t AS a, b.t AS b, CAST(levenshtein(a.t, b.t) AS INTEGER) AS d FROM x a JOIN x b ON a.t < b.t AND abs(length(a.t) - length(b.t)) <= 2 WHERE levenshtein(a.t, b.t) <= 2")
def near_sequences(spark, sf_dir):
    return ns.near_pairs(_session_texts(spark, sf_dir), 2)


@register("near_sequences_share")
def near_sequences_share(spark, sf_dir):
    return ns.share_compared(_session_texts(spark, sf_dir), 2)


@register("distance_levenshtein", f"WITH {_QUARTERS} SELECT a.x AS a, b.x AS b, CAST(levenshtein(a.x, b.x) AS DOUBLE) AS d FROM q a JOIN q b ON a.x < b.x")
def distance_levenshtein(spark, sf_dir):
    return cl.distances(_texts(spark, sf_dir), "lv")


@register("distance_hamming", f"WITH {_QUARTERS} SELECT a.x AS a, b.x AS b, CAST(hamming(a.x, b.x) AS DOUBLE) AS d FROM q a JOIN q b ON a.x < b.x")
def distance_hamming(spark, sf_dir):
    return cl.distances(_texts(spark, sf_dir), "hamming")


_PAIR_GRAMS = _QUARTERS + ", gr AS (SELECT x, substr(x, i, 2) AS gram, count(*) AS c FROM (SELECT x, unnest(range(1, length(x))) AS i FROM q) GROUP BY ALL)"


@register("distance_jaccard", f"WITH {_PAIR_GRAMS}, l AS (SELECT x, list(gram) AS g FROM gr GROUP BY x) SELECT a.x AS a, b.x AS b, round(1 - len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) AS d FROM l a JOIN l b ON a.x < b.x")
def distance_jaccard(spark, sf_dir):
    return cl.distances(_texts(spark, sf_dir), "jaccard").withColumn("d", F.round("d", 9))


@register(
    "distance_cosine",
    f"WITH {_PAIR_GRAMS}, n AS (SELECT x, sqrt(sum(c * c)) AS r FROM gr GROUP BY x), mm AS (SELECT a.x AS a, b.x AS b, sum(a.c * b.c) AS k FROM gr a JOIN gr b ON a.gram = b.gram AND a.x < b.x GROUP BY 1, 2) SELECT u.x AS a, v.x AS b, round(1 - coalesce(k, 0) / (u.r * v.r), 6) + 0.0 AS d FROM n u JOIN n v ON u.x < v.x LEFT JOIN mm ON mm.a = u.x AND mm.b = v.x",
)
def distance_cosine(spark, sf_dir):
    return cl.distances(_texts(spark, sf_dir), "cosine").withColumn("d", F.round("d", 6) + 0.0)


@register(
    "distance_qgram",
    f"WITH {_PAIR_GRAMS}, n AS (SELECT x, sum(c) AS n FROM gr GROUP BY x), mm AS (SELECT a.x AS a, b.x AS b, sum(least(a.c, b.c)) AS k FROM gr a JOIN gr b ON a.gram = b.gram AND a.x < b.x GROUP BY 1, 2) SELECT a.x AS a, b.x AS b, CAST(coalesce(na.n, 0) + coalesce(nb.n, 0) - 2 * coalesce(mm.k, 0) AS DOUBLE) AS d FROM q a JOIN q b ON a.x < b.x LEFT JOIN n na ON na.x = a.x LEFT JOIN n nb ON nb.x = b.x LEFT JOIN mm ON mm.a = a.x AND mm.b = b.x",
)
def distance_qgram(spark, sf_dir):
    return cl.distances(_texts(spark, sf_dir), "qgram")


@register("distance_edit")
def distance_edit(spark, sf_dir):
    texts, out = _texts(spark, sf_dir), None
    for kind in ("osa", "dl", "lcs", "jw"):
        part = cl.distances(texts, kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@register("build_clusters")
def build_clusters(spark, sf_dir):
    names, weight, d = cl.distance_matrix(_texts(spark, sf_dir))
    _, pam = cl.pam(d, 3, weight)
    ward = cl.linkage(d, 3, "ward.D2", weight)
    s = cl.silhouette(d, pam, weight)
    return spark.createDataFrame([(n, int(w), int(a), int(b), float(x)) for n, w, a, b, x in zip(names, weight, pam, ward, s, strict=True)], "sequence string, n long, pam int, ward int, silhouette double")


@register("cluster_choice")
def cluster_choice(spark, sf_dir):
    _, weight, d = cl.distance_matrix(_texts(spark, sf_dir))
    out = []
    for k in (2, 3, 4):
        for method in ("pam", "ward.D2", "average", "complete"):
            labels = cl.pam(d, k, weight)[1] if method == "pam" else cl.linkage(d, k, method, weight)
            size = np.bincount(labels, weights=weight, minlength=k)
            out.append((k, method, float(np.average(cl.silhouette(d, labels, weight), weights=weight)), int(size.min()), int(size.max())))
    return spark.createDataFrame(out, "k int, method string, silhouette double, smallest int, largest int")


def _mixture_rows(spark, sf_dir, covariates=False):
    s = event_sequences(spark, sf_dir)
    about = s.groupBy(*SEQ).agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("events")) if covariates else None
    return mx.sequence_rows(s, SEQ, DAY_STATES, about, MIXTURE_TERMS if covariates else ())


MIXTURE_TERMS = ["mean_value", "events"]


@register("mixture_model")
def mixture_model(spark, sf_dir):
    rows = _mixture_rows(spark, sf_dir)
    out = []
    for k, m in mx.fit(rows, DAY_STATES, [1, 2, 3], 3, 30, 1e-3).items():
        q = mx.quality(mx.assigned(rows, m), m).first()
        out.append((k, m.log_likelihood, m.aic, m.bic, q.icl, q.entropy, q.mean_posterior, float(m.share.max())))
    return spark.createDataFrame(out, "k int, log_likelihood double, aic double, bic double, icl double, entropy double, mean_posterior double, largest_share double")


@register(
    "mixture_single",
    f"""WITH {P}, n AS (SELECT unnest({DAY_STATES}) AS x), w2 AS (SELECT a.x AS f, b.x AS t, coalesce(w, 0) AS w FROM n a CROSS JOIN n b LEFT JOIN c ON c.f = a.x AND c.t = b.x), q AS (SELECT w, (w + 0.01) / sum(w + 0.01) OVER (PARTITION BY f) AS p FROM w2),
    h0 AS (SELECT state, count(*) AS k FROM s WHERE pos = 1 GROUP BY state), i AS (SELECT coalesce(k, 0) AS k FROM n LEFT JOIN h0 ON state = x), j AS (SELECT k, (k + 0.01) / sum(k + 0.01) OVER () AS p FROM i),
    l AS (SELECT (SELECT sum(w * ln(p)) FROM q) + (SELECT sum(k * ln(p)) FROM j) AS ll, (SELECT sum(k) FROM j) AS m)
    SELECT 1 AS k, round(ll, 4) AS log_likelihood, round(2 * 24 - 2 * ll, 4) AS aic, round(24 * ln(m) - 2 * ll, 4) AS bic FROM l""",
)
def mixture_single(spark, sf_dir):
    """The mixture of one component, which is the chain of all sequences."""
    m = mx.fit(_mixture_rows(spark, sf_dir), DAY_STATES, [1], 1, 3)[1]
    return spark.createDataFrame([(1, *[round(x, 4) for x in (m.log_likelihood, m.aic, m.bic)])], "k int, log_likelihood double, aic double, bic double")


@register("mixture_covariates")
def mixture_covariates(spark, sf_dir):
    m = mx.fit(_mixture_rows(spark, sf_dir, True), DAY_STATES, [2], 3, 20, 1e-6, terms=MIXTURE_TERMS)[2]
    return mx.coefficients(spark, m, MIXTURE_TERMS)


@register("component_networks")
def component_networks(spark, sf_dir):
    m = mx.fit(_mixture_rows(spark, sf_dir), DAY_STATES, [2], 3, 20, 1e-3)[2]
    return mx.networks(spark, m).select("component", "share", F.col("from").alias("from_state"), F.col("to").alias("to_state"), "weight")


@register("component_sizes")
def component_sizes(spark, sf_dir):
    """Sequences by the component that they most likely come from."""
    rows = _mixture_rows(spark, sf_dir, True)
    found = mx.assigned(rows, mx.fit(rows, DAY_STATES, [2], 3, 20, 1e-6, terms=MIXTURE_TERMS)[2])
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("posterior")).alias("mean_posterior"), F.avg(F.col("x")[1]).alias("mean_events"))


_CONT = "c AS (SELECT o_orderpriority AS \"row\", o_orderstatus AS \"column\", count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY \"row\") AS r, sum(n) OVER (PARTITION BY \"column\") AS k, sum(n) OVER () AS t FROM c)"


@register("contingency_residuals", f"WITH {_CONT} SELECT \"row\", \"column\", n AS count, round(r * k / t, 6) AS expected, round((n - r * k / t) / sqrt(r * k / t * (1 - r / t) * (1 - k / t)), 6) AS residual FROM t")
def contingency_residuals(spark, sf_dir):
    out = cl.contingency(read_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return out.select("row", "column", "count", F.round("expected", 6).alias("expected"), F.round("residual", 6).alias("residual"))


@register(
    "mosaic_cells",
    """WITH f AS (SELECT o_orderpriority AS a, c_nationkey AS b, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), k AS (SELECT a, b, n FROM f QUALIFY sum(n) OVER (PARTITION BY a) >= 10 AND sum(n) OVER (PARTITION BY b) >= 10),
    g AS (SELECT x.a, y.b, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT a FROM k) x CROSS JOIN (SELECT DISTINCT b FROM k) y LEFT JOIN k ON k.a = x.a AND k.b = y.b), t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c, sum(n) OVER () AS t FROM g)
    SELECT a AS "row", b AS "column", CAST(n AS BIGINT) AS count, round(r * c / t, 6) AS expected, round((n - r * c / t) / sqrt(r * c / t * (1 - r / t) * (1 - c / t)), 6) AS residual, round(100 * n / r, 6) AS percent FROM t""",
)
def mosaic_cells(spark, sf_dir):
    out = mg.mosaic_cells(_priorities(spark, sf_dir), "o_orderpriority", "c_nationkey", 10, "row")
    return out.withColumns({c: F.round(c, 6) for c in ("expected", "residual", "percent")})


def _priorities(spark, sf_dir):
    """Orders' priorities and their customers' nations, a row for each order."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return orders.join(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")


@register("mosaic_permutation")
def mosaic_permutation(spark, sf_dir):
    return mg.mosaic_permutation(mg.mosaic_cells(_priorities(spark, sf_dir), "o_orderpriority", "c_nationkey"), 500)


@register("mosaic_test")
def mosaic_test(spark, sf_dir):
    x = cl.chi_square(cl.contingency(read_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"))
    return spark.createDataFrame([(float(x["statistic"]), int(x["df"]), float(x["p_value"]), float(x["cramers_v"]))], "statistic double, df int, p_value double, cramers_v double")


@register("rank_test")
def rank_test(spark, sf_dir):
    x = cl.rank_test(read_table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return spark.createDataFrame([(float(x["statistic"]), int(x["df"]), float(x["p_value"]), float(x["eta_squared"]))], "statistic double, df int, p_value double, eta_squared double")


@register("cluster_profiles", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_o_totalprice, round(stddev_samp(o_totalprice), 4) AS sd_o_totalprice, round(median(o_totalprice), 4) AS median_o_totalprice FROM orders GROUP BY 1")
def cluster_profiles(spark, sf_dir):
    a, _ = cl.profiles(read_table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice"])
    return a.withColumns({c: F.round(c, 4) for c in a.columns if c.endswith("_o_totalprice")})


_LAYERS = f"WITH {P}, m AS (SELECT DISTINCT f AS s, CASE WHEN f = 'purchase' THEN 'money' ELSE 'other' END AS k FROM c)"


@register(
    "macro_network",
    f"{_LAYERS} SELECT 'macro' AS layer, a.k AS from_state, b.k AS to_state, sum(w) AS weight FROM c JOIN m a ON a.s = f JOIN m b ON b.s = t GROUP BY a.k, b.k UNION ALL SELECT a.k, f, t, round(w / sum(w) OVER (PARTITION BY a.k, f), 9) FROM c JOIN m a ON a.s = f JOIN m b ON b.s = t WHERE a.k = b.k",
)
def macro_network(spark, sf_dir):
    """Macro and within layers in one frame."""
    edges = tr.frequency(event_sequences(spark, sf_dir), SEQ)
    clusters = spark.createDataFrame([(s, "money" if s == "purchase" else "other") for s in DAY_STATES], "node string, cluster string")
    a = nw.macro(edges, clusters).select(F.lit("macro").alias("layer"), F.col("from").alias("from_state"), F.col("to").alias("to_state"), "weight")
    b = nw.within(edges, clusters).select(F.col("cluster").alias("layer"), F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.round("weight", 9).alias("weight"))
    return a.unionByName(b)


@register("mosaic_statistic", f"WITH {_CONT}, x AS (SELECT sum((n - r * k / t) ** 2 / (r * k / t)) + sum(n) - sum(r * k / t) AS v, sum(n) AS n, count(DISTINCT \"row\") AS a, count(DISTINCT \"column\") AS b FROM t) SELECT round(v, 6) AS statistic, CAST((a - 1) * (b - 1) AS INTEGER) AS df, round(sqrt(v / (n * (least(a, b) - 1))), 9) AS cramers_v FROM x")
def mosaic_statistic(spark, sf_dir):
    return mosaic_test(spark, sf_dir).select(F.round("statistic", 6).alias("statistic"), "df", F.round("cramers_v", 9).alias("cramers_v"))


@register(
    "rank_statistic",
    """WITH o AS (SELECT o_orderpriority AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders), s AS (SELECT g, sum(r) AS r, count(*) AS n FROM o GROUP BY g), n AS (SELECT sum(n) AS n FROM s),
    t AS (SELECT sum(k * k * k - k) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM orders GROUP BY o_totalprice)) SELECT round((12 / (n.n * (n.n + 1)) * (SELECT sum(r * r / n) FROM s) - 3 * (n.n + 1)) / (1 - t.t / (CAST(n.n AS DOUBLE) ** 3 - n.n)), 5) AS statistic FROM n, t""",
)
def rank_statistic(spark, sf_dir):
    return rank_test(spark, sf_dir).select(F.round("statistic", 5).alias("statistic"))


@register(
    "certainty_moments",
    f"WITH {P}, z AS (SELECT f, t, w, w + 0.5 AS a, sum(w) OVER (PARTITION BY f) AS n, sum(w) OVER (PARTITION BY f) + 0.5 * (SELECT count(DISTINCT t) FROM c) AS s FROM c) SELECT f AS from_state, t AS to_state, round(w / n, 9) AS weight, round(a / s, 9) AS mean, round(sqrt(a * (s - a) / (s * s * (s + 1))), 9) AS sd FROM z",
)
def certainty_moments(spark, sf_dir):
    return certainty(spark, sf_dir).select("from_state", "to_state", *[F.round(c, 9).alias(c) for c in ("weight", "mean", "sd")])


# ---- panels ---------------------------------------------------------------------------


@register("bootstrap_association")
def bootstrap_association(spark, sf_dir):
    from eventloom.operators import panels

    df, columns = _embedding_columns(spark, sf_dir)
    return _edge_rows(spark, panels.bootstrap_association(df, columns, "pcor", 50), ["weight", "mean", "low", "high", "inclusion"])


@register("network_comparison_test")
def network_comparison_test(spark, sf_dir):
    from eventloom.operators import panels

    li = read_table(spark, sf_dir, "lineitem").select(*NUMBERS, "l_returnflag")
    x = panels.compare_networks(li.where("l_returnflag = 'R'").drop("l_returnflag"), li.where("l_returnflag = 'A'").drop("l_returnflag"), NUMBERS, "cor", 50)
    return spark.createDataFrame([("strength", float(x["strength"]), float(x["p_strength"])), ("largest", float(x["largest"]), float(x["p_largest"])), *[(f"{a} - {b}", d, float(p)) for a, b, d, p in x["edges"]]], "statistic string, value double, p_value double")


@register("strength_stability")
def strength_stability(spark, sf_dir):
    from eventloom.operators import panels

    df, columns = _embedding_columns(spark, sf_dir)
    return spark.createDataFrame([tuple(float(v) for v in r.values()) for r in panels.strength_stability(df, columns, "pcor", (0.1, 0.5), 30)], "drop double, mean double, share_above double, coefficient double")


@register("item_composites", "SELECT l_orderkey, l_linenumber, round((l_quantity / 50 + l_discount) / 2, 9) AS size, l_tax AS tax FROM lineitem")
def item_composites(spark, sf_dir):
    from eventloom.operators import panels

    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("q"), "l_discount", "l_tax")
    made = panels.composites(li.withColumnRenamed("l_orderkey", "k").withColumnRenamed("l_linenumber", "n"), {"l_orderkey": ["k"], "l_linenumber": ["n"], "size": ["q", "l_discount"], "tax": ["l_tax"]})
    return made.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.round("size", 9).alias("size"), "tax")


@register("loading_stability")
def loading_stability(spark, sf_dir):
    from eventloom.operators import panels

    df, columns = _embedding_columns(spark, sf_dir)
    rows = panels.loading_stability(df, {"a": columns[: len(columns) // 2], "b": columns[len(columns) // 2 :]}, "pcor", 50)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "item string, cluster string, own double, low double, high double, misfit_share double")


@register("layered_association")
def layered_association(spark, sf_dir):
    from eventloom.operators import panels

    df, columns = _embedding_columns(spark, sf_dir)
    x = panels.layered_association(df, {"a": columns[: len(columns) // 2], "b": columns[len(columns) // 2 :]}, "pcor")
    return spark.createDataFrame([(r["item"], r["cluster"], r["own"], r["other"], r["cross"], bool(r["misfit"])) for r in x["loadings"]], "item string, cluster string, own double, other string, cross_weight double, misfit boolean")
