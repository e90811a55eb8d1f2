"""Registered queries of models with longer memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.expressions import bounded
from eventloom.operators import context_tree as ct
from eventloom.operators import higher_order as ho
from eventloom.operators import label_tests as lt
from eventloom.operators import margins as mg
from eventloom.operators import sequences as sq
from eventloom.plans.sequence_queries import SEQ, P, S, event_sequences
from eventloom.registry import register


def _rows(spark, sf_dir, keep=()):
    s = event_sequences(spark, sf_dir)
    if keep:
        s = s.withColumn("grp", F.col("user_id") % 2)
    return ho.trails(s, SEQ, keep=keep)


def _lead(k):
    return ", ".join(f"lead(state, {i}) OVER w AS s{i}" for i in range(1, k))


def _gram_cte(k, extra=""):
    return f"k{k} AS (SELECT * FROM (SELECT user_id, session, pos, state AS s0{', ' + _lead(k) if k > 1 else ''}{extra} FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY pos)) WHERE s{k - 1} IS NOT NULL)"


@register("path_counts", f"WITH {S}, {_gram_cte(3)} SELECT s0 || ' -> ' || s1 || ' -> ' || s2 AS path, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 9) AS proportion FROM k3 GROUP BY 1")
def path_counts(spark, sf_dir):
    return ho.path_counts(_rows(spark, sf_dir), 3).withColumn("proportion", F.round("proportion", 9))


@register("state_frequencies", f"WITH {S} SELECT state, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 9) AS proportion FROM s GROUP BY state")
def state_frequencies(spark, sf_dir):
    return ho.state_frequencies(event_sequences(spark, sf_dir)).withColumn("proportion", F.round("proportion", 9))


@register("state_distribution", f"WITH {S} SELECT pos, state, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY pos), 9) AS proportion FROM s GROUP BY pos, state")
def state_distribution(spark, sf_dir):
    return ho.state_frequencies(event_sequences(spark, sf_dir), ["pos"]).withColumn("proportion", F.round("proportion", 9))


@register("gram_transitions", f"WITH {S}, {_gram_cte(3)} SELECT s0 || ' ' || s1 AS from_path, s1 || ' ' || s2 AS to_path, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY s0, s1), 9) AS probability FROM k3 GROUP BY s0, s1, s2")
def gram_transitions(spark, sf_dir):
    out = ho.gram_transitions(_rows(spark, sf_dir), 2)
    return out.select(F.array_join("from", " ").alias("from_path"), F.array_join("to", " ").alias("to_path"), "count", F.round("probability", 9).alias("probability"))


@register(
    "order_log_likelihood",
    f"""WITH {S}, {_gram_cte(2)}, {_gram_cte(3)}, q AS (SELECT state, count(*) AS n FROM s GROUP BY state), m AS (SELECT state, ln(n / sum(n) OVER ()) AS lp FROM q),
    c2 AS (SELECT s0, s1, count(*) AS n FROM k2 GROUP BY s0, s1), p1 AS (SELECT s0, s1, ln(n / sum(n) OVER (PARTITION BY s0)) AS lp FROM c2), c3 AS (SELECT s0, s1, s2, count(*) AS n FROM k3 GROUP BY s0, s1, s2), p2 AS (SELECT s0, s1, s2, ln(n / sum(n) OVER (PARTITION BY s0, s1)) AS lp FROM c3),
    a AS (SELECT sum(lp) AS x FROM s JOIN m USING (state) WHERE pos = 1), b AS (SELECT sum(lp) AS x FROM k2 JOIN p1 USING (s0, s1) WHERE pos = 1), d AS (SELECT sum(lp) AS x FROM k3 JOIN p2 USING (s0, s1, s2))
    SELECT round(a.x + b.x + d.x, 4) AS log_likelihood, z.n AS n_states FROM a, b, d, (SELECT count(*) AS n FROM s) z""",
)
def order_log_likelihood(spark, sf_dir):
    return ho.order_log_likelihood(_rows(spark, sf_dir), 2).withColumn("log_likelihood", F.round("log_likelihood", 4))


@register(
    "order_tests",
    f"""WITH {S}, {_gram_cte(3)}, o AS (SELECT s0, s1, s2, count(*) AS o FROM k3 GROUP BY ALL), e AS (SELECT s0, s1, s2, o, sum(o) OVER (PARTITION BY s1, s0) AS x, sum(o) OVER (PARTITION BY s1, s2) AS y, sum(o) OVER (PARTITION BY s1) AS n FROM o)
    SELECT s1 AS context, round(sum(2 * o * ln(o * n / (x * y))), 6) AS g2, (count(DISTINCT s0) - 1) * (count(DISTINCT s2) - 1) AS df FROM e GROUP BY s1""",
)
def order_tests(spark, sf_dir):
    return ho.order_tests(_rows(spark, sf_dir), 2).select(F.array_join("context", " ").alias("context"), F.round("g2", 6).alias("g2"), "df")


@register(
    "path_dependence",
    f"""WITH {S}, {_gram_cte(2)}, {_gram_cte(3)}, a AS (SELECT s0, s1, count(*) AS c, sum(count(*)) OVER (PARTITION BY s0) AS n FROM k2 GROUP BY s0, s1), b AS (SELECT s0, s1, s2, count(*) AS c, sum(count(*)) OVER (PARTITION BY s0, s1) AS n FROM k3 GROUP BY s0, s1, s2),
    ent AS (SELECT s0, -sum(c / n * log2(c / n)) AS e, arg_max(s1, (c, s1)) AS top FROM a GROUP BY s0),
    l AS (SELECT b.s0, b.s1, max(b.n) AS n, -sum(b.c / b.n * log2(b.c / b.n)) AS e, sum(b.c / b.n * log2((b.c / b.n) / (a.c / a.n))) AS d, arg_max(b.s2, (b.c, b.s2)) AS top FROM b JOIN a ON a.s0 = b.s1 AND a.s1 = b.s2 WHERE b.n >= 5 GROUP BY b.s0, b.s1)
    SELECT l.s0 || ' -> ' || l.s1 AS context, CAST(l.n AS BIGINT) AS n, round(h.e, 6) AS entropy_1, round(l.e, 6) AS entropy_k, round(h.e - l.e, 6) AS "drop", round(l.d, 6) AS divergence, h.top AS most_likely_1, l.top AS most_likely_k, h.top <> l.top AS flips FROM l JOIN ent h ON h.s0 = l.s1""",
)
def path_dependence(spark, sf_dir):
    out = ho.path_dependence(_rows(spark, sf_dir), 2)
    return out.select("context", "n", *[F.round(c, 6).alias(c) for c in ("entropy_1", "entropy_k", "drop", "divergence")], "most_likely_1", "most_likely_k", "flips")


@register(
    "sequence_compare",
    f"""WITH {S}, {_gram_cte(3)}, c AS (SELECT s0 || ' -> ' || s1 || ' -> ' || s2 AS pattern, user_id % 2 AS grp, count(*) AS k FROM k3 GROUP BY ALL), f AS (SELECT p.pattern, g.grp, coalesce(c.k, 0) AS k FROM (SELECT DISTINCT pattern FROM c) p CROSS JOIN (SELECT DISTINCT grp FROM c) g LEFT JOIN c ON c.pattern = p.pattern AND c.grp = g.grp),
    z AS (SELECT *, sum(k) OVER (PARTITION BY pattern) AS r, sum(k) OVER (PARTITION BY grp) AS t, sum(k) OVER () AS n, min(k) OVER (PARTITION BY pattern) AS lo FROM f)
    SELECT 3 AS length, pattern, grp AS "group", k AS count, round((k - r * t / n) / sqrt(r * t / n * (1 - r / n) * (1 - t / n)), 6) AS residual FROM z WHERE lo >= 5""",
)
def sequence_compare(spark, sf_dir):
    return ho.sequence_compare(_rows(spark, sf_dir, ["grp"]), "grp", [3]).select("length", "pattern", "group", "count", F.round("residual", 6).alias("residual"))


@register(
    "kgram_statistics",
    f"""WITH {S}, {_gram_cte(3)}, {_gram_cte(4)}, c AS (SELECT 3 AS length, s0 || ' -> ' || s1 || ' -> ' || s2 AS pattern, user_id % 2 AS grp, count(*) AS k FROM k3 GROUP BY ALL UNION ALL SELECT 4, s0 || ' -> ' || s1 || ' -> ' || s2 || ' -> ' || s3, user_id % 2, count(*) FROM k4 GROUP BY ALL),
    f AS (SELECT p.length, p.pattern, g.grp, coalesce(c.k, 0) AS k FROM (SELECT DISTINCT length, pattern FROM c) p CROSS JOIN (SELECT DISTINCT grp FROM c) g LEFT JOIN c ON c.length = p.length AND c.pattern = p.pattern AND c.grp = g.grp),
    l AS (SELECT *, min(k) OVER (PARTITION BY length, pattern) AS least FROM f), z AS (SELECT *, sum(k) OVER (PARTITION BY length, pattern) * sum(k) OVER (PARTITION BY length, grp) / sum(k) OVER (PARTITION BY length) AS e FROM l WHERE least >= 5)
    SELECT CAST(length AS INTEGER) AS length, pattern, round(sqrt(sum((k - e) * (k - e))), 6) AS statistic FROM z GROUP BY length, pattern""",
)
def kgram_statistics(spark, sf_dir):
    return kgram_test(spark, sf_dir).select("length", "pattern", F.round("statistic", 6).alias("statistic"))


@register("kgram_test")
def kgram_test(spark, sf_dir):
    return lt.kgram_test(_rows(spark, sf_dir, ["grp"]), SEQ, "grp", [3, 4], 5, 400)


@register(
    "sequence_statistics",
    f"""WITH {S}, {_gram_cte(3)}, c AS (SELECT s0 || ' -> ' || s1 || ' -> ' || s2 AS pattern, user_id % 2 AS grp, count(*) AS k FROM k3 GROUP BY ALL), f AS (SELECT p.pattern, g.grp, coalesce(c.k, 0) AS k FROM (SELECT DISTINCT pattern FROM c) p CROSS JOIN (SELECT DISTINCT grp FROM c) g LEFT JOIN c ON c.pattern = p.pattern AND c.grp = g.grp),
    z AS (SELECT *, sum(k) OVER (PARTITION BY pattern) * sum(k) OVER (PARTITION BY grp) / sum(k) OVER () AS e, sum(k) OVER (PARTITION BY grp) AS t, min(k) OVER (PARTITION BY pattern) AS lo FROM f),
    y AS (SELECT pattern, abs(k - e) AS d, e FROM z WHERE lo >= 5 UNION ALL SELECT pattern, abs((t - k) - (t - e)), t - e FROM z WHERE lo >= 5),
    x AS (SELECT pattern, d - least(0.5, min(d) OVER (PARTITION BY pattern)) AS d, e FROM y) SELECT 3 AS length, pattern, round(sum(d * d / e), 5) AS statistic, CAST(1 AS BIGINT) AS df FROM x GROUP BY pattern""",
)
def sequence_statistics(spark, sf_dir):
    out = ho.sequence_statistics(ho.sequence_compare(_rows(spark, sf_dir, ["grp"]), "grp", [3]))
    return out.select("length", "pattern", F.round("statistic", 5).alias("statistic"), F.col("df").cast("long").alias("df"))


@register(
    "gram_pathways",
    f"WITH {S}, {_gram_cte(3)}, gp AS (SELECT s0 || ' ' || s1 || ' -> ' || s2 AS path, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY s0, s1) AS p FROM k3 GROUP BY s0, s1, s2) SELECT path, count, round(p, 9) AS probability FROM gp WHERE count >= 3 AND p >= 0.2",
)
def gram_pathways(spark, sf_dir):
    return ho.gram_pathways(_rows(spark, sf_dir), 2, 3, 0.2).withColumn("probability", F.round("probability", 9))


@register(
    "higher_order_contexts",
    f"""WITH {S}, {_gram_cte(2)}, {_gram_cte(3)}, {_gram_cte(4)}, u AS (SELECT s0 AS context, s1 AS nxt FROM k2 UNION ALL SELECT s0 || ' ' || s1, s2 FROM k3 UNION ALL SELECT s0 || ' ' || s1 || ' ' || s2, s3 FROM k4),
    c AS (SELECT context, nxt, count(*) AS n FROM u GROUP BY ALL HAVING count(*) >= 3) SELECT context, nxt AS "next", n AS count, round(n / sum(n) OVER (PARTITION BY context), 9) AS probability FROM c""",
)
def higher_order_contexts(spark, sf_dir):
    out = ho.contexts(_rows(spark, sf_dir), 3, 3)
    return out.select(F.array_join("context", " ").alias("context"), "next", "count", F.round("probability", 9).alias("probability"))


@register(
    "hypa_expected",
    f"""WITH {S}, {_gram_cte(3)}, e AS (SELECT s0 || ' ' || s1 AS f, s1 || ' ' || s2 AS t, s0 || ' ' || s1 || ' ' || s2 AS path, count(*) AS n FROM k3 GROUP BY ALL), x AS (SELECT path, n, sum(n) OVER (PARTITION BY f) * sum(n) OVER (PARTITION BY t) AS xi FROM e)
    SELECT path, n AS observed, round(sum(n) OVER () * xi / sum(xi) OVER (), 6) AS expected FROM x""",
)
def hypa_expected(spark, sf_dir):
    return hypa(spark, sf_dir).select("path", "observed", F.round("expected", 6).alias("expected"))


@register("hypa")
def hypa(spark, sf_dir):
    return ho.hypa(_rows(spark, sf_dir), 2)


@register("anomaly_pathways")
def anomaly_pathways(spark, sf_dir):
    return ho.anomaly_pathways(ho.hypa(_daytimes(spark, sf_dir), 2))


@register("multi_order_model")
def multi_order_model(spark, sf_dir):
    rows = ho.multi_order_table(_rows(spark, sf_dir).cache(), 3)
    return spark.createDataFrame(rows, "order int, log_likelihood double, freedom long, aic double, bic double, p_value double")


@register("markov_order_test")
def markov_order_test(spark, sf_dir):
    return spark.createDataFrame(mg.markov_order(_rows(spark, sf_dir), 2, 100), "order int, g2 double, df long, p_asymptotic double, p_permutation double, chosen int")


def _rules(found):
    return found.select(F.array_join("context", " ").alias("context"), "next", "count", F.round("probability", 9).alias("probability"), "order")


def _ho_edges(found):
    e = ct.network(found)
    return e.select(F.array_join("from", " ").alias("from_context"), F.array_join("to", " ").alias("to_context"), "count", F.round("probability", 9).alias("probability"), "from_order", "to_order")


def _daytimes(spark, sf_dir):
    """The trails of events by kind and quarter of the day."""
    e = event_sequences(spark, sf_dir)
    return ho.trails(e.withColumn("state", F.concat_ws("-", "state", F.floor(F.hour("ts") / 6).cast("string"))), SEQ)


_DAYTIMES = S.replace("event_type AS state", "event_type || '-' || CAST(hour(ts) // 6 AS VARCHAR) AS state")
#: Growth to the third order: a level is compared with the last valid end of each context.
TREE = f"""{_DAYTIMES}, {_gram_cte(2)}, {_gram_cte(3)}, {_gram_cte(4)},
a AS (SELECT s0 AS c1, s1 AS nxt, count(*) AS n, sum(count(*)) OVER (PARTITION BY s0) AS t FROM k2 GROUP BY s0, s1),
b AS (SELECT s0 AS c2, s1 AS c1, s2 AS nxt, count(*) AS n, sum(count(*)) OVER (PARTITION BY s0, s1) AS t FROM k3 GROUP BY s0, s1, s2),
c AS (SELECT s0 AS c3, s1 AS c2, s2 AS c1, s3 AS nxt, count(*) AS n, sum(count(*)) OVER (PARTITION BY s0, s1, s2) AS t FROM k4 GROUP BY s0, s1, s2, s3),
g1 AS (SELECT c1 FROM a GROUP BY c1 HAVING NOT -log2(min(n / t)) < 2 / log2(1 + max(t))),
v2 AS (SELECT b.c2, b.c1, sum(b.n / b.t * log2((b.n / b.t) / (a.n / a.t))) > 2 / log2(1 + max(b.t)) AS valid FROM b JOIN g1 USING (c1) JOIN a ON a.c1 = b.c1 AND a.nxt = b.nxt GROUP BY b.c2, b.c1),
m2 AS (SELECT b.*, v2.valid, CASE WHEN valid THEN b.n / b.t ELSE a.n / a.t END AS q, b.n / b.t = min(b.n / b.t) OVER (PARTITION BY b.c2, b.c1) AS rare FROM b JOIN v2 USING (c2, c1) JOIN a ON a.c1 = b.c1 AND a.nxt = b.nxt),
g2 AS (SELECT c2, c1, bool_or(valid) AS valid FROM m2 WHERE rare GROUP BY c2, c1 HAVING NOT max(-log2(q)) < 3 / log2(1 + max(t))),
v3 AS (SELECT c.c3, c.c2, c.c1, bool_or(g2.valid) AS before, sum(c.n / c.t * log2((c.n / c.t) / CASE WHEN g2.valid THEN b.n / b.t ELSE a.n / a.t END)) > 3 / log2(1 + max(c.t)) AS valid
    FROM c JOIN g2 USING (c2, c1) JOIN b ON b.c2 = c.c2 AND b.c1 = c.c1 AND b.nxt = c.nxt JOIN a ON a.c1 = c.c1 AND a.nxt = c.nxt GROUP BY c.c3, c.c2, c.c1),
e AS (SELECT [c3, c2, c1] AS p FROM v3 WHERE valid UNION ALL SELECT [c2, c1] FROM v3 WHERE NOT valid AND before
    UNION ALL SELECT [c2, c1] FROM v2 WHERE valid AND NOT EXISTS (SELECT 1 FROM v3 WHERE v3.c2 = v2.c2 AND v3.c1 = v2.c1)),
w AS (SELECT DISTINCT unnest([p[:1], p[:2], p]) AS p FROM e UNION SELECT DISTINCT [c1] FROM a),
r AS (SELECT [c1] AS p, nxt, n, t FROM a UNION ALL SELECT [c2, c1], nxt, n, t FROM b UNION ALL SELECT [c3, c2, c1], nxt, n, t FROM c),
rules AS (SELECT p, nxt, n, n / t AS q FROM r SEMI JOIN w USING (p))"""


@register("higher_order_rules", f"WITH {TREE} SELECT array_to_string(p, ' ') AS context, nxt AS \"next\", n AS count, round(q, 9) AS probability, CAST(len(p) AS INTEGER) AS \"order\" FROM rules")
def higher_order_rules(spark, sf_dir):
    return _rules(ct.rules(_daytimes(spark, sf_dir), 3))


@register("deep_rules")
def deep_rules(spark, sf_dir):
    """The same to the fifth order."""
    return _rules(ct.rules(_daytimes(spark, sf_dir), 5))


@register(
    "higher_order_network",
    f"""WITH {TREE}, x AS (SELECT p, nxt, n, q, list_append(p, nxt) AS path FROM rules), k AS (SELECT DISTINCT p AS node FROM rules WHERE len(p) > 1),
    o AS (SELECT x.*, node FROM x LEFT JOIN k ON node = path[-len(node):] QUALIFY row_number() OVER (PARTITION BY p, nxt ORDER BY coalesce(len(node), 0) DESC) = 1)
    SELECT array_to_string(p, ' ') AS from_context, array_to_string(coalesce(node, [nxt]), ' ') AS to_context, n AS count, round(q, 9) AS probability, CAST(len(p) AS INTEGER) AS from_order, CAST(coalesce(len(node), 1) AS INTEGER) AS to_order FROM o""",
)
def higher_order_network(spark, sf_dir):
    return _ho_edges(ct.rules(_daytimes(spark, sf_dir), 3))


@register("pathways", f"WITH {TREE} SELECT array_to_string(p, ' ') || ' -> ' || nxt AS path, CAST(len(p) AS INTEGER) AS \"order\", n AS count, round(q, 9) AS probability FROM rules WHERE len(p) > 1 AND n >= 5")
def pathways(spark, sf_dir):
    return ct.pathways(ct.rules(_daytimes(spark, sf_dir), 3), 5).withColumn("probability", F.round("probability", 9))


@register("higher_order_embedding")
def higher_order_embedding(spark, sf_dir):
    edges = [{"from": r["from_context"], "to": r["to_context"], "probability": r["probability"]} for r in bounded(_ho_edges(ct.rules(_rows(spark, sf_dir), 3)), 5000, "edges of contexts")]
    nodes, x, share = ho.embedding(edges, 4)
    return spark.createDataFrame([(n, [float(v) for v in r], share) for n, r in zip(nodes, x, strict=True)], "node string, coordinates array<double>, explained double")


@register(
    "collapsed_sequences",
    f"WITH {S}, d AS (SELECT *, lag(state) OVER (PARTITION BY user_id, session ORDER BY pos) AS b FROM s) SELECT user_id, session, string_agg(state, ' ' ORDER BY pos) AS path FROM d WHERE b IS NULL OR b <> state GROUP BY user_id, session",
)
def collapsed_sequences(spark, sf_dir):
    return _rows(spark, sf_dir).select(*SEQ, F.array_join(ho.collapsed(F.col("states")), " ").alias("path"))


@register(
    "row_entropy",
    f"WITH {P}, r AS (SELECT f, w / sum(w) OVER (PARTITION BY f) AS q FROM c) SELECT f AS state, round(-sum(q * log2(q)), 9) AS entropy FROM r GROUP BY f",
)
def row_entropy(spark, sf_dir):
    from eventloom.operators import transitions as tr

    e = tr.relative(event_sequences(spark, sf_dir), SEQ).where("weight > 0")
    return e.groupBy(F.col("from").alias("state")).agg(F.round(-F.sum(F.col("weight") * F.log2("weight")), 9).alias("entropy"))


@register(
    "windowed_onehot_sequences",
    f"WITH {S}, o AS (SELECT user_id, state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM s) SELECT user_id, CAST(rn // 3 AS BIGINT) AS \"window\", CAST(sum(CAST(state = 'click' AS INTEGER)) AS BIGINT) AS click, CAST(sum(CAST(state = 'view' AS INTEGER)) AS BIGINT) AS view FROM o GROUP BY ALL",
)
def windowed_onehot_sequences(spark, sf_dir):
    hot = sq.one_hot(event_sequences(spark, sf_dir), "state", ["click", "view"])
    return sq.windowed_one_hot(hot, ["user_id"], ["click", "view"], ["ts", "event_id"], 3)
