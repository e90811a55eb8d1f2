"""Registered queries over event logs and sequences, each with its SQL.

Sessions of `events` split at gaps over a day; states are event types. The SQL is written
from the definitions, not from the plans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import estimators
from eventloom.operators import sequences as sq
from eventloom.operators import transitions as tr
from eventloom.registry import register
from eventloom.session import read_table

SEQ = ["user_id", "session"]
GAP = 86400
DAY_STATES = ["click", "error", "purchase", "signup", "view"]


def event_sequences(spark, sf_dir):
    """user_id, session, pos, state, ts, event_id, value of the event log."""
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", F.col("event_type").alias("state"))
    return sq.sessions(events, ["user_id"], "ts", ["event_id"], GAP)


def turns(spark, sf_dir):
    """Conversations as sequences of roles."""
    t = read_table(spark, sf_dir, "conversations")
    return t.select("conv_id", F.row_number().over(sq.Window.partitionBy("conv_id").orderBy("turn", "role")).alias("pos"), F.col("role").alias("state"))


#: CTE s: the sequences of event_sequences().
S = f"""
g AS (SELECT user_id, event_id, ts, value, event_type AS state,
        CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > {GAP} THEN 1 ELSE 0 END AS brk
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g),
s AS (SELECT user_id, session, event_id, ts, value, state,
        CAST(row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS INTEGER) AS pos FROM h)"""
#: CTE p: adjacent pairs.
P = S + """,
p AS (SELECT * FROM (SELECT user_id, session, pos, state AS f, lead(state) OVER (PARTITION BY user_id, session ORDER BY pos) AS t FROM s) WHERE t IS NOT NULL),
c AS (SELECT f, t, CAST(count(*) AS DOUBLE) AS w FROM p GROUP BY f, t)"""


def _edges(df, digits=9):
    return df.select(F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.round("weight", digits).alias("weight"))


@register("sessions", f"WITH {S} SELECT user_id, event_id, session, pos FROM s")
def sessions(spark, sf_dir):
    return event_sequences(spark, sf_dir).select("user_id", "event_id", "session", "pos")


@register(
    "session_metadata",
    f"""WITH {S}, k AS (SELECT user_id, session, state, count(*) AS n, min(pos) AS first FROM s GROUP BY ALL),
    m AS (SELECT user_id, session, state FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY n DESC, first) AS r FROM k) WHERE r = 1)
    SELECT s.user_id, s.session, count(*) AS n_events, round(avg(s.value), 6) AS mean_value, any_value(m.state) AS mode_state
    FROM s JOIN m ON s.user_id = m.user_id AND s.session = m.session GROUP BY s.user_id, s.session""",
)
def session_metadata(spark, sf_dir):
    out = sq.session_metadata(event_sequences(spark, sf_dir), SEQ, ["value"], ["state"])
    return out.select(*SEQ, "n_events", F.round("value", 6).alias("mean_value"), F.col("state").alias("mode_state"))


@register("transition_frequency", f"WITH {P} SELECT f AS from_state, t AS to_state, w AS weight FROM c")
def transition_frequency(spark, sf_dir):
    return _edges(tr.frequency(event_sequences(spark, sf_dir), SEQ))


@register("transition_network", f"WITH {P} SELECT f AS from_state, t AS to_state, round(w / sum(w) OVER (PARTITION BY f), 9) AS weight FROM c")
def transition_network(spark, sf_dir):
    return _edges(tr.relative(event_sequences(spark, sf_dir), SEQ))


@register(
    "transition_weighted",
    f"""WITH {P}, l AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL)
    SELECT f AS from_state, t AS to_state, round(sum(1.0 / n), 6) AS weight FROM p JOIN l USING (user_id, session) GROUP BY f, t""",
)
def transition_weighted(spark, sf_dir):
    return _edges(tr.frequency(event_sequences(spark, sf_dir), SEQ, weighted=True), 6)


@register("initial_probabilities", f"WITH {S} SELECT state, round(count(*) / sum(count(*)) OVER (), 9) AS probability FROM s WHERE pos = 1 GROUP BY state")
def initial_probabilities(spark, sf_dir):
    return tr.initial(event_sequences(spark, sf_dir), SEQ).select("state", F.round("probability", 9).alias("probability"))


@register(
    "transition_markers",
    f"""WITH {S}, e AS (SELECT user_id, session, max(pos) AS last FROM s GROUP BY ALL),
    a AS (SELECT user_id, session, pos, state FROM s UNION ALL SELECT user_id, session, 0, 'Start' FROM e UNION ALL SELECT user_id, session, last + 1, 'End' FROM e),
    p AS (SELECT state AS f, lead(state) OVER (PARTITION BY user_id, session ORDER BY pos) AS t FROM a)
    SELECT f AS from_state, t AS to_state, CAST(count(*) AS DOUBLE) AS weight FROM p WHERE t IS NOT NULL GROUP BY f, t""",
)
def transition_markers(spark, sf_dir):
    return _edges(tr.frequency(sq.with_markers(event_sequences(spark, sf_dir), SEQ, "Start", "End"), SEQ))


@register(
    "transition_by_group",
    f"""WITH {P}, d AS (SELECT user_id % 3 AS grp, f, t, count(*) AS w FROM p GROUP BY ALL)
    SELECT grp, f AS from_state, t AS to_state, round(w / sum(w) OVER (PARTITION BY grp, f), 9) AS weight FROM d""",
)
def transition_by_group(spark, sf_dir):
    s = event_sequences(spark, sf_dir).withColumn("grp", F.col("user_id") % 3)
    return tr.relative(s, SEQ, ["grp"]).select("grp", F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.round("weight", 9).alias("weight"))


@register(
    "network_by_group",
    f"""WITH {P}, d AS (SELECT user_id % 3 AS g, f, t, count(*) AS w FROM p GROUP BY ALL), n AS (SELECT f AS s FROM d UNION SELECT t FROM d), q AS (SELECT g, f, t, w / sum(w) OVER (PARTITION BY g, f) AS w FROM d)
    SELECT k.g AS "group", a.s AS from_state, b.s AS to_state, round(coalesce(q.w, 0), 9) AS weight FROM (SELECT DISTINCT g FROM d) k CROSS JOIN n a CROSS JOIN n b LEFT JOIN q ON q.g = k.g AND q.f = a.s AND q.t = b.s""",
)
def network_by_group(spark, sf_dir):
    """The registry's estimator for each group of users, over the states of all groups."""
    s = event_sequences(spark, sf_dir).withColumn("grp", F.col("user_id") % 3)
    found = estimators.build_network(s, "tna", SEQ, group="grp")
    return found.select("group", F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.round("weight", 9).alias("weight"))


@register(
    "network_between_users",
    """WITH m AS (SELECT user_id, avg(value) AS value, avg(CAST(hour(ts) AS DOUBLE)) AS hour FROM events WHERE value IS NOT NULL GROUP BY user_id) SELECT 'hour' AS to_state, 'value' AS from_state, round(corr(value, hour), 6) AS weight FROM m""",
)
def network_between_users(spark, sf_dir):
    """Correlations of users' means."""
    rows = read_table(spark, sf_dir, "events").select("user_id", "value", F.hour("ts").cast("double").alias("hour")).where("value IS NOT NULL")
    found = estimators.build_network(rows, "cor", level="between", id_column="user_id", columns=["value", "hour"])
    return found.select(F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.round("weight", 6).alias("weight"))


@register(
    "transition_windowed",
    f"""WITH {S}, k AS (SELECT user_id, session, (pos - 1) // 3 AS win, state, count(*) AS n FROM s GROUP BY ALL)
    SELECT a.state AS from_state, b.state AS to_state, CAST(sum(a.n * b.n) AS DOUBLE) AS weight
    FROM k a JOIN k b ON a.user_id = b.user_id AND a.session = b.session AND b.win = a.win + 1 GROUP BY 1, 2""",
)
def transition_windowed(spark, sf_dir):
    return _edges(tr.windowed(event_sequences(spark, sf_dir), SEQ, 3))


@register(
    "sequence_cooccurrence",
    f"""WITH {S}, a AS (SELECT x.state AS f, y.state AS t, count(*) AS n FROM s x JOIN s y ON x.user_id = y.user_id AND x.session = y.session AND x.pos < y.pos GROUP BY ALL),
    b AS (SELECT f, t, n FROM a WHERE f <> t UNION ALL SELECT t, f, n FROM a WHERE f <> t UNION ALL SELECT f, t, n FROM a WHERE f = t)
    SELECT f AS from_state, t AS to_state, CAST(sum(n) AS DOUBLE) AS weight FROM b GROUP BY f, t""",
)
def sequence_cooccurrence(spark, sf_dir):
    return _edges(tr.co_occurrence(event_sequences(spark, sf_dir), SEQ))


@register(
    "attention_network",
    f"""WITH {S} SELECT x.state AS from_state, y.state AS to_state, round(sum(exp(-abs(x.pos - y.pos) / 2.0)), 6) AS weight
    FROM s x JOIN s y ON x.user_id = y.user_id AND x.session = y.session AND x.pos < y.pos GROUP BY 1, 2""",
)
def attention_network(spark, sf_dir):
    return _edges(tr.attention(event_sequences(spark, sf_dir), SEQ, 2.0), 6)


@register(
    "attention_network_time",
    f"""WITH {S}, z AS (SELECT *, epoch_us(ts) / 1e6 AS sec FROM s)
    SELECT x.state AS from_state, y.state AS to_state, round(sum(exp(-abs(x.sec - y.sec) / 20000.0)), 6) AS weight
    FROM z x JOIN z y ON x.user_id = y.user_id AND x.session = y.session AND x.pos <> y.pos GROUP BY 1, 2""",
)
def attention_network_time(spark, sf_dir):
    s = event_sequences(spark, sf_dir).withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return _edges(tr.attention(s, SEQ, 20000.0, "both", "sec"), 6)


_HOT = ", ".join(f"CAST(state = '{x}' AS INTEGER) AS \"{x}\"" for x in DAY_STATES)
_UNPIVOT = " UNION ALL ".join(f"SELECT user_id, win, '{x}' AS code, \"{x}\" AS x FROM k WHERE \"{x}\" > 0" for x in DAY_STATES)


def _one_hot(spark, sf_dir):
    return sq.one_hot(event_sequences(spark, sf_dir), "state", DAY_STATES)


_O = S + f", o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, {_HOT} FROM s)"
_TUMBLING = _O + f", k AS (SELECT user_id, rn // 3 AS win, {', '.join(f'sum("{x}") AS "{x}"' for x in DAY_STATES)} FROM o GROUP BY ALL), u AS ({_UNPIVOT})"
_FRAME = "OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
_SLIDING = _O + f", k AS (SELECT * FROM (SELECT user_id, rn AS win, count(*) {_FRAME} AS n, {', '.join(f'sum("{x}") {_FRAME} AS "{x}"' for x in DAY_STATES)} FROM o) WHERE n = 3), u AS ({_UNPIVOT})"


def _windows_sql(cte, step):
    return f"WITH {cte} SELECT a.code AS from_state, b.code AS to_state, CAST(sum(a.x * b.x) AS DOUBLE) AS weight FROM u a JOIN u b ON a.user_id = b.user_id AND b.win = a.win + {step} GROUP BY 1, 2"


@register("window_transition_tumbling", _windows_sql(_TUMBLING, 1))
def window_transition_tumbling(spark, sf_dir):
    return _edges(tr.one_hot_windows(_one_hot(spark, sf_dir), ["user_id"], DAY_STATES, ["ts", "event_id"], 3))


@register("window_transition_sliding", _windows_sql(_SLIDING, 1))
def window_transition_sliding(spark, sf_dir):
    return _edges(tr.one_hot_windows(_one_hot(spark, sf_dir), ["user_id"], DAY_STATES, ["ts", "event_id"], 3, sliding=True))


@register("window_cooccurrence_tumbling", _windows_sql(_TUMBLING, 0))
def window_cooccurrence_tumbling(spark, sf_dir):
    return _edges(tr.one_hot_windows(_one_hot(spark, sf_dir), ["user_id"], DAY_STATES, ["ts", "event_id"], 3, kind="cooccurrence"))


@register(
    "window_initial",
    f"WITH {S}, f AS (SELECT arg_min(state, (ts, event_id)) AS state FROM s GROUP BY user_id) SELECT state, round(count(*) / sum(count(*)) OVER (), 9) AS probability FROM f GROUP BY state",
)
def window_initial(spark, sf_dir):
    return tr.one_hot_initial(_one_hot(spark, sf_dir), ["user_id"], DAY_STATES, ["ts", "event_id"]).select("state", F.round("probability", 9).alias("probability"))


@register(
    "action_to_onehot",
    f"WITH {S} SELECT event_id, {_HOT} FROM s",
)
def action_to_onehot(spark, sf_dir):
    return _one_hot(spark, sf_dir).select("event_id", *DAY_STATES)


@register(
    "sequence_format_frequency",
    f"WITH {S} SELECT user_id, session, {', '.join(f'''count(*) FILTER (WHERE state = '{x}') AS "{x}"''' for x in DAY_STATES)} FROM s GROUP BY user_id, session",
)
def sequence_format_frequency(spark, sf_dir):
    return sq.sequence_counts(event_sequences(spark, sf_dir), SEQ, DAY_STATES)


@register(
    "sequence_format_onehot",
    f"WITH {S} SELECT user_id, session, {', '.join(f'''max(CAST(state = '{x}' AS INTEGER)) AS "{x}"''' for x in DAY_STATES)} FROM s GROUP BY user_id, session",
)
def sequence_format_onehot(spark, sf_dir):
    return sq.sequence_presence(event_sequences(spark, sf_dir), SEQ, DAY_STATES)


@register("sequence_format_edgelist", f"WITH {P} SELECT user_id, session, pos, f AS from_state, t AS to_state FROM p")
def sequence_format_edgelist(spark, sf_dir):
    return sq.edge_list(event_sequences(spark, sf_dir), SEQ).select(*SEQ, "pos", F.col("from").alias("from_state"), F.col("to").alias("to_state"))


@register("sequence_format_follows", f"WITH {S} SELECT * FROM (SELECT user_id, session, pos, state AS act, lag(state) OVER (PARTITION BY user_id, session ORDER BY pos) AS follows FROM s) WHERE follows IS NOT NULL")
def sequence_format_follows(spark, sf_dir):
    return sq.follows(event_sequences(spark, sf_dir), SEQ)


_WIDE = ", ".join(f"max(CASE WHEN pos = {i} THEN state END) AS V{i}" for i in range(1, 7))


@register("long_to_wide", f"WITH {S} SELECT user_id, session, {_WIDE} FROM s GROUP BY user_id, session")
def long_to_wide(spark, sf_dir):
    return sq.long_to_wide(event_sequences(spark, sf_dir), SEQ, 6)


_LONG = " UNION ALL ".join(f"SELECT user_id, session, {i} AS pos, V{i} AS state FROM w" for i in range(1, 7))


@register("wide_to_long", f"WITH {S}, w AS (SELECT user_id, session, {_WIDE} FROM s GROUP BY user_id, session), l AS ({_LONG}) SELECT * FROM l WHERE state IS NOT NULL")
def wide_to_long(spark, sf_dir):
    return sq.wide_to_long(long_to_wide(spark, sf_dir), SEQ, [f"V{i}" for i in range(1, 7)])


def _wide_turns(spark, sf_dir):
    return sq.wide_to_long(sq.long_to_wide(turns(spark, sf_dir), ["conv_id"], 8), ["conv_id"], [f"V{i}" for i in range(1, 9)], drop_missing=False)


_T = "t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INTEGER) AS pos, role AS state FROM conversations), i AS (SELECT DISTINCT conv_id FROM t), x AS (SELECT conv_id, k AS pos, state FROM i CROSS JOIN range(1, 9) r(k) LEFT JOIN t ON t.conv_id = i.conv_id AND t.pos = r.k)".replace("SELECT conv_id, k AS pos, state FROM i", "SELECT i.conv_id, CAST(k AS INTEGER) AS pos, state FROM i")


@register(
    "actor_endpoints",
    f"""WITH {_T} SELECT conv_id, arg_min(state, pos) FILTER (WHERE state IS NOT NULL) AS first_state, min(pos) FILTER (WHERE state IS NOT NULL) AS first_step,
    arg_max(state, pos) FILTER (WHERE state IS NOT NULL) AS last_state, max(pos) FILTER (WHERE state IS NOT NULL) AS last_step, count(state) AS n_observed,
    count(state) > 0 AND max(pos) FILTER (WHERE state IS NOT NULL) < 8 AS dropped_out FROM x GROUP BY conv_id""",
)
def actor_endpoints(spark, sf_dir):
    return sq.endpoints(_wide_turns(spark, sf_dir), ["conv_id"], 8)


@register(
    "mark_terminal_state",
    f"WITH {_T}, e AS (SELECT conv_id, max(pos) AS last FROM x WHERE state IS NOT NULL GROUP BY conv_id) SELECT x.conv_id, x.pos, CASE WHEN x.pos > e.last THEN 'End' ELSE state END AS state FROM x LEFT JOIN e USING (conv_id)",
)
def mark_terminal_state(spark, sf_dir):
    return sq.mark_ends(_wide_turns(spark, sf_dir), ["conv_id"], end="End").select("conv_id", "pos", "state")


@register(
    "bipartite_groups",
    "SELECT user_id AS node, event_type AS hyperedge, round(sum(value), 6) AS weight FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL GROUP BY ALL HAVING sum(value) > 0",
)
def bipartite_groups(spark, sf_dir):
    out = sq.bipartite_groups(read_table(spark, sf_dir, "events"), "user_id", "event_type", "value")
    return out.withColumn("weight", F.round("weight", 6))
