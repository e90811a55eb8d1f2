"""Sequences, transitions and networks against known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom import estimators
from eventloom.operators import networks as nw
from eventloom.operators import sequences as sq
from eventloom.operators import transitions as tr


def long(spark, *sequences):
    rows = [(i, p, s) for i, states in enumerate(sequences, 1) for p, s in enumerate(states, 1)]
    return spark.createDataFrame(rows, "seq int, pos int, state string")


def edges(df):
    return {(r["from"], r["to"]): r.weight for r in df.collect()}


def test_transitions_of_two_alternating_actors(spark):
    df = long(spark, "ABA", "BAB")
    assert edges(tr.frequency(df, ["seq"])) == {("A", "B"): 2, ("B", "A"): 2}
    assert edges(tr.relative(df, ["seq"])) == {("A", "B"): 1, ("B", "A"): 1}


def test_missing_states_break_pairs(spark):
    df = long(spark, ["A", None, "B", "C"])
    assert edges(tr.frequency(df, ["seq"])) == {("B", "C"): 1}
    assert edges(tr.frequency(long(spark, "AAB"), ["seq"], weighted=True)) == pytest.approx({("A", "A"): 1 / 3, ("A", "B"): 1 / 3})


def test_sessions_split_strictly_after_the_gap(spark):
    rows = [("a", 0, 1), ("a", 900, 2), ("a", 1801, 3), ("b", 5, 4), ("b", 5, 5)]
    df = spark.createDataFrame(rows, "actor string, t long, ord int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.ord: (r.session, r.pos) for r in sq.sessions(df, ["actor"], "ts", ["ord"]).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 1), 4: (1, 1), 5: (1, 2)}
    assert {r.session for r in sq.sessions(df, ["actor"], "ts", ["ord"], None).collect()} == {1}


def test_sessions_against_a_loop(spark):
    r = random.Random(3)
    rows = [(f"a{r.randrange(4)}", r.choice([0, 10, 900, 901, 5000]) + 1000 * r.randrange(6), i) for i in range(120)]
    df = spark.createDataFrame(rows, "actor string, t long, ord int").withColumn("ts", F.timestamp_seconds("t"))
    got = {x.ord: (x.session, x.pos) for x in sq.sessions(df, ["actor"], "ts", ["ord"]).collect()}
    last, session, pos = {}, {}, {}
    for actor, t, i in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        if actor not in last or t - last[actor] > 900:
            session[actor], pos[actor] = session.get(actor, 0) + 1, 0
        last[actor] = t
        pos[actor] += 1
        assert got[i] == (session[actor], pos[actor])


def test_times_take_one_format_for_all(spark):
    df = spark.createDataFrame([("2024-01-31 10:00:00",), ("bad",)], "t string")
    assert [r.t is None for r in sq.parse_time(df, "t").collect()] == [False, True]
    df = spark.createDataFrame([("31/01/2024",)], "t string")
    assert sq.parse_time(df, "t").first().t.day == 31
    assert sq.parse_time(spark.createDataFrame([(1500,)], "t long"), "t", unix_unit="milliseconds").select(F.unix_micros("t").alias("u")).first().u == 1_500_000
    with pytest.raises(ValueError):
        sq.parse_time(spark.createDataFrame([("x",)], "t string"), "t")


def test_endpoints_and_marks(spark):
    df = long(spark, ["A", "B", "A", None, None], "ABABA", [None] * 5, ["B", None, "A", None, None], [None, "A", None, None, None])
    got = {r.seq: r for r in sq.endpoints(df, ["seq"]).collect()}
    assert [got[i].dropped_out for i in range(1, 6)] == [True, False, False, True, True]
    assert [got[i].n_observed for i in range(1, 6)] == [3, 5, 0, 2, 1]
    assert [got[i].last_state for i in range(1, 6)] == ["A", "A", None, "A", "A"]
    marked = {(r.seq, r.pos): r.state for r in sq.mark_ends(df, ["seq"], "Start", "End").collect()}
    assert [marked[5, p] for p in range(1, 6)] == ["Start", "A", "End", "End", "End"]
    assert [marked[4, p] for p in range(1, 6)] == ["B", None, "A", "End", "End"]


def test_wide_and_long_go_round(spark):
    df = long(spark, "AB", "CAB")
    wide = sq.long_to_wide(df, ["seq"], 3)
    assert wide.columns == ["seq", "V1", "V2", "V3"]
    back = sq.wide_to_long(wide, ["seq"], ["V1", "V2", "V3"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_markers(spark):
    got = edges(tr.frequency(sq.with_markers(long(spark, ["A", "B", None]), ["seq"], "S", "E"), ["seq"]))
    assert got == {("S", "A"): 1, ("A", "B"): 1, ("B", "E"): 1}


def test_cooccurrence_equals_enumerated_pairs(spark):
    r = random.Random(1)
    sequences = [[r.choice("ABC") for _ in range(r.randint(1, 9))] for _ in range(20)]
    want = {}
    for s in sequences:
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for a, b in {(s[i], s[j]), (s[j], s[i])}:
                    want[a, b] = want.get((a, b), 0) + 1
    assert edges(tr.co_occurrence(long(spark, *sequences), ["seq"])) == want


def test_attention(spark):
    got = edges(tr.attention(long(spark, "ABA"), ["seq"], 1.0))
    assert got == pytest.approx({("A", "B"): math.exp(-1), ("B", "A"): math.exp(-1), ("A", "A"): math.exp(-2)})


def test_one_hot_windows(spark):
    rows = [(1, i, a, b, 0) for i, (a, b) in enumerate(zip([1, 0, 1, 0, 1], [0, 1, 0, 1, 0], strict=True))]
    df = spark.createDataFrame(rows, "g int, t int, A int, B int, C int")
    assert edges(tr.one_hot_windows(df, ["g"], ["A", "B", "C"], ["t"], 1)) == {("A", "B"): 2, ("B", "A"): 2}
    assert edges(tr.one_hot_windows(df.limit(0), ["g"], ["A"], ["t"], 3, True)) == {}


@pytest.mark.parametrize(("method", "values", "want"), [("sum", [0.5, 0.8, 0.3], 1.6), ("mean", [2, 4, 6], 4), ("median", [1, 3, 5], 3), ("max", [1, 5, 3], 5), ("min", [1, 5, 3], 1), ("prod", [2, 3, 4], 24), ("geomean", [4, 9], 6), ("density", [1, 2, 3], 2)])
def test_weight_reductions(spark, method, values, want):
    df = spark.createDataFrame([("a", float(v)) for v in [*values, 0]], "k string, weight double")
    assert nw.aggregate_weights(df, ["k"], method).first().weight == pytest.approx(want)


def test_scalings(spark):
    df = spark.createDataFrame([("A", "B", 2.0), ("A", "C", 2.0), ("B", "A", 8.0)], "from string, to string, weight double")
    assert edges(nw.scaled(df, "rank")) == {("A", "B"): 1.5, ("A", "C"): 1.5, ("B", "A"): 3.0}
    assert edges(nw.scaled(df, "max"))["A", "B"] == 0.25
    assert edges(nw.scaled(df, "normalize"))["A", "C"] == 0.5
    assert min(edges(nw.scaled(nw.filled(df), "minmax", True)).values()) == 0
    with pytest.raises(ValueError):
        nw.scaled(df, "no such")
    assert len(edges(nw.extract_edges(df))) == 6
    assert edges(nw.subtract(df, df)) == {("A", "B"): 0, ("A", "C"): 0, ("B", "A"): 0}


def test_estimators_are_a_registry(spark):
    df = long(spark, "ABA")
    assert edges(estimators.build_network(df, "tna", ["seq"])) == {("A", "B"): 1, ("B", "A"): 1}
    estimators.register_estimator("mine", lambda d, seq: tr.frequency(d, seq), "test")
    assert "mine" in [e.name for e in estimators.list_estimators()]
    assert edges(estimators.build_network(df, "mine", ["seq"], threshold=2)) == {}
    estimators.remove_estimator("mine")
    with pytest.raises(KeyError):
        estimators.get_estimator("mine")


def test_networks_by_group_share_their_nodes(spark):
    rows = [("x", 1, 1, "A"), ("x", 1, 2, "B"), ("x", 1, 3, "A"), ("y", 2, 1, "B"), ("y", 2, 2, "C"), (None, 3, 1, "A"), (None, 3, 2, "C")]
    df = spark.createDataFrame(rows, "g string, seq int, pos int, state string")
    for method in ("frequency", "attention"):
        found = {(r.group, r["from"], r["to"]): r.weight for r in estimators.build_network(df, method, ["seq"], group="g").collect()}
        assert len(found) == 2 * 9 and {g for g, _, _ in found} == {"x", "y"}
        assert found["x", "A", "B"] > 0 == found["x", "B", "C"] and found["y", "B", "C"] > 0 == found["y", "A", "B"]
    assert estimators.build_network(df.where("g IS NULL"), "frequency", ["seq"], group="g").count() == 0


def test_networks_between_and_within_persons(spark):
    rows = [(p, float(p + d), float(p - d)) for p in range(6) for d in (-1, 0, 1)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    weight = lambda level: estimators.build_network(df, "cor", level=level, id_column="id", columns=["a", "b"]).first().weight
    assert round(weight("between"), 9) == 1 and round(weight("within"), 9) == -1
    with pytest.raises(ValueError, match="id_column"):
        estimators.build_network(df, "cor", level="between", columns=["a", "b"])
