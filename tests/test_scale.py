"""Joins with heavy keys, concordance by ranges, attention along long sequences, near sequences."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions.joins import pairs_by_key
from eventloom.operators import concordance as cc
from eventloom.operators import links as lk
from eventloom.operators import near_sequences as ns
from eventloom.operators import transactions as ta
from eventloom.operators import transitions as tr

# ---- heavy keys ----------------------------------------------------------------------


def test_heavy_baskets_and_hubs_give_the_same_in_parts(spark):
    r = random.Random(1)
    rows = {(0, f"i{i}") for i in range(120)} | {(t, f"i{r.randrange(40)}") for t in range(1, 60) for _ in range(4)}
    df = spark.createDataFrame(sorted(rows), "tid int, item string")
    key = lambda d: sorted(map(str, d.collect()))
    assert key(ta.cooccurrence(df, "jaccard", most=10)) == key(ta.cooccurrence(df, "jaccard"))
    edges = spark.createDataFrame([(f"a{i}", "hub", 1.0 + i % 3) for i in range(60)] + [(f"a{r.randrange(60)}", f"b{r.randrange(9)}", 1.0) for _ in range(80)], "from string, to string, weight double").groupBy("from", "to").agg(F.sum("weight").alias("weight"))
    for directed in (True, False):
        a, b = (lk.link_scores(edges, directed=directed, most=m).select("from", "to", *[F.round(c, 9) for c in ("common_neighbors", "resource_allocation", "adamic_adar", "jaccard")]) for m in (7, 1000))
        assert key(a) == key(b)


def test_no_task_of_a_heavy_key_is_large(spark):
    """A key of 2,000 rows in parts of 100: each pair of parts is a unit of work of its own."""
    rows = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    met = pairs_by_key(rows, ["k"], "x", 100)
    assert met.count() == 2000 * 2000 and met.select("a_x", "b_x").distinct().count() == 2000 * 2000
    parts = met.groupBy(F.pmod(F.xxhash64("a_x"), F.lit(20)), F.pmod(F.xxhash64("b_x"), F.lit(20))).count()
    assert parts.count() == 400 and parts.agg(F.max("count")).first()[0] < 150 * 150
    assert pairs_by_key(rows.limit(0), ["k"], "x").count() == 0


def test_evaluation_of_links_equals_a_sort(spark):
    r = random.Random(4)
    scored = [(f"a{i}", f"b{j}", float(r.choice((0, 0, 0, 1, 2, r.random())))) for i in range(30) for j in range(12)]
    truth = [(a, b) for a, b, s in scored if r.random() < 0.1 + 0.3 * (s > 0)]
    got = lk.evaluate(spark.createDataFrame(scored, "from string, to string, s double"), spark.createDataFrame(truth, "from string, to string"), "s").first()
    hits = [(a, b) in set(truth) for a, b, _ in sorted(scored, key=lambda x: (-x[2], x[0], x[1]))]
    assert got.average_precision == pytest.approx(sum(sum(hits[: k + 1]) / (k + 1) for k, h in enumerate(hits) if h) / sum(hits))
    assert got.precision_at_10 == sum(hits[:10]) / 10
    pos, neg = [s for a, b, s in scored if (a, b) in set(truth)], [s for a, b, s in scored if (a, b) not in set(truth)]
    assert got.auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))


# ---- concordance ---------------------------------------------------------------------


def plain_tau(rows):
    s = a = b = 0
    for (x, y), (u, v) in itertools.combinations(rows, 2):
        dx, dy = (x > u) - (x < u), (y > v) - (y < v)
        s, a, b = s + dx * dy, a + dx * dx, b + dy * dy
    return s / math.sqrt(a * b) if a and b else math.nan


@pytest.mark.parametrize("parts", [3, 64])
def test_kendall_equals_all_pairs(spark, parts):
    r = random.Random(2)
    for k in range(3):
        rows = [(float(r.choice((7, 7, r.random() * 20, r.randrange(9)))), float(r.randrange(5)) if k == 1 else r.random()) for _ in range(300)]
        rows = [(x, y + 0.05 * x) for x, y in rows] + rows[:40]
        df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None), (float("nan"), 2.0)], "x double, y double")
        assert cc.kendall(df, "x", "y", parts) == pytest.approx(plain_tau(rows), abs=1e-12)


def test_kendall_of_constants_and_many_values(spark):
    assert math.isnan(cc.kendall(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y"))
    assert math.isnan(cc.kendall(spark.createDataFrame([], "x double, y double"), "x", "y"))
    df = spark.range(20000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 7919 % 20011).cast("double").alias("y"))
    y = np.array([i * 7919 % 20011 for i in range(20000)])
    s = sum(int(np.sign(y[i + 1 :] - y[i]).sum()) for i in range(20000))
    assert cc.kendall(df, "x", "y") == pytest.approx(2 * s / (20000 * 19999), abs=1e-12)
    assert cc.kendall(df, "x", "x") == 1.0


def test_correlations_of_many_columns(spark):
    from eventloom.operators import association as asn

    x = np.random.default_rng(1).standard_normal((200, 20)) @ np.random.default_rng(2).standard_normal((20, 20)) + 100
    names = [f"v{i}" for i in range(20)]
    df = spark.createDataFrame([*(tuple(map(float, r)) for r in x), (None, *[1.0] * 19)], ", ".join(f"{c} double" for c in names)).repartition(3)
    r, n = asn.correlations(df, names)
    assert n == 200 and np.allclose(r, np.corrcoef(x.T))
    assert np.allclose(asn.correlations(df, names[:5])[0], np.corrcoef(x.T)[:5, :5])


# ---- attention -----------------------------------------------------------------------


def plain_attention(rows, scale, direction, time):
    out = {}
    for x, y in itertools.product(rows, rows):
        if x[0] == y[0] and x[3] and y[3] and (x[1] < y[1] if direction == "forward" else x[1] > y[1] if direction == "backward" else x[1] != y[1]):
            gap = abs(x[2] - y[2]) if time else abs(x[1] - y[1])
            out[x[3], y[3]] = out.get((x[3], y[3]), 0.0) + math.exp(-gap / scale)
    return out


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
@pytest.mark.parametrize("time", [None, "t"])
def test_attention_equals_all_pairs(spark, direction, time):
    r = random.Random(3)
    rows = []
    for seq, n in [("a", 200), ("b", 1), ("c", 30), (None, 9), ("d", 60), ("e", 3)]:
        t = 0.0
        for pos in range(1, n + 1):
            t += r.choice((0.0, 0.5, 3.0, 40.0)) if seq != "d" else r.choice((-1.0, 2.0))  # d goes back in time
            rows.append((seq, pos, t, r.choice(("x", "y", "z", None))))
    df = spark.createDataFrame(rows, "seq string, pos int, t double, state string")
    found = {(e["from"], e["to"]): e.weight for e in tr.attention(df, ["seq"], 5.0, direction, time).collect()}
    want = plain_attention([x for x in rows if x[0]], 5.0, direction, time)
    extra = plain_attention([("none", *x[1:]) for x in rows if x[0] is None], 5.0, direction, time)  # a sequence of its own
    want = {k: want.get(k, 0.0) + extra.get(k, 0.0) for k in want.keys() | extra.keys()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_attention_of_one_long_sequence_is_spread(spark):
    """30,000 rows of one sequence: parts of several tasks and batches hand on what they leave."""
    n, scale = 30000, 50.0
    df = spark.range(n).select(F.lit(1).alias("seq"), (F.col("id") + 1).cast("int").alias("pos"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("state"))
    found = {(e["from"], e["to"]): e.weight for e in tr.attention(df, ["seq"], scale).collect()}
    keep, v, want = math.exp(-1 / scale), {"a": 0.0, "b": 0.0}, {}
    for i in range(n):
        s = "a" if i % 3 == 0 else "b"
        v = {k: x * keep for k, x in v.items()}
        for k, x in v.items():
            want[k, s] = want.get((k, s), 0.0) + x
        v[s] += 1.0
    assert all(found[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert tr.attention(df.limit(0), ["seq"], scale).count() == 0


# ---- near sequences ------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances_of_many_pairs():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé\U0001f642") for _ in range(r.randrange(12)))
    a, b = [word() for _ in range(400)], [word() for _ in range(400)]
    want = [plain_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert ns.edit_distances(a, b).tolist() == want
    for k in (0, 1, 3):
        assert ns.edit_distances(a, b, k).tolist() == [min(d, k + 1) for d in want]


@pytest.mark.parametrize("pivots", [None, [""], ["", "abab", "zzzzzzzz", ""]])
def test_near_pairs_equal_all_pairs(spark, pivots):
    r = random.Random(6)
    base = ["".join(r.choice("abc") for _ in range(r.randrange(1, 25))) for _ in range(60)]
    texts = base + [t[: len(t) // 2] + r.choice("abc") + t[len(t) // 2 :] for t in base[:30]] + ["", "a"]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string")
    for k in (0, 2):
        want = {(a, b, plain_distance(a, b)) for a, b in itertools.combinations(sorted(set(texts)), 2)}
        assert {(x.a, x.b, x.d) for x in ns.near_pairs(df, k, pivots).collect()} == {x for x in want if x[2] <= k}
    about = ns.share_compared(df, 2, pivots).first()
    n = len(set(texts))
    assert about.texts == n and about.pairs == n * (n - 1) // 2 and about.compared <= about.pairs
    assert ns.near_pairs(df.limit(0), 2).count() == 0


def test_distances_by_words_of_bits(spark):
    """Texts shorter and longer than a word, and no row for each pair that is compared."""
    r = random.Random(7)
    texts = ["".join(r.choice("abé") for _ in range(r.choice([0, 1, 2, 5, 9, 63, 64, 65, 80]))) for _ in range(60)]
    texts += [t[:-1] + "c" for t in texts if t]
    i, j = np.nonzero(np.triu(np.ones((len(texts),) * 2, bool), 1))
    want = [plain_distance(texts[a], texts[b]) for a, b in zip(i, j, strict=True)]
    for k in (1, 80):
        assert ns.pair_distances(texts, i, j, k).tolist() == [min(d, k + 1) for d in want]
    # two cells of one part: 300 texts of one length, all pairs of which are compared
    df = spark.createDataFrame([("".join(r.choice("ab") for _ in range(9)),) for _ in range(300)], "text string")
    assert ns._cells(df, 9, [""]).count() == 1
