"""Tables with fixed margins, permutation of k-grams, adjusted p-values, path anomalies."""

import collections
import itertools
import math
import random

import numpy as np
import pytest

from eventloom.functions.expressions import benjamini_hochberg
from eventloom.kernels.distributions import adjust_bh, hypergeometric_tails
from eventloom.operators import higher_order as ho
from eventloom.operators import label_tests as lt
from eventloom.operators import margins as mg


def frame(spark, trails):
    return spark.createDataFrame([(i, *t) for i, t in enumerate(trails)], "seq long, grp string, states array<string>")


def enumerated(rows, columns):
    """All tables with the margins and how many permutations give each."""
    out = {}
    labels = [j for j, c in enumerate(columns) for _ in range(c)]
    ends = np.cumsum(rows)
    for p in itertools.permutations(range(len(labels))):
        t = tuple(tuple(sum(labels[i] == j for i in p[e - r : e]) for j in range(len(columns))) for r, e in zip(rows, ends, strict=True))
        out[t] = out.get(t, 0) + 1
    return out


def test_drawn_tables_have_their_margins_and_chances():
    rng = np.random.default_rng(1)
    rows, columns = np.array([3, 2, 2]), np.array([4, 3])
    drawn = mg.draw_tables(rng, rows, columns, 20000)
    assert (drawn.sum(2) == rows).all() and (drawn.sum(1) == columns).all()
    want = enumerated(rows.tolist(), columns.tolist())
    total = sum(want.values())
    got = collections.Counter(tuple(map(tuple, t.tolist())) for t in drawn)
    assert set(got) == set(want)
    assert all(abs(got[t] / 20000 - n / total) < 0.015 for t, n in want.items())
    big = mg.draw_tables(rng, np.array([3 * 10**9, 10**9]), np.array([10**9, 3 * 10**9]), 50)
    assert (big.sum(2) == [3 * 10**9, 10**9]).all() and abs(big[:, 0, 0].mean() / 7.5e8 - 1) < 1e-4


def test_order_test_is_near_its_exact_p(spark):
    trails = ["ABABBABA", "BBAAB", "ABBA"]
    rows = frame(spark, [("x", list(t)) for t in trails])
    pairs = [(a, b) for t in trails for a, b in itertools.pairwise(t)]
    cells = np.array([[pairs.count((a, b)) for b in "AB"] for a in "AB"])
    observed = mg.g_squared(cells[None])[0]
    found = mg.markov_order(rows, 2, 1500, seed=3)
    assert found[0]["g2"] == pytest.approx(observed) and found[0]["df"] == 1
    n, r, c = int(cells.sum()), cells.sum(1), cells.sum(0)
    exact = 0.0
    for k in range(int(min(r[0], c[0])) + 1):
        t = np.array([[k, r[0] - k], [c[0] - k, r[1] - c[0] + k]])
        if (t >= 0).all() and mg.g_squared(t[None])[0] >= observed - 1e-9:
            exact += math.comb(int(r[0]), k) * math.comb(int(r[1]), int(c[0] - k)) / math.comb(n, int(c[0]))
    assert abs(found[0]["p_permutation"] - exact) < 0.04
    again = mg.markov_order(rows.repartition(5), 2, 1500, seed=3)
    assert found == again  # draws don't depend on tasks
    assert mg.markov_order(frame(spark, [("x", ["A"])]), 1, 10)[0]["p_permutation"] == 1.0


def test_mosaic_of_cells_and_permutations(spark):
    rows = [("F", "Low")] * 30 + [("F", "High")] * 12 + [("M", "Low")] * 14 + [("M", "High")] * 26 + [("X", "Low")] * 3 + [("F", None), (None, "Low")]
    df = spark.createDataFrame(rows, "g string, lvl string")
    cells = mg.mosaic_cells(df, "g", "lvl", 10)
    got = {(r["row"], r["column"]): r for r in cells.collect()}
    assert {k: r["count"] for k, r in got.items()} == {("F", "Low"): 30, ("F", "High"): 12, ("M", "Low"): 14, ("M", "High"): 26}
    assert got["F", "Low"].expected == pytest.approx(42 * 44 / 82) and got["F", "Low"].percent == pytest.approx(100 * 30 / 82)
    z = {(r["row"], r["column"]): r for r in mg.mosaic_permutation(cells, 2000).collect()}
    for k, r in z.items():  # the exact deviation has n - 1 where the residual has n
        assert r.z == pytest.approx(got[k].residual * math.sqrt(81 / 82), abs=0.25)
    likely = lambda k: math.comb(42, k) * math.comb(40, 44 - k) / math.comb(82, 44)
    exact = sum(likely(k) for k in range(4, 43) if likely(k) <= likely(30) * (1 + 1e-9))
    assert abs(z["F", "Low"].fisher_p - exact) < 0.003
    zeros = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y")], "g string, lvl string")
    assert {(r["row"], r["column"]): r["count"] for r in mg.mosaic_cells(zeros, "g", "lvl", 1).collect()} == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 2}
    assert mg.mosaic_permutation(mg.mosaic_cells(df.limit(0), "g", "lvl"), 10).count() == 0


def labels_of_all(rows, n_perm, seed, block):
    """Every sequence's label in each replicate, block by block, as the test deals them."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    names = sorted({r.grp for r in rows.collect()})
    totals = np.array([rows.where(F.col("grp") == n).count() for n in names])
    blocks = max(1, math.ceil(int(totals.sum()) / block))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("seq"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("at", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("seq"), "seq")) - 1).collect()
    sizes = collections.Counter(r.b for r in dealt)
    bounds = np.concatenate([[0], np.cumsum([sizes[b] for b in range(blocks)])])
    codes = {b: lt.block_labels(seed, bounds, totals, n_perm, b) for b in range(blocks)}
    return {r.seq: codes[r.b][:, r.at] for r in dealt}, names, totals


@pytest.mark.parametrize("block", [4096, 16])
def test_kgram_counts_equal_naive_relabelling(spark, block):
    r = random.Random(2)
    trails = [(g, [r.choice("AAB" if g == "x" else "ABB") for _ in range(r.randint(1, 12))]) for g in "xxyyz" for _ in range(20)]
    rows, n_perm = frame(spark, trails), 70
    labels, names, totals = labels_of_all(rows, n_perm, 5, block)
    matrix = np.array([labels[i] for i in range(len(trails))])
    assert all((matrix == g).sum(0).tolist() == [t] * n_perm for g, t in enumerate(totals))
    assert len({tuple(x) for x in matrix.T.tolist()}) == n_perm
    kept = spark.createDataFrame([(2, "A -> B"), (2, "A -> A"), (3, "A -> B -> A")], "length int, pattern string")
    sums, found, _ = lt.replicate_counts(rows, ["seq"], "grp", kept, [2, 3], n_perm, 5, block)
    assert found == names
    for row in sums.collect():
        gram = row.pattern.split(" -> ")
        times = np.array([sum(s[i : i + row.length] == gram for i in range(len(s))) for _, s in trails])
        want = [[int(times[matrix[:, k] == g].sum()) for k in range(n_perm)] for g in range(3)]
        assert np.frombuffer(row.sums, np.int64).reshape(3, n_perm).tolist() == want


def test_kgram_test_finds_what_differs(spark):
    r = random.Random(3)
    made = lambda g: [x for _ in range(12) for x in ("ABA" if r.random() < (0.5 if g == "x" else 0.1) else r.choice(["ABB", "BBA", "CAC"]))]
    rows = frame(spark, [(g, made(g)) for g in "xy" for _ in range(40)])
    found = {x.pattern: x for x in lt.kgram_test(rows, ["seq"], "grp", [3], 5, 199, 1).collect()}
    assert found["A -> B -> A"].p_value == 1 / 200 and found["A -> B -> A"].effect > 5
    again = {x.pattern: x.p_value for x in lt.kgram_test(rows.repartition(3), ["seq"], "grp", [3], 5, 199, 1).collect()}
    assert again == {k: x.p_value for k, x in found.items()}
    ps = [x.p_value for x in found.values()]
    assert [x.adjusted for x in found.values()] == pytest.approx(adjust_bh(ps))
    same = frame(spark, [(g, [r.choice("AB") for _ in range(20)]) for g in "xy" for _ in range(60)])
    assert sum(x.p_value < 0.05 for x in lt.kgram_test(same, ["seq"], "grp", [2], 5, 199, adjust="none").collect()) <= 2


def test_adjusted_p_values_by_ranges(spark):
    r = random.Random(1)
    p = [round(r.random() ** 3, 2) for _ in range(400)] + [0.0, 1.0] + [r.random() for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in p] + [(None,)], "p double")
    got = {x.p: x.adjusted for x in benjamini_hochberg(df, "p", 8).collect()}
    assert all(got[x] == pytest.approx(a) for x, a in zip(p, adjust_bh(p), strict=True)) and len(got) == len(set(p))
    assert benjamini_hochberg(df.limit(0), "p").count() == 0


def test_path_anomalies_equal_plain_ones(spark):
    r = random.Random(6)
    trails = [[r.choice("ABC")] for _ in range(80)]
    for t in trails:
        while len(t) < 15:
            t.append("C" if t[-2:] == ["A", "B"] and r.random() < 0.9 else r.choice("ABC"))
    counts = collections.Counter(" ".join(t[i : i + 3]) for t in trails for i in range(len(t) - 2))
    out_, in_ = collections.Counter(), collections.Counter()
    for p, n in counts.items():
        out_[p[:3]] += n
        in_[p[2:]] += n
    xi = {p: out_[p[:3]] * in_[p[2:]] for p in counts}
    total, all_xi = sum(counts.values()), sum(xi.values())
    tails = {p: hypergeometric_tails(n, all_xi, xi[p], total) for p, n in counts.items()}
    names = sorted(counts)
    over = dict(zip(names, adjust_bh([tails[p][1] for p in names]), strict=True))
    found = ho.hypa(frame(spark, [("x", t) for t in trails]), 2)
    got = {x.path: x for x in found.collect()}
    assert set(got) == set(names)
    for p in names:
        assert got[p].observed == counts[p] and got[p].expected == pytest.approx(total * xi[p] / all_xi)
        assert (got[p].p_under, got[p].p_over) == pytest.approx(tails[p]) and got[p].adjusted_over == pytest.approx(over[p])
    assert got["A B C"].kind == "over" and ("over", "A B -> C") in {(x.kind, x.path) for x in ho.anomaly_pathways(found).collect()}
    assert not ho.anomaly_pathways(found, "under").where("kind = 'over'").count()
