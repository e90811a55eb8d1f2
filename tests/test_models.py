"""Models, kernels and resampling against known answers, brute force and properties."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions.expressions import average_ranks, bounded
from eventloom.kernels import chains, distributions, graphs, penalised, topology
from eventloom.operators import association, transitions
from eventloom.operators import clustering as cl
from eventloom.operators import context_tree as ct
from eventloom.operators import higher_order as ho
from eventloom.operators import margins as mg
from eventloom.operators import hypergraphs as hg
from eventloom.operators import resampling as rs
from eventloom.operators import transactions as ta
from test_sequences import edges, long

P = np.array([[0.7, 0.2, 0.1], [0.3, 0.5, 0.2], [0.2, 0.3, 0.5]])


def test_chain_known_answers():
    pi = chains.stationary(P)
    assert np.allclose(pi @ P, pi) and pi.sum() == pytest.approx(1)
    m = chains.passage_times(P)
    assert np.allclose(np.diag(m), 1 / pi)
    for i, j in itertools.product(range(3), repeat=2):
        if i != j:
            assert m[i, j] == pytest.approx(1 + sum(P[i, k] * m[k, j] for k in range(3) if k != j))
    x = chains.structure(P)
    assert x["irreducible"] and x["regular"] and not any(x["absorbing"])
    q = np.array([[0.5, 0.25, 0.25], [0, 1, 0], [0, 0, 1.0]])
    b, steps = chains.absorption(q)
    assert np.allclose(b, [[0.5, 0.5]]) and steps == pytest.approx([2])
    assert np.allclose(chains.hitting(q)[0], [0.5, 0.5, 0.5])
    assert chains.structure(np.array([[0, 1.0], [1, 0]]))["period"] == [2, 2]
    h = chains.entropies(np.full((4, 4), 0.25))
    assert h["entropy_rate"] == pytest.approx(2) and h["redundancy"] == pytest.approx(0)


def test_distributions():
    assert distributions.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert distributions.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert distributions.chi2_quantile(0.95, 10) == pytest.approx(18.307038053275146)
    assert distributions.beta_cdf(0.3, 2, 5) == pytest.approx(1 - sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2)))
    assert distributions.beta_cdf(distributions.beta_quantile(0.2, 3, 4), 3, 4) == pytest.approx(0.2)
    under, over = distributions.hypergeometric_tails(2, 20, 7, 6)
    pmf = [math.comb(7, k) * math.comb(13, 6 - k) / math.comb(20, 6) for k in range(7)]
    assert under == pytest.approx(sum(pmf[:3])) and over == pytest.approx(sum(pmf[2:]))
    assert distributions.adjust([0.01, 0.04, 0.03], "BH") == pytest.approx([0.03, 0.04, 0.04])
    assert distributions.adjust([0.01, 0.04, 0.03], "holm") == pytest.approx([0.03, 0.06, 0.06])


def test_shortest_paths_and_betweenness_by_enumeration():
    r = np.random.default_rng(4)
    w = np.where(r.random((6, 6)) < 0.5, r.integers(1, 4, (6, 6)), 0).astype(float)
    np.fill_diagonal(w, 0)
    d, sigma = graphs.distances(w)
    best, through = {}, np.zeros(6)
    for s, t in itertools.permutations(range(6), 2):
        found = []
        for n in range(5):
            for mid in itertools.permutations([v for v in range(6) if v not in (s, t)], n):
                path = (s, *mid, t)
                if all(w[a, b] > 0 for a, b in itertools.pairwise(path)):
                    found.append((sum(1 / w[a, b] for a, b in itertools.pairwise(path)), mid))
        if not found:
            assert np.isinf(d[s, t])
            continue
        least = min(x for x, _ in found)
        short = [m for x, m in found if abs(x - least) < 1e-10]
        best[s, t] = least
        assert d[s, t] == pytest.approx(least) and sigma[s, t] == len(short)
        for m in short:
            for v in m:
                through[v] += 1 / len(short)
    assert graphs.betweenness(w) == pytest.approx(through)
    assert graphs.weakly_connected(graphs.prune(w, 2.0)) == graphs.weakly_connected(w)


@pytest.mark.parametrize("rho", [0.05, 0.2])
def test_graphical_lasso_is_optimal(rho):
    s = np.array([[0.6 ** abs(i - j) for j in range(5)] for i in range(5)])
    theta, _ = penalised.graphical_lasso(s, rho)
    assert penalised.kkt_violation(theta, s, rho) < 1e-5


def test_sparse_models_find_a_chain():
    r = np.random.default_rng(1)
    x = np.zeros((4000, 5))
    x[:, 0] = r.standard_normal(4000)
    for j in range(1, 5):
        x[:, j] = 0.6 * x[:, j - 1] + r.standard_normal(4000)
    w, _, _ = penalised.sparse_partial(np.corrcoef(x.T), 4000)
    assert {(i, j) for i in range(5) for j in range(i) if abs(w[i, j]) > 0.1} == {(j + 1, j) for j in range(4)}
    b = np.zeros((3000, 4))
    b[:, 0] = r.random(3000) < 0.5
    for j in range(1, 4):
        b[:, j] = r.random(3000) < 1 / (1 + np.exp(-2 * (2 * b[:, j - 1] - 1)))
    m = penalised.ising(b, steps=15)
    assert all(m[j, j - 1] > 0.5 for j in range(1, 4)) and abs(m[0, 3]) < 0.3


def test_homology_of_known_shapes():
    circle = np.zeros((4, 4))
    for i in range(4):
        circle[i, (i + 1) % 4] = 1
    s = topology.cliques(circle)
    assert topology.betti(s)[:2] == [1, 1] and topology.euler(s) == 0
    full = topology.cliques(np.ones((4, 4)) - np.eye(4))
    assert topology.betti(full) == [1, 0, 0, 0] and topology.q_vector(full) == [1, 1, 1, 1]
    d = np.array([[0, 1, 2, 1], [1, 0, 1, 2], [2, 1, 0, 1], [1, 2, 1, 0.0]])
    pairs = topology.persistence(topology.filtration(d))
    assert (1, 1.0, 2.0) in pairs and sum(np.isinf(e) for _, _, e in pairs) == 1
    assert topology.bottleneck([(0, 2)], [(0, 3)]) == 1 and topology.bottleneck([(0, 2)], []) == 1
    assert topology.landscape([(0, 2)], np.array([0, 1, 2.0]), 2).tolist() == [[0, 1, 0], [0, 0, 0]]


def test_paths_and_orders(spark):
    rows = ho.trails(long(spark, "ABC", "ABD"), ["seq"])
    assert {r.path: r["count"] for r in ho.path_counts(rows, 2).collect()} == {"A -> B": 2, "B -> C": 1, "B -> D": 1}
    r = random.Random(2)
    sequences = []
    for _ in range(60):  # the next state is the one two back: order two
        s = [r.choice("AB"), r.choice("AB")]
        for _ in range(20):
            s.append(s[-2] if r.random() < 0.95 else r.choice("AB"))
        sequences.append(s)
    rows = ho.trails(long(spark, *sequences), ["seq"])
    table = ho.multi_order_table(rows, 3)
    assert min(table, key=lambda t: t["bic"])["order"] == 2
    tests = mg.markov_order(rows, 3, 50)
    assert tests[1]["p_permutation"] < 0.05
    rules = ct.rules(rows, 3)
    assert rules.where("order = 2").count()
    net = [{"from": " ".join(e["from"]), "to": " ".join(e["to"]), "probability": e.probability} for e in ct.network(rules).collect()]
    assert {e["from"] for e in net} == {" ".join(x.context) for x in rules.collect()}
    _, x, share = ho.embedding(net, 3)
    assert x.shape[1] == 3 and 0 < share <= 1


def test_log_likelihood_by_hand(spark):
    sequences = ["ABCA", "BCAB", "CC"]
    got = ho.order_log_likelihood(ho.trails(long(spark, *sequences), ["seq"]), 1).first()
    states = "".join(sequences)
    two = [s[i : i + 2] for s in sequences for i in range(len(s) - 1)]
    want = sum(math.log(states.count(s[0]) / len(states)) for s in sequences)
    want += sum(math.log(two.count(p) / sum(q[0] == p[0] for q in two)) for p in two)
    assert got.log_likelihood == pytest.approx(want) and got.n_states == len(states)


def test_transactions(spark):
    rows = spark.createDataFrame([(t, i) for t, items in enumerate(["ABC", "BC", "AC"]) for i in items], "tid int, item string")
    assert edges(ta.cooccurrence(rows)) == {("A", "A"): 2, ("A", "B"): 1, ("A", "C"): 2, ("B", "A"): 1, ("B", "B"): 2, ("B", "C"): 2, ("C", "A"): 2, ("C", "B"): 2, ("C", "C"): 3}
    baskets = spark.createDataFrame([(t, i) for t, items in enumerate(["ABC", "ABC", "AB", "BC", "AC"]) for i in items], "tid int, item string")
    rules = {(tuple(r.antecedent), tuple(r.consequent)): r for r in ta.association_rules(baskets, 0.2, 0.0, 0.0).collect()}
    assert rules[("A",), ("B",)].support == pytest.approx(3 / 5) and rules[("A",), ("B",)].confidence == pytest.approx(3 / 4)
    assert rules[("A", "B"), ("C",)].confidence == pytest.approx(2 / 3)
    assert len(rules) == 12


def test_hypergraph(spark):
    inc = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 1.0), ("c", "y", 3.0)], "node string, hyperedge string, weight double")
    assert edges(hg.clique_expansion(inc)) == {("a", "b"): 2, ("b", "a"): 2, ("b", "c"): 3, ("c", "b"): 3}


def test_bootstrap_centres_on_the_estimate(spark):
    r = random.Random(5)
    df = long(spark, *["".join(r.choice("AAB") for _ in range(8)) for _ in range(80)])
    counts = rs.sequence_counts(df, ["seq"], ["A", "B"])
    observed, boot = rs.collect_replicates(counts, ["seq"], ["A", "B"], 200, 3)
    assert np.abs(boot.mean(0) - observed).max() < 0.02
    table = rs.bootstrap_table(observed, boot, ["A", "B"])
    assert all(t["low"] <= t["weight"] <= t["high"] for t in table)
    again = rs.collect_replicates(counts, ["seq"], ["A", "B"], 5, 3)[1]
    assert np.array_equal(again, boot[:5])
    halves = rs.split_half(counts, ["seq"], ["A", "B"], 20)
    assert all(h["max_abs"] >= h["mean_abs"] for h in halves)


def test_replicates_draw_as_many_sequences_as_there_are(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK", 10)
    counts = rs.sequence_counts(long(spark, *["AB"] * 45), ["seq"], ["A", "B"])
    sums = [r.sums for r in rs.replicate_sums(counts, ["seq"], 20, 1, 4).collect()]
    assert all(s == [0, 45, 0, 0] for s in sums)
    part = [r.sums for r in rs.replicate_sums(counts, ["seq"], 20, 1, 4, 0.4).collect()]
    assert all(s == [0, 18, 0, 0] for s in part)


def test_permutation_finds_a_difference_and_no_other(spark):
    a = np.tile([[0, 5], [5, 0]], (30, 1, 1)).astype(float)
    b = np.tile([[5, 0], [0, 5]], (30, 1, 1)).astype(float)
    assert max(t["p_value"] for t in rs.permutation_table(a, b, ["A", "B"], 99)) == pytest.approx(0.01)
    assert min(t["p_value"] for t in rs.permutation_table(a, a.copy(), ["A", "B"], 99)) == 1
    c = rs.certainty(np.array([[90.0, 10], [50, 50]]), ["A", "B"])
    assert all(t["low"] < t["mean"] < t["high"] for t in c)


def test_distances_against_plain_ones(spark):
    r = random.Random(7)
    words = sorted({"".join(r.choice("ĀāĂ") for _ in range(r.randint(1, 7))) for _ in range(12)})
    df = spark.createDataFrame([(w,) for w in words], "text string")

    def lv(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for x in cl.distances(df, "lv").collect():
        assert x.d == lv(x.a, x.b)
    for kind in ("osa", "dl"):
        assert all(x.d <= lv(x.a, x.b) for x in cl.distances(df, kind).collect())
    grams = lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
    for x in cl.distances(df, "qgram").collect():
        assert x.d == sum(abs(grams(x.a).count(g) - grams(x.b).count(g)) for g in {*grams(x.a), *grams(x.b)})
    assert cl.EDITS["dl"]("ca", "abc") == 2 and cl.EDITS["osa"]("ca", "abc") == 3
    assert cl.EDITS["jw"]("MARTHA", "MARHTA") == pytest.approx(1 - 0.9611111)


def test_clusters_by_brute_force():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (6, 2)), r.normal(6, 1, (6, 2))])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    medoids, labels = cl.pam(d, 2)
    assert d[:, medoids].min(1).sum() == pytest.approx(min(d[:, list(c)].min(1).sum() for c in itertools.combinations(range(12), 2)))
    for method in ("ward.D2", "average", "complete", "single", "centroid", "median", "mcquitty", "ward.D"):
        assert len(set(cl.linkage(d, 2, method)[:6])) == 1
    assert cl.silhouette(d, labels).min() > 0


def test_mixture_separates_two_chains():
    r = np.random.default_rng(2)
    counts, first = [], []
    for k in range(80):
        p = [[0.9, 0.1], [0.1, 0.9]] if k % 2 else [[0.1, 0.9], [0.9, 0.1]]
        c, s = np.zeros((2, 2)), 0
        for _ in range(20):
            t = int(r.random() < p[s][1])
            c[s, t] += 1
            s = t
        counts.append(c)
        first.append(0)
    fit = cl.chain_mixture(np.array(counts), np.array(first), 2, 3)
    assert len(set(fit["labels"][::2])) == 1 and len(set(fit["labels"][1::2])) == 1 and fit["labels"][0] != fit["labels"][1]
    assert fit["bic"] < cl.chain_mixture(np.array(counts), np.array(first), 1, 1)["bic"]


def test_multinomial_regression():
    from eventloom.kernels import regression

    x = np.array([[1.0, 0], [1, 1], [1, 0], [1, 1]])
    y, n = np.array([0, 0, 1, 1]), np.array([30.0, 10, 20, 40])
    fit = regression.multinomial(x, y, n)
    assert fit["odds_ratio"][0, 1] == pytest.approx((40 * 30) / (20 * 10)) and fit["beta"][0, 0] == pytest.approx(math.log(20 / 30))
    assert fit["se"][0, 1] == pytest.approx(math.sqrt(1 / 30 + 1 / 10 + 1 / 20 + 1 / 40))
    apart = regression.multinomial(np.array([[1.0, 0], [1, 1]]), np.array([0, 1]), np.array([10.0, 10]), firth=True)
    # with cells of 10 and 0, Firth's estimate adds a half to each cell
    assert apart["beta"][0, 1] == pytest.approx(2 * math.log(10.5 / 0.5), rel=1e-3)


def test_likeness():
    from eventloom.kernels import likeness

    m = np.random.default_rng(0).random((4, 4))
    assert likeness.distance_correlation(m, 2 * m + 1) == pytest.approx(1) and likeness.rv(m, 3 * m) == pytest.approx(1)
    assert likeness.distance_correlation(m, np.ones((4, 4))) == 0


@pytest.mark.parametrize("method", ["ward.D", "ward.D2", "single", "complete", "average", "mcquitty", "centroid"])
def test_weighted_linkage_equals_expanded_duplicates(method):
    for seed in range(40):
        r = np.random.default_rng(seed)
        x = r.random((9, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        weight = r.integers(1, 5, 9) if method not in ("mcquitty",) else np.ones(9, int)
        of = np.repeat(np.arange(9), weight)
        for k in (2, 3, 4):
            few, many = cl.linkage(d, k, method, weight), cl.linkage(d[np.ix_(of, of)], k, method)
            assert {frozenset(np.flatnonzero(few[of] == c)) for c in range(k)} == {frozenset(np.flatnonzero(many == c)) for c in range(k)}


def test_weighted_mixture_equals_expanded_duplicates():
    r = np.random.default_rng(2)
    counts, first, weight = r.integers(0, 6, (12, 3, 3)).astype(float), r.integers(0, 3, 12), r.integers(1, 4, 12)
    # one component has no random start, so all its figures must agree; with two, the same parameters must
    few, many = cl.chain_mixture(counts, first, 1, weight=weight), cl.chain_mixture(np.repeat(counts, weight, 0), np.repeat(first, weight), 1)
    assert all(math.isclose(few[k], many[k], rel_tol=1e-9) for k in ("log_likelihood", "aic", "bic", "entropy"))
    few, many = cl.chain_mixture(counts, first, 2, 20, 2000, 1e-10, weight=weight), cl.chain_mixture(np.repeat(counts, weight, 0), np.repeat(first, weight), 2, 20, 2000, 1e-10)
    assert all(math.isclose(few[k], many[k], rel_tol=1e-4) for k in ("log_likelihood", "aic", "bic", "entropy"))


def test_weighted_sparse_models_equal_expanded_duplicates():
    r = np.random.default_rng(5)
    x = (r.random((40, 4)) < 0.5).astype(float)
    x[:, 1] = np.where(r.random(40) < 0.8, x[:, 0], x[:, 1])
    weight = r.integers(1, 6, 40)
    many = np.repeat(x, weight, 0)
    assert np.allclose(penalised.ising(x, weight=weight, steps=15), penalised.ising(many, steps=15), atol=1e-5)
    z = np.column_stack([r.standard_normal(40), x[:, 0] + 0.3 * r.standard_normal(40), x[:, 0]])
    assert np.allclose(penalised.mixed(z, ["g", "g", "c"], weight=weight, steps=15), penalised.mixed(np.repeat(z, weight, 0), ["g", "g", "c"], steps=15), atol=1e-5)


def test_multilevel_model_is_the_maximum_of_the_dense_likelihood(spark):
    r = np.random.default_rng(8)
    rows = []
    for person in range(14):
        level, last = r.standard_normal(2) * 1.5, np.zeros(2)
        for beep in range(int(r.integers(8, 20))):
            last = level + np.array([[0.4, 0.1], [-0.2, 0.3]]) @ (last - level) + r.standard_normal(2)
            rows.append((person, 1, beep, float(last[0]), float(last[1])))
    df = spark.createDataFrame(rows, "id int, day int, beep int, a double, b double")
    found = association.multilevel_lag_network(df, "id", "day", "beep", ["a", "b"])
    t = association.lagged_grid(df, "id", "day", "beep", ["a", "b"]).orderBy("id", "day", "beep").toPandas()
    who = (t.id.to_numpy()[:, None] == t.id.to_numpy()).astype(float)
    residual, sd, effects = [], [], np.zeros((2, 2))
    for o, (y, other) in enumerate((("a", "b"), ("b", "a"))):
        x, v = np.column_stack([np.ones(len(t)), t.lag_a, t.lag_b, t[f"mean_{other}"]]), t[y].to_numpy()

        def fit(ratio, x=x, v=v):
            inv = np.linalg.inv(np.eye(len(v)) + ratio * who)
            b = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ v)
            e = v - x @ b
            s2 = e @ inv @ e / len(v)
            return len(v) * math.log(s2) - np.linalg.slogdet(inv)[1], b, e - ratio * who @ inv @ e, s2, inv

        ratio = min(np.exp(np.linspace(-8, 6, 400)), key=lambda q: fit(q)[0])
        ratio = min(ratio * np.exp(np.linspace(-0.04, 0.04, 81)), key=lambda q: fit(q)[0])
        _, b, e, s2, inv = fit(ratio)
        residual.append(e)
        sd.append(math.sqrt(s2 * ratio))
        effects[o, 1 - o] = b[3]
        assert np.allclose(found["temporal"][o], b[1:3], atol=1e-3)
        se = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ inv @ x)))
        assert np.allclose([r["se"] for r in found["coefficients"] if r["outcome"] == y], se[1:3], rtol=1e-3)
    c = np.corrcoef(residual)[0, 1]
    assert abs(found["contemporaneous"][0, 1] - c) < 1e-3
    inverse = (np.eye(2) - effects) / np.array(sd)[:, None] ** 2
    inverse = (inverse + inverse.T) / 2
    assert np.linalg.eigvalsh(inverse).min() > 0
    assert abs(found["between"][0, 1] + inverse[0, 1] / math.sqrt(inverse[0, 0] * inverse[1, 1])) < 5e-3


def test_attention_is_the_sum_over_all_pairs(spark):
    r = random.Random(4)
    rows = [(s, p, r.choice("abc") if r.random() < 0.9 else None) for s in range(6) for p in range(1, 3 + 40 * s)]
    df = spark.createDataFrame(rows, "s int, pos int, state string")
    for scale in (0.05, 1.0, 3.0):  # with the first, stretches are of 15 positions
        for direction in ("forward", "backward", "both"):
            got = {(x["from"], x["to"]): x.weight for x in transitions.attention(df, ["s"], scale, direction).collect()}
            joined = {(x["from"], x["to"]): x.weight for x in transitions.attention(df, ["s"], direction=direction, decay=lambda g, scale=scale: F.exp(-g / scale)).collect()}
            assert got.keys() == joined.keys() and all(math.isclose(got[k], joined[k], rel_tol=1e-12) for k in got)


def test_average_ranks_by_ranges(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 9, 300), r.standard_normal(200)]).astype(float)
    got = {v.x: v["rank"] for v in average_ranks(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x", 7).collect()}
    order = np.sort(x)
    assert got == {v: (np.searchsorted(order, v) + 1 + np.searchsorted(order, v, "right")) / 2 for v in set(x.tolist())}


def test_too_much_for_one_matrix_is_refused(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        bounded(spark.range(9), 3, "rows")


def test_katz_is_the_damped_sum_of_walks():
    a = (np.random.default_rng(3).random((6, 6)) < 0.4).astype(float)
    np.fill_diagonal(a, 0)
    for damping in (None, 0.05, 9.0):
        radius = np.abs(np.linalg.eigvals(a)).max()
        d = damping if damping and damping * radius < 1 else 0.9 / radius
        want = sum(d**k * np.linalg.matrix_power(a, k) for k in range(1, 400))
        np.fill_diagonal(want, 0)
        assert np.allclose(graphs.katz(a, damping), want)


def test_window_network_front_and_registry(spark):
    from eventloom import estimators

    df = spark.createDataFrame([(1, 1, 1, 0, 1), (1, 2, 0, 1, 0), (1, 3, 1, 1, 0), (2, 1, 0, 0, 1), (2, 2, 1, 0, 0)], "who int, t int, a int, b int, c int")
    assert transitions.resolve_codes(df.columns, "a:b") == ["a", "b"] and transitions.resolve_codes(df.columns, (3, 5)) == ["a", "b", "c"] == transitions.resolve_codes(df.columns, None, ["who", "t"])
    both = transitions.window_network(df, ["who"], "a:c", ["t"], kind="both", relative=True).collect()
    assert {r.network for r in both} == {"transition", "cooccurrence"}
    share = {(r["from"], r["to"]): r.weight for r in both if r.network == "transition"}
    assert share["c", "a"] == share["c", "b"] == 0.5 and share["b", "a"] == 0.5
    out = estimators.build_network(df, "onehot", keys=["who"], codes="a:c", order=["t"], relative=True)
    assert {(r["from"], r["to"]): r.weight for r in out.collect()} == share
    assert estimators.build_network(df, "isingfit", columns=["a", "b", "c"]).columns == ["from", "to", "weight"]
    assert estimators.build_network(df, "mgm", columns=["t", "a", "b"], kinds=["g", "c", "c"]).columns == ["from", "to", "weight"]
    assert {"wtna", "ising", "mgm"} <= {e.name for e in estimators.list_estimators()}


def test_networks_are_validated_pruned_and_brought_back(spark):
    from eventloom.operators import networks as nw

    wide = spark.createDataFrame([("a", 0.0, 0.9), ("b", 0.2, 0.0)], "s string, a double, b double")
    net = nw.from_matrix(wide, "s", ["a", "b"])
    assert {(r["from"], r["to"], r.weight) for r in nw.validated(net).collect()} == {("a", "b", 0.9), ("b", "a", 0.2)}
    for rows, what in (([("a", None, 1.0)], "without an end"), ([("a", "b", float("nan"))], "no numbers"), ([("a", "b", 1.0), ("a", "b", 2.0)], "twice")):
        with pytest.raises(ValueError, match=what):
            nw.validated(spark.createDataFrame(rows, "from string, to string, weight double"))
    marked = nw.pruned(net, net.where("weight > 0.5"))
    assert nw.depruned(marked).count() == 2 and [r.weight for r in nw.repruned(marked).collect()] == [0.9]
    one = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "node string, cluster string")
    between, inside = nw.edge_list_layers(net, one)
    assert {(r["from"], r["to"], r.weight) for r in between.collect()} == {("x", "y", 0.9), ("y", "x", 0.2)} and inside.count() == 0
    with pytest.raises(ValueError, match="2 clusters"):
        nw.edge_list_layers(net, one.union(spark.createDataFrame([("a", "y")], one.schema)))


def test_complexes_are_verified():
    s = topology.cliques(np.array([[0, 1, 1], [0, 0, 1], [0, 0, 0]]))
    assert topology.is_complex(s) and not topology.is_complex([x for x in s if x != (0, 1)]) and not topology.is_complex([*s, (0,)])


def test_time_formats(spark):
    from eventloom.operators import sequences as sq

    for text in ("2024-03-05 06:07:08", "2024-03-05T06:07", "5 Mar 2024 06:07:08", "March 5 2024 06:07", "20240305060708", "202403050607", "05.03.2024"):
        got = sq.parse_time(spark.createDataFrame([(text,)], "t string"), "t").select(F.date_format("t", "yyyy-MM-dd").alias("d")).first().d
        assert got == "2024-03-05", text


def test_anomalies_become_paths(spark):
    found = spark.createDataFrame([("a b c", "over"), ("c d", "under"), ("e f", "normal")], "path string, kind string")
    assert {r.path for r in ho.anomaly_pathways(found).collect()} == {"a b -> c", "c -> d"}
    assert [r.path for r in ho.anomaly_pathways(found, "under").collect()] == ["c -> d"]
