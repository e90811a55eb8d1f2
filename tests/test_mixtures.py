"""Mixtures fitted by passes over tables against dense fits and planted components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import clustering as cl
from eventloom.operators import mixtures as mx

STATES = ["A", "B", "C"]
#: Two chains: one that stays, one that goes round.
CHAINS = np.array([[[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]], [[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]]])


def planted(n=160, length=14, seed=1, slope=2.0):
    """(sequences, components, covariates): the second component is likelier for a large covariate."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x, z = r.gauss(5, 2), r.gauss(0, 1)
        c = int(r.random() < 1 / (1 + math.exp(-slope * (x - 5) / 2)))
        s = [r.randrange(3)]
        while len(s) < length:
            s.append(r.choices(range(3), CHAINS[c, s[-1]])[0])
        out.append((s, c, (x, z)))
    return out


def frames(spark, made):
    long = [(i, p + 1, STATES[s]) for i, (t, _, _) in enumerate(made) for p, s in enumerate(t)]
    about = spark.createDataFrame([(i, float(x[0]), float(x[1])) for i, (_, _, x) in enumerate(made)], "seq long, x double, z double")
    return spark.createDataFrame(long, "seq long, pos int, state string"), about


def dense(made, k, x=None, steps=400, smooth=0.01):
    """Expectation-maximisation on matrices, the logit solved to its end each time."""
    n, s = len(made), 3
    counts = np.zeros((n, s * s))
    for i, (t, _, _) in enumerate(made):
        for a, b in zip(t, t[1:], strict=False):
            counts[i, a * s + b] += 1
    first = np.eye(s)[[t[0] for t, _, _ in made]]
    post = np.eye(k)[[min(c, k - 1) for _, c, _ in made]] * 0.9 + 0.1 / k
    beta, last = None if x is None else np.zeros((k - 1, x.shape[1])), -math.inf
    for _ in range(steps):
        p = (post.T @ counts).reshape(k, s, s) + smooth
        p /= p.sum(2, keepdims=True)
        init = post.T @ first + smooth
        init /= init.sum(1, keepdims=True)
        if x is None:
            prior = np.tile(post.mean(0), (n, 1))
        else:
            for _ in range(30):
                eta = np.column_stack([np.zeros(n), x @ beta.T])
                prior = np.exp(eta) / np.exp(eta).sum(1, keepdims=True)
                for c in range(k - 1):
                    w = prior[:, c + 1] * (1 - prior[:, c + 1])
                    beta[c] += np.linalg.solve((x * w[:, None]).T @ x + 1e-6 * np.eye(x.shape[1]), x.T @ (post[:, c + 1] - prior[:, c + 1]))
        logs = counts @ np.log(p).reshape(k, -1).T + first @ np.log(init).T + np.log(prior)
        top = logs.max(1, keepdims=True)
        whole = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        post = np.exp(logs - whole[:, None])
        if abs(whole.sum() - last) < 1e-10:
            break
        last = whole.sum()
    return {"ll": whole.sum(), "chains": p, "share": post.mean(0), "post": post, "beta": beta}


def test_components_equal_a_dense_fit(spark):
    made = planted()
    df, _ = frames(spark, made)
    rows = mx.sequence_rows(df, ["seq"], STATES)
    found = mx.fit(rows, STATES, [1, 2], 3, 120, 1e-8)
    want = {k: dense(made, k) for k in (1, 2)}
    for k in (1, 2):
        assert found[k].log_likelihood == pytest.approx(want[k]["ll"], abs=1e-4) and found[k].n == len(made)
    by = np.argsort(-want[2]["share"])
    assert np.allclose(found[2].chains, want[2]["chains"][by], atol=1e-3) and np.allclose(found[2].share, want[2]["share"][by], atol=1e-3)
    assert found[2].bic < found[1].bic and found[2].free == 2 * 3 * 2 + 2 * 2 + 1
    out = mx.assigned(rows, found[2]).collect()
    assert np.allclose([r.posterior for r in sorted(out, key=lambda r: r.seq)], want[2]["post"][:, by], atol=1e-2)
    labels = np.array([by[r.component - 1] for r in sorted(out, key=lambda r: r.seq)])
    assert (labels == [c for _, c, _ in made]).mean() > 0.97
    q = mx.quality(mx.assigned(rows, found[2]), found[2]).first()
    post = np.array([r.posterior for r in out])
    assert q.n == len(made) and q.mean_posterior == pytest.approx(post.max(1).mean())
    assert q.entropy == pytest.approx(1 + (post * np.log(post + 1e-300)).sum() / (len(made) * math.log(2)))
    assert q.icl == pytest.approx(found[2].bic - 2 * np.log(post.max(1)).sum())
    edges = mx.networks(spark, found[2]).where("component = 1").groupBy("from").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1.0) for r in edges)


def test_covariates_equal_a_dense_fit(spark):
    made = planted(220, seed=3)
    df, about = frames(spark, made)
    rows = mx.sequence_rows(df, ["seq"], STATES, about, ["x", "z"])
    m = mx.fit(rows, STATES, [2], 2, 150, 1e-11, terms=["x", "z"])[2]
    x = np.column_stack([np.ones(len(made)), [v for _, _, v in made]])
    want = dense(made, 2, x)
    assert m.log_likelihood == pytest.approx(want["ll"], abs=1e-3)
    got = {r.term: r.coefficient for r in mx.coefficients(spark, m, ["x", "z"]).collect()}
    sign = 1 if want["share"][0] >= want["share"][1] else -1  # odds against the larger component
    assert [got[t] for t in ("(Intercept)", "x", "z")] == pytest.approx((sign * want["beta"][0]).tolist(), abs=0.02)
    assert abs(got["x"]) > 0.6 and abs(got["z"]) < 0.6  # planted: 1 and 0
    assert m.free == 2 * 6 + 2 * 2 + 3


def test_starts_and_sums_do_not_depend_on_tasks(spark):
    made = planted(60, 8)
    df, _ = frames(spark, made)
    a = mx.fit(mx.sequence_rows(df, ["seq"], STATES), STATES, [2], 2, 10)[2]
    b = mx.fit(mx.sequence_rows(df.repartition(7), ["seq"], STATES), STATES, [2], 2, 10)[2]
    assert a.log_likelihood == pytest.approx(b.log_likelihood) and np.allclose(a.chains, b.chains)
    counts, first = np.zeros((60, 3, 3)), np.array([t[0] for t, _, _ in made])
    for i, (t, _, _) in enumerate(made):
        for x, y in zip(t, t[1:], strict=False):
            counts[i, x, y] += 1
    assert mx.fit(mx.sequence_rows(df, ["seq"], STATES), STATES, [1], 1, 3)[1].log_likelihood == pytest.approx(cl.chain_mixture(counts, first, 1, 1)["log_likelihood"])


def test_odd_sequences(spark):
    """One state, none at all, gaps, an unknown state, missing covariates, repeats, and an empty table."""
    rows = [(1, 1, "A"), (2, 1, None), (3, 1, "A"), (3, 2, None), (3, 3, "B"), (4, 1, "A"), (4, 2, "B"), (5, 1, "A"), (5, 2, "B"), (6, 1, "Z"), (6, 2, "A")]
    df = spark.createDataFrame(rows, "seq long, pos int, state string")
    about = spark.createDataFrame([(1, 2.0), (4, None), (5, 3.0)], "seq long, x double")
    data = mx.sequence_rows(df, ["seq"], STATES, about, ["x"])
    got = {r.seq: (r.first, list(r.cells), list(r.x)) for r in data.collect()}
    assert got[1] == (0, [], [2.0]) and got[2] == (None, [], [None]) and got[4] == (0, [1], [None]) and len(got) == 6
    m = mx.fit(data, STATES, [2], 2, 5, terms=["x"])[2]
    assert m.n == 6 and np.isfinite(m.log_likelihood) and mx.assigned(data, m).count() == 6
    empty = mx.sequence_rows(df.limit(0), ["seq"], STATES)
    assert mx.fit(empty, STATES, [2], 1, 3)[2].n == 0
