"""Path models of persons: the solver against least squares, and planted paths."""

import numpy as np
import pytest

from eventloom.kernels.paths import PathModel, PathModels
from eventloom.operators import person_paths as pp

COLUMNS = ["x", "y", "z"]


def series(n, seed, extra=False, cross=0.6):
    """y goes with x at once, all depend on themselves; some persons' z depends on x a step before."""
    r = np.random.default_rng(seed)
    v, out = np.zeros(3), []
    for _ in range(n + 20):
        x = 0.4 * v[0] + r.standard_normal()
        z = 0.3 * v[2] + (0.7 * v[0] if extra else 0.0) + r.standard_normal()
        v = np.array([x, 0.3 * v[1] + cross * x + r.standard_normal(), z])
        out.append(v)
    return np.array(out[20:])


def frame(spark, people):
    rows = [(f"p{k}", t, *map(float, v)) for k, s in enumerate(people) for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "who string, t int, x double, y double, z double")


def test_model_equals_least_squares_and_its_indices():
    s = np.cov(np.hstack([series(400, 1)[1:], series(400, 1)[:-1]]).T, bias=True)
    m = PathModel(s, 399, 3, [(0, 3), (1, 4), (1, 0), (2, 5)])
    assert m.converged and m.stable()
    want = np.linalg.solve(s[np.ix_([0, 4], [0, 4])], s[[0, 4], 1])
    assert np.allclose([m.a[1, 0], m.a[1, 4]], want, atol=1e-5)
    fits = m.fit_measures()
    assert fits["df"] == 21 - 4 - 3 - 6 and fits["rmsea"] < 0.08 and fits["cfi"] > 0.97
    # an index is about what chi-square falls by when its path is added
    without = PathModel(s, 399, 3, [(0, 3), (1, 4), (2, 5)])
    more = PathModel(s, 399, 3, [(0, 3), (1, 4), (2, 5), (1, 0)])
    fall = without.fit_measures()["chisq"] - more.fit_measures()["chisq"]
    index = without.modification([(1, 0), (2, 0)])
    assert 0.5 * fall < index[0] < 1.5 * fall and index[0] > 50 > 10 > index[1]
    assert abs(more.z()[3]) > 8
    # feedback: two paths against each other, which least squares can't take apart
    r = np.random.default_rng(4)
    past, e = r.standard_normal((4000, 2)), r.standard_normal((4000, 2))
    now = np.linalg.solve(np.array([[1, -0.4], [0.3, 1.0]]), (0.6 * past + e).T).T
    both = PathModel(np.cov(np.hstack([now, past]).T, bias=True), 4000, 2, [(0, 2), (1, 3), (0, 1), (1, 0)])
    assert both.converged and np.allclose([both.a[0, 1], both.a[1, 0]], [0.4, -0.3], atol=0.07)


def test_planted_paths_are_recovered(spark):
    people = [series(150, k, extra=k % 4 == 0) for k in range(16)]
    found = pp.person_paths(frame(spark, people).repartition(5), "who", ["t"], COLUMNS)
    rows = found.collect()
    group = {(r.outcome, r.predictor, r.lag) for r in rows if r.level == "group"}
    assert group in ({("y", "x", 0)}, {("x", "y", 0)})
    own = {(r.person, r.outcome, r.predictor, r.lag) for r in rows if r.level == "own"}
    with_extra = {f"p{k}" for k in range(0, 16, 4)}
    have = {p for p, o, x, lag in own if (o, x, lag) == ("z", "x", 1)}
    assert have <= with_extra and len(have) >= 3  # a model that fits well without is left alone
    assert len(own) <= len(with_extra) + 4
    assert all(r.rmsea < 0.2 and r.cfi > 0.8 for r in rows) and len({r.person for r in rows}) == 16
    shares = {(r.outcome, r.predictor, r.lag): r for r in pp.path_shares(found).collect()}
    assert shares["x", "x", 1].share == 1.0 and shares["x", "x", 1].mean_estimate == pytest.approx(0.4, abs=0.12)


def test_moments_and_options(spark):
    people = [series(60, k) for k in range(4)]
    df = frame(spark, people)
    got = {r.person: r for r in pp.person_moments(df, "who", ["t"], COLUMNS).collect()}
    s = np.cov(np.hstack([people[2][1:], people[2][:-1]]).T, bias=True)
    assert got["p2"].n == 59 and np.allclose(np.array(got["p2"]["cov"]).reshape(6, 6), s)
    rows = pp.person_paths(df, "who", ["t"], COLUMNS, exogenous=["x"], paths=[("y", "x", 0)]).collect()
    assert not [r for r in rows if r.outcome == "x"] and len([r for r in rows if r.level == "fixed"]) == 4 * 3
    odd = spark.createDataFrame([("a", 1, 1.0, 2.0, 3.0), (None, 1, 1.0, 1.0, 1.0), ("b", 1, None, 2.0, 1.0), ("b", 2, 1.0, 2.0, 1.0), *[("c", t, 1.0, float(t % 3), float(t % 5)) for t in range(9)]], "who string, t int, x double, y double, z double")
    assert pp.person_paths(odd, "who", ["t"], COLUMNS).count() == 0
    with pytest.raises(ValueError, match="isn't exogenous"):
        pp.person_paths(df, "who", ["t"], COLUMNS, exogenous=COLUMNS)


def test_models_side_by_side_equal_each_alone():
    """Different paths, a feedback, and matrices that no model fits: singular, not a number."""
    r = np.random.default_rng(8)
    all_ = [(0, 3), (1, 4), (2, 5), (1, 0), (0, 1), (2, 0), (1, 3), (2, 1), (0, 5)]
    s = [np.cov(np.hstack([x[1:], x[:-1]]).T, bias=True) for x in (series(40, k, extra=k % 2 == 0) for k in range(30))]
    s += [np.ones((6, 6)), np.full((6, 6), np.nan)]
    free = r.random((len(s), len(all_))) < 0.5
    free[0], free[1] = True, False
    n = r.integers(20, 90, len(s))
    m = PathModels(np.array(s), n, 3, all_, free)
    fits, z, gains, stable, beta = m.fit_measures(), m.z(), m.modification(), m.stable(), m.standardised()
    assert m.converged[:30].sum() > 20 and not m.converged[30:].any()
    for k in range(30):
        has = [x for x, f in zip(all_, free[k], strict=True) if f]
        one = PathModel(s[k], int(n[k]), 3, has)
        assert one.converged == m.converged[k]
        if one.converged:
            assert all(np.isclose(fits[x][k], y, rtol=1e-5, atol=1e-5) for x, y in one.fit_measures().items())
            assert np.allclose(z[k][free[k]], one.z(), rtol=1e-3, atol=1e-3) and one.stable() == stable[k]
            lacks = [x for x, f in zip(all_, free[k], strict=True) if not f]
            assert np.allclose(gains[k][~free[k]], one.modification(lacks), rtol=1e-3, atol=1e-3)
            assert np.allclose(beta[k], one.standardised()[:3], atol=1e-4)


def test_persons_go_side_by_side():
    """A model object for each person and round took 90 CPU seconds for 1,500 persons and more."""
    import inspect

    assert "PathModel(" not in inspect.getsource(pp) and pp.PathModels is PathModels


def test_score_is_the_slope_of_the_loss():
    """Its factors stood in an order that is no derivative, so feedbacks stopped above the least loss."""
    s = np.cov(np.hstack([series(40, 3)[1:], series(40, 3)[:-1]]).T, bias=True)
    paths = [(0, 3), (1, 4), (1, 0), (2, 5), (0, 1)]
    m = PathModel(s, 39, 3, paths)
    both = PathModels(s[None], np.array([39]), 3, paths, np.ones((1, 5), bool))
    assert np.allclose(m._information(paths)[0], 0, atol=1e-4) and np.isclose(both._loss()[0], m._loss(m.a, m.v), atol=1e-8)
    step = 1e-6
    for k, path in enumerate([(2, 0), (0, 4)]):
        a = m.a.copy()
        a[path] += step
        slope = (m._loss(a, m.v) - m._loss(m.a, m.v)) / step
        assert np.isclose(m._information([*paths, (2, 0), (0, 4)])[0][5 + k], -slope / 2, atol=1e-4)
