"""Moderated networks: planted moderation, and sums of products."""

import numpy as np
import pytest

from eventloom.operators import moderated as md

COLUMNS = ["a", "b", "c", "m"]


def frame(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in COLUMNS))


def planted(n, seed, binary=False):
    """a goes with b as the moderator says; c goes with b whatever it is."""
    r = np.random.default_rng(seed)
    m = r.integers(0, 2, n).astype(float) if binary else r.standard_normal(n)
    b = r.standard_normal(n)
    a = (0.8 * m if not binary else 1.6 * m) * b + 0.6 * r.standard_normal(n)
    c = 0.7 * b + 0.7 * r.standard_normal(n)
    return np.column_stack([a, b, c, m])


def test_sums_of_products(spark):
    x = planted(300, 1)
    terms = [(0,), (1,), (3,), (0, 3), (1, 3)]
    u = np.column_stack([np.ones(300), x[:, 0], x[:, 1], x[:, 3], x[:, 0] * x[:, 3], x[:, 1] * x[:, 3]])
    got = md.product_moments(frame(spark, x).repartition(5), COLUMNS, np.zeros(4), np.ones(4), terms)
    assert np.allclose(got, u.T @ u)


def test_a_planted_moderation_is_found(spark):
    model = md.fit(frame(spark, planted(4000, 2)), COLUMNS, "m")
    low, mid, high = (md.conditioned(model, v) for v in (-1.5, 0.0, 1.5))
    a, b, c = 0, 1, 2
    assert low[a, b] > 0.3 and high[a, b] > 0.3 and mid[a, b] < 0.1  # the sign of the moderator is that of the edge
    assert min(w[b, c] for w in (low, mid, high)) > 0.3
    assert max(w[a, c] for w in (low, mid, high)) < 0.1 and not mid[:, 3].any()
    edges = {(r.moderator, r["from"], r["to"]): r.weight for r in md.networks(spark, model, [0.0, 1.5]).collect()}
    assert edges[1.5, "a", "b"] == high[a, b] and edges.get((0.0, "a", "b"), 0.0) == mid[a, b]


def test_conditioned_networks_equal_separate_fits(spark):
    """A 0/1 moderator: the network at each value is about that of the rows that have it."""
    x = np.round(planted(6000, 3, binary=True), 1)
    model = md.fit(frame(spark, x), COLUMNS, "m", ["g", "g", "g", "c"], rule="OR", threshold=False)
    for value in (0.0, 1.0):
        part = x[x[:, 3] == value][:, :3]
        z = (part - x[:, :3].mean(0)) / x[:, :3].std(0, ddof=1)
        want = np.zeros((3, 3))
        for v in range(3):
            rest = [i for i in range(3) if i != v]
            want[v, rest] = np.abs(np.linalg.lstsq(np.column_stack([np.ones(len(z)), z[:, rest]]), z[:, v], rcond=None)[0][1:])
        want = (want + want.T) / 2
        got = md.conditioned(model, value, "OR")[:3, :3]
        assert np.allclose(got, want, atol=0.1)
    strict = md.fit(frame(spark, x), COLUMNS, "m", ["g", "g", "g", "c"])  # all three sides have to agree
    assert md.conditioned(strict, 1.0)[0, 1] > 0.4 > 0.1 > md.conditioned(strict, 0.0)[0, 1]


def test_rows_with_gaps_and_too_few(spark):
    x = planted(500, 4)
    x[::50, 1] = np.nan
    whole, some = md.fit(frame(spark, x), COLUMNS, "m"), md.fit(frame(spark, x[~np.isnan(x).any(1)]), COLUMNS, "m")
    assert np.allclose(md.conditioned(whole, 1.0), md.conditioned(some, 1.0))
    with pytest.raises(ValueError, match="two complete rows"):
        md.fit(frame(spark, x[:0]), COLUMNS, "m")
    with pytest.raises(ValueError, match="combinations"):
        md.MOST_COMBINATIONS, old = 100, md.MOST_COMBINATIONS
        try:
            md.fit(frame(spark, planted(300, 5, binary=True)), COLUMNS, "m", ["g", "g", "g", "c"])
        finally:
            md.MOST_COMBINATIONS = old
