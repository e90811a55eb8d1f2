"""Growth of contexts and their network against a plain recursion, and known cases."""

import collections
import math
import random

import pytest

from eventloom.operators import context_tree as ct
from eventloom.operators import higher_order as ho


def plain_rules(trails, max_order, min_freq):
    counts = collections.defaultdict(collections.Counter)
    for t in trails:
        for k in range(1, max_order + 1):
            for i in range(len(t) - k):
                counts[tuple(t[i : i + k])][t[i + k]] += 1
    counts = {c: {s: n for s, n in x.items() if n >= min_freq} for c, x in counts.items()}
    share = {c: {s: n / sum(x.values()) for s, n in x.items()} for c, x in counts.items() if x}
    bound = lambda order, c: order / math.log2(1 + sum(counts[c].values()))
    gap = lambda a, b: sum(p * math.log2(p / b[s]) if s in b else math.inf for s, p in a.items())
    kept = set()

    def end(c):
        kept.update(c[:i] for i in range(1, len(c) + 1) if c[:i] in share)

    def grow(valid, now, order):
        if order >= max_order:
            return end(valid)
        least = min(share[now].values())
        if max(gap({s: 1.0}, share[valid]) for s, p in share[now].items() if p == least) < bound(order + 1, now):
            return end(valid)
        more = [c for c in share if len(c) == order + 1 and c[1:] == now]
        if not more:
            end(valid)
        for c in more:
            grow(c if gap(share[c], share[valid]) > bound(order + 1, c) else valid, c, order + 1)

    for c in [c for c in share if len(c) == 1]:
        end(c)
        grow(c, c, 1)
    return {(c, s): (n, share[c][s]) for c in kept for s, n in counts[c].items()}


def plain_network(rules):
    """Edges redirected one by one, shorter contexts first, then tails."""
    graph = collections.defaultdict(dict)
    for c, s in sorted(rules, key=lambda x: (len(x[0]), x)):
        graph[c][(s,)] = rules[c, s]
        before, last = c[:-1], c[-1:]
        if before and c not in graph.get(before, {}) and last in graph.get(before, {}):
            graph[before][c] = graph[before].pop(last)
    moved = []
    for c, to in graph.items():
        for t in to:
            path = (*c, *t)
            longer = next((path[i:] for i in range(len(path) - 1) if path[i:] in graph), None) if len(t) == 1 else None
            moved += [(c, t, longer)] if longer else []
    for c, t, longer in moved:
        graph[c][longer] = graph[c].pop(t)
    return {(c, t): x for c, to in graph.items() for t, x in to.items()}


def frame(spark, trails):
    return spark.createDataFrame([(list(t),) for t in trails], "states array<string>")


def sequences(seed, n=60, length=25, memory=3):
    """Sequences whose next state depends on the states up to three back, with some noise."""
    r = random.Random(seed)
    table = {}
    out = []
    for _ in range(n):
        s = [r.choice("ABC") for _ in range(memory)]
        while len(s) < r.randint(2, length):
            key = tuple(s[-memory:]) if s[-1] == "A" else tuple(s[-1:])
            s.append(table.setdefault(key, r.choice("ABC")) if r.random() < 0.85 else r.choice("ABCD"))
        out.append(s)
    return out


@pytest.mark.parametrize(("seed", "max_order", "min_freq"), [(1, 4, 1), (2, 3, 3), (3, 5, 2), (4, 1, 1)])
def test_rules_and_network_equal_a_plain_recursion(spark, seed, max_order, min_freq):
    trails = sequences(seed)
    want = plain_rules(trails, max_order, min_freq)
    found = ct.rules(frame(spark, trails), max_order, min_freq)
    got = {(tuple(r.context), r.next): (r["count"], r.probability) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert max_order == 1 or max(len(c) for c, _ in want) > 1
    edges = {(tuple(r["from"]), tuple(r["to"])): (r["count"], r.probability) for r in ct.network(found).collect()}
    wired = plain_network(want)
    assert edges.keys() == wired.keys() and all(edges[k] == pytest.approx(wired[k]) for k in wired)


def test_known_cases(spark):
    trails = ["ABCDABC", "BABCDAB", "CABCDAB", "ABCDABC", "DABC"]
    found = {(tuple(r.context), r.next): r["count"] for r in ct.rules(frame(spark, trails), 3).collect()}
    assert found[("C",), "D"] == 4 and {len(c) for c, _ in found} == {1}  # a first-order cycle
    memory = ["ABCX"] * 50 + ["DBCY"] * 50  # what follows B C depends on what came before
    found = ct.rules(frame(spark, memory), 4)
    kept = {tuple(r.context) for r in found.collect()}
    assert {("A", "B", "C"), ("A", "B"), ("D", "B", "C"), ("D", "B")} <= kept
    to = {(tuple(r["from"]), tuple(r["to"])) for r in ct.network(found).collect()}
    assert (("A", "B"), ("A", "B", "C")) in to and (("A",), ("A", "B")) in to and (("A", "B", "C"), ("X",)) in to
    paths = {r.path for r in ct.pathways(found, order=3).collect()}
    assert paths == {"A B C -> X", "D B C -> Y"}


def test_nothing_and_what_is_refused(spark):
    empty = frame(spark, [])
    assert ct.rules(empty, 3).count() == ct.network(ct.rules(empty, 3)).count() == 0
    assert ct.rules(frame(spark, ["A"]), 3).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        ct.rules(empty, 0)
    rows = ho.trails(spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, None)], "seq int, pos int, state string"), ["seq"])
    assert [(r.context, r.next) for r in ct.rules(rows, 2).collect()] == [(["A"], "B")]
