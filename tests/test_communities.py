"""Modularity of communities against the greedy method of merging pairs."""

import itertools
import random

import pytest

from lodestone.operators import symbolgraph


def value(edges, of):
    m = len(edges)
    degree = {}
    for a, b in edges:
        for x in (a, b):
            degree[of[x]] = degree.get(of[x], 0) + 1
    return sum(of[a] == of[b] for a, b in edges) / m - sum(d * d for d in degree.values()) / (4 * m * m)


def greedy(edges):
    """Merges the pair of communities that gains most, as long as one gains."""
    of = {x: x for e in edges for x in e}
    best = value(edges, of)
    while True:
        pairs = {tuple(sorted((of[a], of[b]))) for a, b in edges if of[a] != of[b]}
        tries = [(value(edges, {x: a if c == b else c for x, c in of.items()}), a, b) for a, b in sorted(pairs)]
        top = max(tries, default=(-1, 0, 0))
        if top[0] <= best + 1e-12:
            return best
        best = top[0]
        of = {x: top[1] if c == top[2] else c for x, c in of.items()}


def rings():
    """Cliques of five in a ring."""
    out = [(5 * k + i, 5 * k + j) for k in range(8) for i, j in itertools.combinations(range(5), 2)]
    return out + [(5 * k, 5 * ((k + 1) % 8) + 1) for k in range(8)]


def planted(seed, n=45, groups=3):
    rng = random.Random(seed)
    return [(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < (0.5 if i % groups == j % groups else 0.04)]


def tree(seed=4):
    rng = random.Random(seed)
    return [(rng.randrange(i), i) for i in range(1, 40)]


@pytest.mark.parametrize("edges", [rings(), planted(1), tree()], ids=["rings", "planted", "tree"])
def test_modularity_is_not_below_the_greedy_method(spark, edges):
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["community"] for r in symbolgraph.communities(e).collect()}
    assert got.keys() == {x for e in edges for x in e} and all(c == min(x for x in got if got[x] == c) for c in got.values())
    assert value(edges, got) >= greedy(edges) - 1e-9
    again = {r["node"]: r["community"] for r in symbolgraph.communities(e.repartition(3).selectExpr("dst as src", "src as dst")).collect()}
    assert again == got


def test_communities_of_nothing(spark):
    assert symbolgraph.communities(spark.createDataFrame([(1, 1)], "src long, dst long")).collect() == []


def test_no_move_is_left_where_communities_meet_in_cells(spark, monkeypatch):
    """a graph of more edges than a task holds; no merge of two communities gains."""
    edges = planted(1)
    monkeypatch.setattr(symbolgraph.intask, "EDGES", -(-len(edges) // 3))
    got = {r["node"]: r["community"] for r in symbolgraph.communities(spark.createDataFrame(edges, "src long, dst long")).collect()}
    best = value(edges, got)
    assert best >= 0.95 * greedy(edges)
    for c, k in itertools.combinations(sorted(set(got.values())), 2):
        assert value(edges, {x: c if of == k else of for x, of in got.items()}) <= best + 1e-9


def test_each_two_groups_meet_once_in_a_cycle():
    for groups in (2, 4, 10):
        cells = [symbolgraph._cells(groups, t) for t in range(groups - 1)]
        for a, b in itertools.combinations(range(groups), 2):
            assert sum(c[a] == c[b] for c in cells) == 1
        assert all(c.count(x) == 2 for c in cells for x in c)


def test_communities_of_more_than_a_hundred(spark):
    """the size of a community is its whole size."""
    star = spark.createDataFrame([(0, i) for i in range(1, 151)], "src long, dst long")
    assert {(r["community"], r["size"]) for r in symbolgraph.communities(star).collect()} == {(0, 151)}
