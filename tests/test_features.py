"""The features of a graph against plain searches and the steps of Spark."""

import math
import random
from collections import deque

import pytest

from lodestone.operators import features, graph, intask


def distances(leads, start):
    found, open_ = {start: 0}, deque([start])
    while open_:
        x = open_.popleft()
        for y in leads.get(x, ()):
            if y not in found:
                found[y] = found[x] + 1
                open_.append(y)
    return found


def edges_of(seed, n=24, m=40):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(i, i + 1) for i in range(n - 1)} | {(5, 5)})


@pytest.mark.parametrize("apart", [False, True], ids=["connected", "apart"])
def test_structure_against_plain_searches(spark, apart):
    """logarithms, undirected eccentricity, closeness by incoming ways, own loops."""
    edges = edges_of(1) + ([(100, 101), (101, 101)] if apart else [])
    nodes = sorted({x for e in edges for x in e})
    leads, back, both = {}, {}, {}
    for a, b in edges:
        leads.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    got = {r["node"]: (r["graph"], r["structural"]) for r in features.structure(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert sorted(got) == nodes
    for x in nodes:
        s = got[x][1]
        hops = len(both[x])
        assert s[0] == pytest.approx(math.log1p(hops)) and s[1] == pytest.approx(math.log1p(min(50, hops * hops)))
        near = distances(back, x)
        sum_, k = sum(near.values()), len(near) - 1
        assert s[5] == pytest.approx(k / sum_ * k / (len(nodes) - 1) if sum_ else 0)
        assert s[4] == pytest.approx(0 if apart else 1 / (1 + max(distances(both, x).values())))
        own = both[x] - {x}
        closed = sum(b in both[a] for a in own for b in own if a < b)
        assert s[3] == closed and s[2] == pytest.approx(2 * closed / (len(own) * (len(own) - 1)) if len(own) > 1 else 0)


def test_ranks_in_a_task_are_those_of_the_steps(spark):
    """the same ranks and hubs, settled, without a step of Spark for each."""
    e = spark.createDataFrame(edges_of(2), "src long, dst long")
    assert intask.fits(e) and not intask.fits(e.union(spark.createDataFrame([(None, 1)], "src long, dst long")))
    got = {r["node"]: (r["rank"], r["hub"]) for r in intask.ranks(e, 12).collect()}
    rank = {r["node"]: r["rank"] for r in graph.pagerank(e, 12).collect()}
    hub = {r["node"]: r["hub"] for r in graph.hits(e, 12).collect()}
    assert got.keys() == rank.keys() == hub.keys()
    for x, (r, h) in got.items():
        assert r == pytest.approx(rank[x], abs=1e-12) and h == pytest.approx(hub[x], abs=1e-12)


def test_nodes_that_are_not_enriched_are_kept(spark):
    s = spark.createDataFrame([(1, [1.0] * 8, [2.0] * 8), (2, [1.0] * 8, [2.0] * 8)], "node long, graph array<double>, structural array<double>")
    e = spark.createDataFrame([(1, [3.0] * 8, [4.0] * 8)], "node long, complexity array<double>, history array<double>")
    got = {r["node"]: r["features"] for r in features.vectors(s, e).collect()}
    assert got[1] == [1.0] * 8 + [3.0] * 8 + [2.0] * 8 + [4.0] * 8 and got[2] == [1.0] * 8 + [0.0] * 8 + [2.0] * 8 + [0.0] * 8
