"""Graphs of few edges, whole in a task: steps that follow each other cost a shuffle or
more on Spark, whatever the size.  A graph of more than ``EDGES`` edges takes the steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = 1 << 20  # edges that a task holds: some 300 MB while they are lists


def fits(edges: DataFrame) -> bool:
    """Few edges (src, dst), none of them with a null end."""
    n = edges.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("no")).first()
    return n["n"] <= EDGES and not n["no"]


def _numbered(*ends: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The names in their order and the places of each column's values among them."""
    names = pc.unique(pa.chunked_array([c for e in ends for c in e.chunks], ends[0].type))
    names = names.take(pc.array_sort_indices(names))
    return names, [pc.index_in(e, names).combine_chunks().to_numpy().astype(np.int64) for e in ends]


def ranks(edges: DataFrame, iterations: int) -> DataFrame:
    """(node, rank, hub) of distinct edges, as ``graph.pagerank`` and ``graph.hits`` give
    them: the same steps and the same ends."""

    def settle(t: pa.Table) -> pa.Table:
        names, (a, b) = _numbered(t["src"], t["dst"])
        n = len(names)
        k = np.bincount(a, minlength=n)
        rank, hub = np.full(n, 1.0 / n), np.ones(n)
        for _ in range(iterations):
            new = 0.15 / n + 0.85 * (np.bincount(b, rank[a] / k[a], n) + rank[k == 0].sum() / n)
            rank, moved = new, np.abs(new - rank).sum()
            if moved < n * 1e-6:
                break
        for _ in range(iterations):
            authority = np.bincount(b, hub[a], n)
            new = np.bincount(a, (authority / authority.sum())[b], n)
            hub, moved = new / new.sum(), np.abs(new / new.sum() - hub).sum()
            if moved < 1e-8:
                break
        return pa.table({"node": names, "rank": rank, "hub": hub})

    schema = T.StructType([T.StructField("node", edges.schema["src"].dataType), *T.StructType.fromDDL("rank double, hub double").fields])
    return edges.select("src", "dst", F.lit(0).alias("all")).groupBy("all").applyInArrow(lambda t: settle(t.select(["src", "dst"])), schema)


def settled(a: np.ndarray, b: np.ndarray, weight: np.ndarray, degree: np.ndarray, of: np.ndarray, m: float) -> np.ndarray:
    """The communities ``of`` of nodes 0, 1, ... after moves to the neighbouring community
    with the largest gain in modularity, a node at a time in their order, until no move
    gains.  The name of a community is a node's place; of equal gains the smaller one wins."""
    far, own, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    between = far != own
    order = np.lexsort((far[between], own[between]))
    far, w, own = far[between][order].tolist(), w[between][order].tolist(), own[between][order]
    starts = np.searchsorted(own, np.arange(len(degree) + 1)).tolist()
    total = np.bincount(of, degree, len(degree)).tolist()
    of, degree = of.tolist(), degree.tolist()
    nodes = [i for i in range(len(degree)) if starts[i] < starts[i + 1]]
    while True:
        moved = False
        for i in nodes:
            here, d = of[i], degree[i] / (2.0 * m)
            links: dict[int, float] = {here: 0.0}
            for j in range(starts[i], starts[i + 1]):
                c = of[far[j]]
                links[c] = links.get(c, 0.0) + w[j]
            total[here] -= degree[i]
            best, most = here, links[here] - total[here] * d
            bound = most + 1e-9  # of moves that gain nothing none is made
            for c, x in links.items():
                gain = x - total[c] * d
                if gain > bound and (gain > most + 1e-9 or (gain > most - 1e-9 and best != here and c < best)):
                    best, most = c, gain
            total[best] += degree[i]
            if best != here:
                of[i], moved = best, True
        if not moved:
            return np.array(of, np.int64)


def communities(edges: DataFrame, m: float) -> DataFrame:
    """(node, community) of undirected edges (src, dst, weight; a node's edge to itself is
    the weight inside it): moves, then each community is a node, until no move is left."""

    def levels(t: pa.Table) -> pa.Table:
        names, (a, b) = _numbered(t["src"], t["dst"])
        w = t["weight"].to_numpy()
        found = np.arange(len(names))
        while True:
            n = int(max(found)) + 1
            degree = np.bincount(a, w, n) + np.bincount(b, w, n)
            of = settled(a, b, w, degree, np.arange(n), m)
            kept, of = np.unique(of, return_inverse=True)
            found = of[found]
            if len(kept) == n:
                break
            pairs, place = np.unique(np.stack([np.minimum(of[a], of[b]), np.maximum(of[a], of[b])]), axis=1, return_inverse=True)
            (a, b), w = pairs, np.bincount(place.reshape(-1), w)
        first = np.zeros(n, np.int64)
        first[found[::-1]] = np.arange(len(names))[::-1]  # the smallest node
        return pa.table({"node": names, "community": names.take(pa.array(first[found]))})

    node = edges.schema["src"].dataType
    schema = T.StructType([T.StructField("node", node), T.StructField("community", node)])
    return edges.select("src", "dst", "weight", F.lit(0).alias("all")).groupBy("all").applyInArrow(lambda t: levels(t.select(["src", "dst", "weight"])), schema)


def moves(nodes: DataFrame, edges: DataFrame, m: float) -> DataFrame:
    """(node, community, moved): the nodes (cell, node, community, degree) of each cell moved
    among its communities by its edges (cell, src, dst, weight).  All nodes of a community
    are in its cell, so the gains of moves in different cells add up."""

    def each(t: pa.Table, e: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"node": pa.array([], out.field(0).type), "community": pa.array([], out.field(0).type), "moved": pa.array([], pa.bool_())})
        t = t.sort_by("node")
        names, node = t["community"].unique(), t["node"].combine_chunks()
        names = names.take(pc.array_sort_indices(names))
        of = pc.index_in(t["community"], names).combine_chunks().to_numpy().astype(np.int64)
        if e.num_rows:
            a, b = (pc.index_in(e[c], node).combine_chunks().to_numpy().astype(np.int64) for c in ("src", "dst"))
            new = settled(a, b, e["weight"].to_numpy(), t["degree"].to_numpy(), of, m)
        else:
            new = of
        return pa.table({"node": node, "community": names.take(pa.array(new)), "moved": pa.array(new != of)})

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = nodes.schema["node"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("community", kind), T.StructField("moved", T.BooleanType())])
    out = to_arrow_schema(schema)
    return nodes.groupBy("cell").cogroup(edges.groupBy("cell")).applyInArrow(each, schema)
