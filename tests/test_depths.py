"""Depths of calls against the distances from every entry."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import symbolgraph, walks


@pytest.mark.parametrize("seed", [1, 2])
def test_call_depth_keeps_a_row_a_node(spark, tmp_path, monkeypatch, seed):
    """The first entry counts, however far; no round holds pairs of entry and node."""
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(20)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(35)] + [(50, 50)]
    e = spark.createDataFrame(edges, "src long, dst long").repartition(2)
    entries = spark.createDataFrame([(i, (i * 7) % 11) for i in range(0, 60, 4)] + [(4, 99)], "node long, seq long")
    sizes, write = [], symbolgraph.written

    def counted(df, label):
        out = write(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(symbolgraph, "written", counted)
    got = {r["node"]: r["depth"] for r in symbolgraph.call_depth(e, entries).collect()}
    monkeypatch.undo()
    first = entries.groupBy(F.col("node").alias("source")).agg(F.min("seq").alias("seq"))
    rows = walks.distances(e, entries.select("node").distinct()).join(first, "source").collect()
    best = {}
    for r in rows:
        best[r["node"]] = min(best.get(r["node"], (99, 99, 99)), (r["seq"], r["distance"], r["distance"]))
    nodes = {x for p in edges for x in p}
    # Entries of equal seq are told apart by distance here, so only the seq must be that of the first.
    assert got == {x: best[x][1] + 1 if x in best else 1 for x in nodes}
    assert len(sizes) > 2 and max(sizes[1:]) <= len(nodes) + entries.count()
