"""Feature vectors of symbols: graph, complexity, structure and history, eight each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import allpairs, graph, intask, symbolgraph

#: The names of the 32 features, in order.
NAMES = [
    "in_degree", "out_degree", "total_degree", "in_degree_centrality", "out_degree_centrality", "betweenness_centrality", "pagerank_score", "hub_score",
    "cyclomatic_complexity", "cognitive_complexity", "lines_of_code", "parameter_count", "nesting_depth", "function_count", "class_size", "maintainability_index",
    "neighbor_count_1hop", "neighbor_count_2hop", "clustering_coefficient", "triangle_count", "eccentricity", "closeness_centrality", "community_size", "is_leaf_node",
    "churn_rate", "bug_fix_rate", "days_since_change", "contributor_count", "avg_commit_size", "refactor_count", "hotspot_score", "age_days",
]


def capped(c: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), c) / most


def complexity(defaults_from: str = "") -> list[Column]:
    """The eight complexity features from columns cc, cognitive, lines, params, nesting,
    functions, class_size, mi; a missing one counts as its default."""
    c = lambda n, d: F.coalesce(F.col(defaults_from + n).cast("double"), F.lit(float(d)))
    return [capped(c("cc", 1), 100), capped(c("cognitive", 0), 100), F.log1p(c("lines", 0)) / 10, capped(c("params", 0), 10), capped(c("nesting", 1), 10), F.log1p(c("functions", 1)) / 5, capped(c("class_size", 0), 500), (F.lit(100) - c("mi", 50)) / 100]


def history() -> list[Column]:
    """The eight history features from churn, fixes, days, authors, commit_size,
    refactors, hotspot, age; a missing one counts as its default."""
    c = lambda n, d: F.coalesce(F.col(n).cast("double"), F.lit(float(d)))
    return [capped(c("churn", 0), 50), capped(c("fixes", 0), 20), F.lit(1.0) - capped(c("days", 30), 365), capped(c("authors", 1), 20), capped(c("commit_size", 50), 1000), capped(c("refactors", 0), 10), F.least(F.lit(1.0), c("hotspot", 0)), capped(c("age", 0), 1000)]


def enriched(nodes: DataFrame, complexity_rows: DataFrame, history_rows: DataFrame, key: str = "node") -> DataFrame:
    """``nodes`` with ``complexity`` and ``history`` arrays by two left joins."""
    out = nodes.join(complexity_rows, key, "left").join(history_rows, key, "left")
    return out.select(*[F.col(c) for c in nodes.columns], F.array(*complexity()).alias("complexity"), F.array(*history()).alias("history"))


def structure(edges: DataFrame, iterations: int = 100) -> DataFrame:
    """(node, graph, structural): eight features each of the directed graph.  Ranks and hubs
    are settled, or after ``iterations`` steps.  Closeness is by the ways that lead to a
    node, times the share of nodes they come from; eccentricity is of the undirected graph,
    where all of it is connected; a node that leads to itself is its own neighbour.
    Distances are from every node, so the time grows with the square of the nodes; no pairs
    are kept."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    degree = graph.degrees(e)
    nodes = degree.select("node")
    n = degree.count()
    both = written(e.unionAll(e.select("dst", "src")).distinct(), "both")
    near = allpairs.reached(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes).select(F.col("source").alias("node"), "reached", "total")
    far = allpairs.reached(both, nodes).select(F.col("source").alias("node"), F.when(F.col("reached") + 1 == n, F.lit(1.0) / (F.col("eccentricity") + 1)).alias("eccentricity"))
    between = allpairs.betweenness(e, nodes).withColumnRenamed("score", "between")
    ranks = [written(intask.ranks(e, iterations), "ranks")] if intask.fits(e) else [graph.pagerank(e, iterations), graph.hits(e, iterations).drop("authority")]
    hops = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("hops"))
    triangles = written(graph.triangles(e).withColumnRenamed("n", "triangles"), "triangles")
    sides = both.where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("sides"))
    parts = [between, *ranks, hops, sides, triangles, near, far, symbolgraph.communities(e).drop("community")]
    out = degree
    for p in parts:
        out = out.join(p, "node", "left")
    c = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    i, o, k = c("d_in"), c("d_out"), c("sides")
    pairs = float(max((n - 1) * (n - 2), 1))
    closeness = F.coalesce(F.try_divide(c("reached") * c("reached"), c("total") * F.lit(max(n - 1, 1))), F.lit(0.0))
    clustering = F.when(k > 1, c("triangles") * 2 / (k * (k - 1))).otherwise(0.0)
    g = [F.log1p(i), F.log1p(o), F.log1p(i + o), i / max(n - 1, 1), o / max(n - 1, 1), c("between") / pairs, c("rank"), c("hub")]
    s = [F.log1p(c("hops")), F.log1p(F.least(F.lit(50.0), c("hops") * c("hops"))), clustering, c("triangles"), c("eccentricity"), closeness, F.least(F.lit(100.0), F.greatest(F.lit(1.0), c("size"))), F.when((i == 0) & (o > 0), 1.0).otherwise(0.0)]
    return out.select("node", F.array(*g).alias("graph"), F.array(*s).alias("structural"))


def vectors(structured: DataFrame, enriched_: DataFrame) -> DataFrame:
    """(node, features): the 32 features in the order of ``NAMES``; of a node that is not
    enriched the others are 0."""
    none = F.array(*[F.lit(0.0)] * 8)
    rest = [F.coalesce(c, none) for c in ("complexity", "history")]
    return structured.join(enriched_, "node", "left").select("node", F.concat("graph", rest[0], "structural", rest[1]).alias("features"))
