"""Walks on edge tables: distances, shortest and simple paths.

Distances and shortest paths start from a stated set of few sources, one join a step, so
that a step's rows are bounded by sources x nodes and nothing is gathered on the driver;
from all nodes they are in ``allpairs``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import allpairs


def distances(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, node, distance, ways): the nodes that a source reaches (within
    ``depth`` edges, where given) and the number of shortest ways there; the source
    itself at 0.  ``sources`` has (node).  A level is written before the next starts,
    and the search ends with the first that finds nothing new."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    level = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("distance"), F.lit(1).cast("long").alias("ways")), "level")
    found, k = level, 0
    while depth is None or k < depth:
        k += 1
        step = level.join(e, level["node"] == e["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        new = step.join(found.select("source", "node"), ["source", "node"], "left_anti")
        level = written(new.select("source", "node", F.lit(k).alias("distance"), "ways"), "level")
        if level.isEmpty():
            break
        found = found.unionAll(level)
    return found


def simple_paths(edges: DataFrame, longest: int = 4) -> DataFrame:
    """(path) of 1 to ``longest`` edges without a repeated node."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    step = e.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    grown = e.select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = [grown]
    for _ in range(1, longest):
        grown = grown.join(step, "at").where("not array_contains(path, next)").select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at"))
        found.append(grown)
    return reduce(DataFrame.unionAll, found).select("path")


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean degree of the distinct edges."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("nodes"))
    out = ends.crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    n, m = F.col("nodes"), F.col("edges")
    return out.select("nodes", "edges", F.round(F.coalesce(F.try_divide(m, n * (n - 1)), F.lit(0.0)), 4).alias("density"), F.round(F.coalesce(F.try_divide(m, n), F.lit(0.0)), 4).alias("degree"))


def shortest_paths(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, node, path): a shortest path to each node that a source reaches, the
    least of equal ones; levels as in ``distances``."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    level = written(sources.select(F.col("node").alias("source"), "node", F.array("node").alias("path")), "paths")
    found, k = level, 0
    while depth is None or k < depth:
        k += 1
        step = level.join(e, level["node"] == e["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        new = step.join(found.select("source", "node"), ["source", "node"], "left_anti")
        level = written(new.select("source", "node", F.concat("path", F.array("node")).alias("path")), "paths")
        if level.isEmpty():
            return found
        found = found.unionAll(level)
    return found


def guided_paths(edges: DataFrame, pairs: DataFrame, depth: int = 20, most: int = 50) -> DataFrame:
    """(source, target, length, path): the simple paths of at most ``depth`` edges of each
    pair (source, target), the shortest first and the least of equal ones, at most
    ``most`` a pair (a report's limit): a search of each pair, guided by the distances to
    its target.  The pairs are dealt over the tasks, the edges sent to each."""
    return allpairs.paths(edges, pairs, depth, most)
