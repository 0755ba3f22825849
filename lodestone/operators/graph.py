"""Graphs as edge tables: degrees, triangles, reachability, PageRank, diffs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt, written


PART = 500_000  # edges that a task of ``degrees`` holds


def degrees(edges: DataFrame) -> DataFrame:
    """(node, d_in, d_out) of distinct edges (src, dst): dealt over as many tasks as they
    need, then one shuffle by node."""
    rows = edges.select("src", "dst")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART))
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    ends = rows.repartition(tasks, "src", "dst").distinct().select(ends.alias("end")).select("end.*")
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("d_in"), F.sum("o").cast("long").alias("d_out"))


CELL = 24_000_000  # edges that a task of ``triangles`` holds


def _closed(lists: pa.Table, edges: pa.Table) -> pa.Table:
    """(id, n) of the triangles a, b, c where a leads to b and c by ``lists`` (part, id, far:
    all that a leads to), and b to c by ``edges`` (id, far: the b of one part)."""
    if not lists.num_rows or not edges.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    own = edges["far"].combine_chunks()
    length = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
    b, c = np.repeat(edges["id"].to_numpy(), length), own.flatten().to_numpy(zero_copy_only=False)
    from_, to = np.unique(b), np.unique(c)
    known = np.sort(np.searchsorted(from_, b) * len(to) + np.searchsorted(to, c))
    # A mark for each edge at a place of its hash: most wedges end at a place without one.
    bits = np.uint64(64 - max(10, (8 * len(known)).bit_length()))
    place = lambda key: (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> bits
    marks = np.zeros(1 << (64 - int(bits)), bool)
    marks[place(known)] = True
    found = [np.zeros(0, np.int64)]
    rows = lists["far"].combine_chunks()
    k = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    far, a = rows.flatten().to_numpy(zero_copy_only=False), np.repeat(lists["id"].to_numpy(), k)
    # The places of a node of ``far`` among those of the edges, and the end of its list.
    i, j = np.searchsorted(from_, far), np.searchsorted(to, far)
    leads = (from_[np.minimum(i, len(from_) - 1)] == far) & (i < len(from_))
    led = (to[np.minimum(j, len(to) - 1)] == far) & (j < len(to))
    start, width = np.repeat(np.cumsum(k) - k, k), np.repeat(k, k)
    middle = np.flatnonzero(leads)
    ends = np.cumsum(width[middle])
    for lo in range(0, int(ends[-1]) if len(ends) else 0, 1 << 21):  # bounds the wedges
        at = middle[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, lo + (1 << 21), side="right")]
        w = width[at]
        one = np.repeat(at, w)
        other = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(start[at], w)
        both = np.flatnonzero(led[other])
        one, other = one[both], other[both]
        key = i[one] * len(to) + j[other]
        likely = np.flatnonzero(marks[place(key)])
        one, other, key = one[likely], other[likely], key[likely]
        p = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[p] == key
        found += [a[one[hit]], far[one[hit]], far[other[hit]]]
    ids, n = np.unique(np.concatenate(found), return_counts=True)
    return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})


def _counted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, d, id) of the nodes of the undirected graph with their degrees, and (id, n) of
    those in triangles.  Each edge points to its end of higher degree, which bounds the
    wedges of a hub.  The distinct edges are written: they are needed more than once.

    No wedge is shuffled: nodes are dealt in parts, a task has the lists of one part of
    the nodes and the edges from one part of those they lead to, some ``CELL`` edges in
    all, so a list goes to no more tasks than there are parts."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    e = written(e, "edges")
    d = e.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    nodes = written(d.withColumn("id", F.monotonically_increasing_id()), "nodes")
    e = e.join(nodes.select(F.col("x").alias("u"), F.struct("d", "id").alias("du")), "u").join(nodes.select(F.col("x").alias("v"), F.struct("d", "id").alias("dv")), "v")
    o = e.select(F.least("du", "dv")["id"].alias("id"), F.greatest("du", "dv")["id"].alias("b"))
    lists = written(o.groupBy("id").agg(F.collect_list("b").alias("far")), "lists")  # sqrt(2 edges) at most
    total = lists.agg(F.coalesce(F.sum(F.size("far")), F.lit(0))).first()[0]
    parts = max(-(-2 * total // CELL), math.isqrt(2 * edges.sparkSession.sparkContext.defaultParallelism))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    ways = F.array_distinct(F.transform("far", part))
    left = lists.withColumn("to", F.explode(ways)).select((part(F.col("id")) * parts + F.col("to")).alias("cell"), "id", "far")
    right = lists.withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select((F.col("from") * parts + part(F.col("id"))).alias("cell"), "id", "far")
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_closed, "id long, n long")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    return nodes, counts


def triangles(edges: DataFrame) -> DataFrame:
    """(node, n): triangles of the undirected graph per node."""
    nodes, counts = _counted(edges)
    return counts.join(nodes, "id").select(F.col("x").alias("node"), "n")


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, clustering): the share of the pairs of neighbours that are
    neighbours themselves, in the undirected graph; 0 below two."""
    nodes, counts = _counted(edges)
    k = F.col("degree")
    share = F.when(k > 1, F.coalesce("n", F.lit(0)) * 2 / (k * (k - 1))).otherwise(0.0)
    found = nodes.select(F.col("x").alias("node"), F.col("d").alias("degree"), "id").join(counts, "id", "left")
    return found.select("node", "degree", F.round(share, 4).alias("clustering"))


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst) pairs of the transitive closure: only the pairs that are new in a
    round meet the edges in the next, until there are none.  Each round is written."""
    seen = written(edges.select("src", "dst").distinct(), "reach")
    step = seen.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    new = seen
    while True:
        found = new.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        new = written(found.join(seen, ["src", "dst"], "left_anti"), "reach")
        if new.isEmpty():
            return seen
        seen = seen.unionAll(new)


def pagerank(edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): until the ranks change by less than ``tolerance`` a node in all, or
    ``iterations`` steps; the weight of nodes without exits is dealt over all.

    The edges stay where the first step puts them, by their source; a step moves ranks and
    the sums of a task for its nodes, and is written, with the number of exits in each
    node's row."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    nodes = written(nodes.join(out, nodes["node"] == out["src"], "left").select("node", F.coalesce("k", F.lit(0)).alias("k")), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    kept = dealt(e, "src").persist(StorageLevel.MEMORY_AND_DISK)
    rank = nodes.select("node", "k", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        lost = rank.where("k = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sums = kept.join(rank.hint("shuffle_hash"), rank["node"] == kept["src"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        new = nodes.join(sums, nodes["node"] == sums["dst"], "left").select("node", "k", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))).alias("rank"))
        new = written(new, "ranks")
        if tolerance and new.join(rank.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tolerance:
            rank = new
            break
        rank = new
    kept.unpersist()
    return rank.select("node", "rank")


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with added, removed or kept: one full outer join on the keys."""
    a, b = before.select(*keys).distinct().withColumn("__a", F.lit(1)), after.select(*keys).distinct().withColumn("__b", F.lit(1))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("kept")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def group_dependencies(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst) distinct pairs of groups that edges lead between, from
    ``groups`` (node, group); a group may depend on itself."""
    e = edges.select("src", "dst").distinct()
    a, b = groups.toDF("src", "src_group"), groups.toDF("dst", "dst_group")
    return e.join(a, "src").join(b, "dst").select(F.col("src_group").alias("src"), F.col("dst_group").alias("dst")).distinct()


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """(path, length): simple cycles of at most ``longest`` nodes, each once,
    from its smallest node.  The number of joins is fixed by ``longest``."""
    e = edges.select("src", "dst").distinct()
    step = e.select(F.col("src").alias("__at"), F.col("dst").alias("__next"))
    paths, out = e.where("src <= dst").select("src", F.array("src").alias("path"), F.col("dst").alias("next")), None
    for n in range(1, longest + 1):
        closed = paths.where("next = src").select("path", F.lit(n).alias("length"))
        out = closed if out is None else out.unionAll(closed)
        if n < longest:
            grown = paths.where("next > src and not array_contains(path, next)").select("src", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("__at"))
            paths = grown.join(step, "__at").select("src", "path", F.col("__next").alias("next"))
    return out


SEGMENT = 1 << 22  # nodes of a segment, at most
BLOCK = 1 << 23  # edges in a row of a block, about


def _numbered(e: DataFrame) -> tuple[DataFrame, list[int]]:
    """(node, seg, at): nodes of the edges numbered from 0 in segments (by hash), and the
    sizes of the segments.  As many segments as give each core two blocks."""
    nodes = written(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    n, spark = nodes.count(), e.sparkSession
    g = max(math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)), -(-n // SEGMENT))
    shards = g * max(1, -(-n // (g << 17)))  # a segment is numbered by many tasks
    place = F.row_number().over(Window.partitionBy("shard").orderBy("node")) - 1
    nodes = written(nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).withColumn("at", place), "nodes")
    sizes, base = [0] * g, []
    for shard, k in sorted(tuple(r) for r in nodes.groupBy("shard").count().collect()):  # a row for 2^17 nodes
        base.append((shard, shard % g, sizes[shard % g]))
        sizes[shard % g] += k
    known = F.broadcast(spark.createDataFrame(base, "shard int, seg int, base int"))
    return written(nodes.join(known, "shard").select("node", "seg", (F.col("at") + F.col("base")).alias("at")), "nodes"), sizes


def _blocks(e: DataFrame, nodes: DataFrame, g: int) -> DataFrame:
    """(a, b, edges): of the edges from segment a to segment b the places of both ends
    (32 bits each), in rows of some ``BLOCK`` edges; all rows of a block in one task."""
    src, dst = nodes.toDF("node", "a", "i").hint("merge"), nodes.toDF("node", "b", "j").hint("merge")
    placed = e.join(src, e["src"].eqNullSafe(src["node"])).drop("node", "src").join(dst, F.col("dst").eqNullSafe(dst["node"])).select("a", "b", "i", "j")
    rows = -(-e.count() // (BLOCK * g * g))

    def pack(batches):
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId() % rows, [], 0

        def flush():
            a, b, ends = (np.concatenate(x) for x in zip(*held, strict=True))
            key = a * g + b
            order = np.argsort(key, kind="stable")
            key, ends = key[order], ends[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            own = [ends[x:y].tobytes() for x, y in zip(first, [*first[1:], len(key)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(key[first] // g, pa.int32()), pa.array(key[first] % g, pa.int32()), pa.array([part] * len(own), pa.int32()), pa.array(own, pa.binary())], names=["a", "b", "c", "edges"])

        for batch in batches:
            a, b, i, j = (batch.column(k).to_numpy() for k in range(4))
            held.append((a, b, np.stack([i, j], 1).astype("<i4")))
            size += len(a)
            if size >= BLOCK // 2:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    packed = placed.mapInArrow(pack, "a int, b int, c int, edges binary")
    return packed.repartition(2 * g * g, "a", "b").groupBy("a", "b", "c").agg(F.collect_list("edges").alias("edges"))


def _received(blocks: DataFrame, x: DataFrame, scale: float, sizes: list[int], back: bool, silent: tuple | None) -> DataFrame:
    """(seg, x, total): the sums of ``x`` (divided by ``scale``; null: ones) over the edges,
    received at their ends, or with ``back`` at their starts.  A segment of ``x`` goes to the
    blocks that start in it, whose sums go to the segments they end in; the edges stay.
    ``silent`` (seg, at): a node that sends nothing; then a sum of zeros is told from none."""
    g, own, other = len(sizes), "b" if back else "a", "a" if back else "b"
    spread = x.select(F.col("seg").alias(own), "x", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias(other))
    rows = blocks.join(spread.hint("shuffle_hash"), ["a", "b"]).select(own, other, "x", "edges")

    def multiply(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                seg, to, raw, edges = (batch.column(c)[k] for c in range(4))
                seg, to = seg.as_py(), to.as_py()
                x = np.frombuffer(raw.as_buffer(), "<f8") / scale if raw.is_valid else np.ones(sizes[seg])
                ends = np.concatenate([np.frombuffer(v.as_buffer(), "<i4").reshape(-1, 2) for v in edges.values])
                i, j = (ends[:, 1], ends[:, 0]) if back else (ends[:, 0], ends[:, 1])
                if silent and silent[0] == seg:
                    x = x.copy()
                    x[silent[1]] = 0
                y = np.bincount(j, x[i], sizes[to])
                if silent:
                    y[(y == 0) & (np.bincount(j, x[i] > 0, sizes[to]) > 0)] = 5e-324
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([y.astype("<f8").tobytes()], pa.binary())], names=["seg", "x"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                y = np.frombuffer(raw.as_buffer(), "<f8")
                sums[seg] = sums[seg] + y if seg in sums else y
        for seg, y in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([y.tobytes()], pa.binary()), pa.array([y.sum()])], names=["seg", "x", "total"])

    parts = rows.mapInArrow(multiply, "seg int, x binary")
    return written(parts.repartition(g, "seg").mapInArrow(add, "seg int, x binary, total double"), "sums")


def _moved(new: DataFrame, old: DataFrame, scales: tuple[float, float], silent: tuple | None) -> float | None:
    """The sum of the differences of two vectors, each divided by its scale; of no node, null."""

    def differ(batches):
        for batch in batches:
            for seg, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x = np.frombuffer(a.as_buffer(), "<f8") / scales[0]
                there = x > 0
                if silent and silent[0] == seg:
                    there[silent[1]] = False
                y = np.frombuffer(b.as_buffer(), "<f8") / scales[1] if b.is_valid else 1.0
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(x - y)[there].sum()) if there.any() else None], pa.float64())], names=["d"])

    both = new.select("seg", "x").join(old.select("seg", F.col("x").alias("y")).hint("shuffle_hash"), "seg")
    return both.select("seg", "x", "y").mapInArrow(differ, "d double").agg(F.sum("d")).first()[0]


def hits(edges: DataFrame, iterations: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """(node, hub, authority), each scaled to sum 1, until the hubs change by less than
    ``tolerance`` in all, or ``iterations`` steps (one at least), each written.  Nodes
    without exits (or entries) have 0.

    Edges are kept in blocks by the segments of both ends; a step moves a number for each
    node as often as there are segments, and no row for an edge."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    nodes, sizes = _numbered(e)
    null = nodes.where("node is null").first()
    silent = (null["seg"], null["at"]) if null else None
    blocks = _blocks(e, nodes, len(sizes)).persist(StorageLevel.MEMORY_AND_DISK)
    hub = e.sparkSession.range(len(sizes)).select(F.col("id").cast("int").alias("seg"), F.lit(None).cast("binary").alias("x"))
    hubs = 1.0
    for _ in range(max(1, iterations)):
        authority = _received(blocks, hub, hubs, sizes, False, silent)
        authorities = authority.agg(F.sum("total")).first()[0] or 1.0
        new = _received(blocks, authority, authorities, sizes, True, silent)
        scale = new.agg(F.sum("total")).first()[0] or 1.0
        moved = _moved(new, hub, (scale, hubs), silent) if tolerance else None
        hub, hubs = new, scale
        if moved is not None and moved < tolerance:
            break
    blocks.unpersist()

    def values(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                seg = batch.column(0)[k].as_py()
                x, y = (np.frombuffer(v.as_buffer(), "<f8") if v.is_valid else np.zeros(sizes[seg]) for v in (batch.column(1)[k], batch.column(2)[k]))
                for i in range(0, sizes[seg], 1 << 16):
                    part = slice(i, min(i + (1 << 16), sizes[seg]))
                    at = np.arange(part.start, part.stop, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), seg, np.int32)), pa.array(at), pa.array(x[part] / hubs), pa.array(y[part] / authorities)], names=["seg", "at", "hub", "authority"])

    both = hub.select("seg", "x").join(authority.select("seg", F.col("x").alias("y")).hint("shuffle_hash"), "seg", "full_outer")
    rows = nodes.join(both.mapInArrow(values, "seg int, at int, hub double, authority double").hint("merge"), ["seg", "at"])
    if not silent:
        return rows.select("node", "hub", "authority")
    # No two rows of no node are the same node; a node that got nothing has no row.
    sides = rows.where("hub > 0 or authority > 0").withColumn("side", F.explode(F.when(F.col("node").isNull(), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    sides = sides.select("node", "side", F.when(F.col("side") == 2, 0.0).otherwise(F.col("hub")).alias("hub"), F.when(F.col("side") == 1, 0.0).otherwise(F.col("authority")).alias("authority"))
    return sides.where("side = 0 or hub > 0 or authority > 0").select("node", "hub", "authority")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, side, other): a row for each caller and callee, so that a hub's row does
    not grow with its neighbours."""
    e = edges.select("src", "dst").distinct()
    return e.select(F.col("dst").alias("node"), F.lit("caller").alias("side"), F.col("src").alias("other")).unionAll(e.select("src", F.lit("callee"), "dst"))
