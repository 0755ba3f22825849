"""The symbol graph: building, resolving names, communities, chains, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import gates, intask


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (src_name, dst_name, ...) with src and dst: of the nodes (id, name, seq)
    of a name the first by seq; edges to unknown names are dropped."""
    first = nodes.groupBy("name").agg(F.min_by("id", "seq").alias("id"))
    a = first.select(F.col("name").alias("src_name"), F.col("id").alias("src"))
    b = first.select(F.col("name").alias("dst_name"), F.col("id").alias("dst"))
    return edges.join(a, "src_name").join(b, "dst_name")


def simple_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type): one edge an ordered pair, the last by seq."""
    return edges.groupBy("src", "dst").agg(F.max_by("edge_type", "seq").alias("edge_type"))


def import_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst) of import symbols with a module and the symbols of their name: a hash
    join by name.  ``symbols``: id, name, kind, module."""
    i = symbols.where("kind = 'import' and module <> ''").select(F.col("id").alias("src"), "name")
    s = symbols.where("kind <> 'import'").select(F.col("id").alias("dst"), "name")
    return i.join(s, "name").select("src", "dst")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of the communities (node, community) on undirected edges (src, dst, weight): the
    share of the weight inside them less what it would be by the degrees alone."""
    a, b = labels.withColumnsRenamed({"node": "src", "community": "a"}), labels.withColumnsRenamed({"node": "dst", "community": "b"})
    rows = edges.hint("merge").join(a, "src").hint("merge").join(b, "dst")
    ends = rows.select("a", F.col("weight").alias("w")).unionAll(rows.select("b", "weight")).groupBy("a").agg(F.sum("w").alias("d"))
    inside = rows.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("i"), F.sum("weight").alias("m")).first()
    if not inside["m"]:
        return 0.0
    squares = ends.agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    return inside["i"] / inside["m"] - squares / (4.0 * inside["m"] * inside["m"])


def _moved(edges: DataFrame, degree: DataFrame, labels: DataFrame, m: float, turn: int, parts: int, apart: bool) -> DataFrame:
    """``labels`` after one step: nodes move to the neighbouring community with the largest
    gain, if that is above staying.  Either the nodes of one part of ``parts`` (by hash) do,
    or (``apart``) of all moves from or to a community the best, so that no two moves
    touch the same one and their gains add up."""
    both = edges.where("src <> dst").select("src", "dst", "weight")
    both = both.unionAll(both.select("dst", "src", "weight"))
    total = degree.hint("merge").join(labels, "node").groupBy("community").agg(F.sum("degree").alias("total"))
    turns = F.pmod(F.xxhash64("src", F.lit(turn // parts)), F.lit(parts)) == turn % parts
    links = (both if apart else both.where(turns)).hint("merge").join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
    own = labels.hint("merge").join(degree, "node").select(F.col("node").alias("src"), F.col("community").alias("own"), "degree")
    seen = links.hint("merge").join(own, "src").hint("merge").join(total, "community")
    # Without the node itself its community is smaller by its degree.
    stays = F.col("community") == F.col("own")
    gain = F.round(F.col("w") - (F.col("total") - F.when(stays, F.col("degree")).otherwise(0.0)) * F.col("degree") / (2.0 * m), 9)
    best = seen.withColumn("gain", gain).groupBy("src").agg(F.max(F.struct("gain", (-F.col("community")).alias("c"))).alias("best"), F.max(F.when(stays, F.col("gain"))).alias("here"), F.first("own").alias("own"), F.first("degree").alias("degree"))
    alone = own.hint("merge").join(total.withColumnRenamed("community", "own"), "own").select("src", F.round(-(F.col("total") - F.col("degree")) * F.col("degree") / (2.0 * m), 9).alias("none"))
    more = F.col("best.gain") - F.greatest(F.coalesce("here", "none"), F.col("none"))
    moves = best.hint("merge").join(alone, "src").where(more > 1e-9).select(F.col("src").alias("node"), "own", (-F.col("best.c")).alias("to"), F.round(more, 9).alias("more"))
    if apart:
        moves = written(moves, "moves")
        first = moves.select(F.explode(F.array("own", "to")).alias("c"), F.struct("more", (-F.col("node")).alias("n")).alias("k")).groupBy("c").agg(F.max("k").alias("k"))
        mine = F.struct("more", (-F.col("node")).alias("n"))
        moves = moves.hint("merge").join(first.withColumnsRenamed({"c": "own", "k": "k1"}), "own").hint("merge").join(first.withColumnsRenamed({"c": "to", "k": "k2"}), "to").where((mine == F.col("k1")) & (mine == F.col("k2")))
    moves = moves.select("node", "to")
    return labels.hint("merge").join(moves, "node", "left").select("node", F.coalesce("to", "community").alias("community"))


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community, size): label propagation on the undirected graph, each node
    taking its neighbours' most frequent label (the smallest on ties), all at once, for
    a fixed number of rounds or until nothing moves: quicker and coarser than
    ``communities``.  Each round is written."""
    e = edges.where("src <> dst").select("src", "dst")
    both = written(e.unionAll(e.select("dst", "src")).distinct(), "both")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = seen.groupBy(F.col("src").alias("node")).agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("b"))
        new = written(best.select("node", (-F.col("b.c")).alias("community")), "labels")
        moved = not new.join(labels.withColumnRenamed("community", "old"), "node").where("community <> old").isEmpty()
        labels = new
        if not moved:
            break
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(sizes, "community").select("node", "community", F.least("size", F.lit(100)).alias("size"))


def _cells(groups: int, turn: int) -> list[int]:
    """The cell of each group in a turn of ``groups`` - 1, in which each two groups share a
    cell once (as the rounds of a tournament)."""
    if groups == 1:
        return [0]
    last = groups - 1
    alone = next(x for x in range(last) if 2 * x % last == turn % last)
    return [min(x, last if x == alone else (turn - x) % last) for x in range(last)] + [alone]


def _met(edges: DataFrame, degree: DataFrame, labels: DataFrame, m: float, cycle: int, groups: int, turn: int) -> DataFrame:
    """(node, community, moved): ``labels`` after moves among the communities that share a
    cell: they are dealt over ``groups`` (by hash, each cycle others), two of which meet."""
    group = F.pmod(F.xxhash64("community", F.lit(cycle)), F.lit(groups)).cast("int")
    cell = F.array(*map(F.lit, _cells(groups, turn)))[group]
    own = labels.select("node", "community", cell.alias("cell"))
    a, b = own.select(F.col("node").alias("src"), F.col("cell").alias("cell")), own.select(F.col("node").alias("dst"), F.col("cell").alias("other"))
    inside = edges.where("src <> dst").hint("merge").join(a, "src").hint("merge").join(b, "dst").where("cell = other").select("cell", "src", "dst", "weight")
    return intask.moves(own.hint("merge").join(degree, "node").select("cell", "node", "community", "degree"), inside, m)


def communities(edges: DataFrame, parts: int = 2) -> DataFrame:
    """(node, community, size): communities of high modularity on the undirected graph.

    Nodes start alone and go where the modularity gains most, until no move of a node
    gains; then each community becomes one node of a smaller graph, until no level gains.
    The name of a community is its smallest node, and reruns agree.

    A graph that fits a task (``intask.EDGES``) is done in one.  Of a larger one the nodes of
    one part of ``parts`` (by hash) move at once, as long as the modularity of the whole
    rises.  Then communities are dealt over as many cells as the edges need, and nodes move
    inside their cell, which always gains; in a cycle of turns each two communities share a
    cell, and the level ends with a cycle in which no node moves."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    e = written(e, "graph")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    result = nodes.withColumn("community", F.col("node"))
    count = e.count()
    m = float(count)
    if not count:
        return result.withColumn("size", F.lit(1))
    while True:
        tasks = -(-count // intask.EDGES)
        if tasks == 1:
            labels = written(intask.communities(e, m), "labels")
            result = result.hint("merge").join(labels.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community"))
            break
        degree = written(e.select(F.col("src").alias("node"), "weight").unionAll(e.select("dst", "weight")).groupBy("node").agg(F.sum("weight").alias("degree")), "degrees")
        labels = written(degree.select("node", F.col("node").alias("community")), "labels")
        best, turn = modularity(e, labels), 0
        while True:
            step = written(_moved(e, degree, labels, m, turn, parts, False), "labels")
            found = modularity(e, step)
            if found <= best + 1e-9:
                break
            labels, best, turn = step, found, turn + 1
        gained, moved, cycle = turn > 0, True, 0
        while moved:
            moved = False
            for turn in range(2 * tasks - 1):
                step = written(_met(e, degree, labels, m, cycle, 2 * tasks, turn), "labels")
                moved |= not step.where("moved").isEmpty()
                labels = step.select("node", "community")
            gained, cycle = gained or moved, cycle + 1
        if not gained:
            break
        names = labels.groupBy("community").agg(F.min("node").alias("name"))
        labels = written(labels.hint("merge").join(names, "community").select("node", F.col("name").alias("community")), "labels")
        result = written(result.hint("merge").join(labels.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community")), "labels")
        a, b = labels.withColumnsRenamed({"node": "src", "community": "a"}), labels.withColumnsRenamed({"node": "dst", "community": "b"})
        joined = e.hint("merge").join(a, "src").hint("merge").join(b, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
        e = written(joined.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "graph")
        count = e.count()
    names = result.groupBy("community").agg(F.min("node").alias("name"), F.count(F.lit(1)).alias("size"))
    return result.hint("merge").join(names, "community").select("node", F.col("name").alias("community"), "size")


def call_depth(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, depth): one more than the distance from the first entry (node, seq) that
    reaches the node; 1 where none does.

    A node keeps the least (seq, distance) that its callers have found: all nodes on a
    shortest way from the first entry have that entry, so it comes after as many rounds as
    the way is long.  Only nodes that changed in a round meet the edges in the next; a
    round holds a row a node, and is written."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    new = entries.groupBy("node").agg(F.struct(F.min("seq").alias("seq"), F.lit(0).alias("distance")).alias("best"))
    new = found = written(new, "depths")
    while True:
        told = new.join(e, new["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("best.seq", (F.col("best.distance") + 1).alias("distance"))).alias("told"))
        both = found.join(told, "node", "full_outer")
        closer = F.col("told").isNotNull() & (F.col("best").isNull() | (F.col("told") < F.col("best")))
        found = written(both.select("node", F.when(closer, F.col("told")).otherwise(F.col("best")).alias("best"), closer.alias("new")), "depths")
        new = found.where("new").select("node", "best")
        if new.isEmpty():
            break
        found = found.select("node", "best")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(found.select("node", (F.col("best.distance") + 1).alias("depth")), "node", "left").select("node", F.coalesce("depth", F.lit(1)).alias("depth"))


def chains(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, root, length): following the first parent (by seq) of each node upward
    until there is none, or a node comes again (then the last new one is the root)."""
    parent = written(edges.groupBy(F.col("dst").alias("at")).agg(F.min_by("src", "seq").alias("up")), "parents")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    open_ = written(nodes.select("node", F.col("node").alias("at"), F.array("node").alias("path")), "chains")
    done = None
    for _ in range(most):
        step = open_.join(parent, "at", "left")
        ends = F.col("up").isNull() | F.array_contains("path", F.col("up"))
        step = written(step.select("node", "at", "path", "up", ends.alias("ends")), "chains")
        own = step.where("ends").select("node", F.col("at").alias("root"), F.size("path").alias("length"))
        done = own if done is None else done.unionAll(own)
        open_ = step.where("not ends").select("node", F.col("up").alias("at"), F.concat("path", F.array("up")).alias("path"))
        if open_.isEmpty():
            break
    return done


def node_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, name, change, impact) of nodes (id, name, signature) that came, went or have
    another signature."""
    a, b = before.select("id", F.col("name").alias("n1"), F.col("signature").alias("s1"), F.lit(True).alias("a")), after.select("id", F.col("name").alias("n2"), F.col("signature").alias("s2"), F.lit(True).alias("b"))
    out = a.join(b, "id", "full_outer").withColumn("name", F.coalesce("n1", "n2"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("s1").eqNullSafe(F.col("s2")), "modified")
    impact = F.when(F.col("change") == "removed", F.when(F.col("name").startswith("_"), "medium").otherwise("high")).when(F.col("change") == "added", "low").otherwise(F.when(F.col("s2").isNotNull(), "high").otherwise("medium"))
    return out.withColumn("change", change).where("change is not null").withColumn("impact", impact).select("id", "name", "change", "impact")


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, change, impact, relevant) of edges (src, dst as names) that came or
    went; those that touch security weigh more."""
    a, b = before.select("src", "dst").distinct().withColumn("a", F.lit(True)), after.select("src", "dst").distinct().withColumn("b", F.lit(True))
    out = a.join(b, ["src", "dst"], "full_outer").where("a is null or b is null").withColumn("change", F.when(F.col("a").isNull(), "added").otherwise("removed"))
    relevant = gates.touches_security(F.col("src"), F.col("dst"))
    impact = F.when(relevant, F.when(F.col("change") == "added", "critical").otherwise("high")).otherwise(F.when(F.col("change") == "removed", "medium").otherwise("low"))
    return out.select("src", "dst", "change", impact.alias("impact"), relevant.alias("relevant"))


#: Patterns of this engine by language: kind, pattern with name and parameters.
SIGNATURES = {
    "python": [("def", r"def\s+([A-Za-z0-9_]+)\s*\(([^)]*)\)"), ("class", r"class\s+([A-Za-z0-9_]+)(?:\(([^)]*)\))?:")],
    "javascript": [("function", r"function\s+([A-Za-z0-9_]+)\s*\(([^)]*)\)"), ("class", r"class\s+([A-Za-z0-9_]+)()"), ("const", r"const\s+([A-Za-z0-9_]+)\s*=\s*(?:async\s+)?\(([^)]*)\)")],
    "rust": [("fn", r"fn\s+([A-Za-z0-9_]+)\s*\(([^)]*)\)"), ("struct", r"struct\s+([A-Za-z0-9_]+)()"), ("trait", r"trait\s+([A-Za-z0-9_]+)()")],
}
#: Words before a bracket that are no calls.
NO_CALLS = ["if", "for", "while", "with", "return", "import"]


def signatures(text: Column, language: str = "python") -> Column:
    """A map of the names a text defines to their signatures, the last of a name."""
    found = F.array().cast("array<struct<key:string,value:string>>")
    for kind, p in SIGNATURES[language]:
        names, args = F.regexp_extract_all(text, F.lit(p), 1), F.regexp_extract_all(text, F.lit(p), 2)
        found = F.concat(found, F.zip_with(names, args, _made(kind)))
    keys = F.array_distinct(F.transform(found, lambda x: x["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(found, lambda x: x["key"] == k), -1)["value"])))


def _made(kind: str):
    plain = kind in ("class", "struct", "trait")
    return lambda n, a: F.struct(n.alias("key"), F.concat(F.lit(kind + " "), n, F.when(F.lit(not plain) | (a != ""), F.concat(F.lit("("), a, F.lit(")"))).otherwise("")).alias("value"))


def signature_impact(old: Column, new: Column) -> Column:
    """By the difference in the number of words, then by the return type."""
    words = lambda s: F.size(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}_]+"), 0))
    gap = F.abs(words(old) - words(new))
    result = lambda s: F.element_at(F.split(s, " -> "), -1)
    typed = old.contains(" -> ") & new.contains(" -> ") & (result(old) != result(new))
    return F.when(gap > 2, "high").when(gap > 0, "medium").when(typed, "medium").otherwise("low")


def calls(text: Column) -> Column:
    """The distinct calls of a text, ``receiver->name`` or ``__module__->name``."""
    bound = r"([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)\s*\("
    bare = r"(?<!\.)([A-Za-z0-9_]+)\s*\([^)]*\)"
    one = F.zip_with(F.regexp_extract_all(text, F.lit(bound), 1), F.regexp_extract_all(text, F.lit(bound), 2), lambda a, b: F.concat(a, F.lit("->"), b))
    two = F.transform(F.filter(F.regexp_extract_all(text, F.lit(bare), 1), lambda x: ~x.isin(NO_CALLS)), lambda x: F.concat(F.lit("__module__->"), x))
    return F.array_sort(F.array_distinct(F.concat(one, two)))
