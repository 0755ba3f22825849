"""Operators whose work grew faster than their tables: results and the shape of plans."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import findings, gates, graph, problems


@pytest.mark.parametrize("cell", [24_000_000, 40])
def test_triangles_shuffle_no_wedges(spark, monkeypatch, cell):
    """whatever the number of parts, the triangles are those of all triples."""
    monkeypatch.setattr(graph, "CELL", cell)
    rng = random.Random(cell)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(110)] + [(0, i) for i in range(25)] + [(100, 101), (None, 1)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    pairs = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
    want = {}
    for t in itertools.combinations(range(25), 3):
        if all(frozenset(p) in pairs for p in itertools.combinations(t, 2)):
            for x in t:
                want[x] = want.get(x, 0) + 1
    found = graph.triangles(frame)
    assert {r["node"]: r["n"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and plan.count("Join") == 1  # the names of nodes


def test_orders_of_many_plans_in_one_call(spark):
    """a plan is no call of its own; a plan may be longer than a batch."""
    rows = [(p, i, 1 + (i * p) % 3, [i - 1] if i else None) for p in range(40) for i in range(3)] + [(None, 5, None, []), (None, 4, 2, [])] + [(99, i, 1, []) for i in range(200)]
    frame = spark.createDataFrame(rows, "plan long, id long, priority int, needs array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = problems.execution_order(frame)
        got = {(r["plan"], r["position"]): r["id"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and all(got[p, i + 1] == i for p in range(40) for i in range(3)) and [got[99, i + 1] for i in range(200)] == list(range(200))
    assert (got[None, 1], got[None, 2]) == (4, 5) and "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()


ODD = ["+++ b/x y/z.py extra\n--- a//\n+++ /dev/null\n--- \n+++", "+a = 1\n++b=2\n+++ c = 3\n+[dependencies] = 4\n+d\n-e\n--f\n--- g\n+ = \n+h=i=j\r\n+k\u2028+l = 2", '+    "left": 1\n+    "x"\n"dependencies"\n+requirements.txt\n+a requirements.txt==2\n+#', "os.system\n+x\n", "+\nos.system\n+ eval(1) exec\r+pickle.load", "", None, "+x = 1\n", "\n\n+"]


def test_rules_of_patches_line_by_line(spark):
    """one pass a rule finds what cutting every line found."""
    frame = spark.createDataFrame([(d,) for d in ODD], "d string")
    rows = frame.select("d", gates.touched(F.col("d")).alias("t"), gates.changed_lines(F.col("d")).alias("n"), gates.forbidden(F.col("d")).alias("f"), gates.new_packages(F.col("d")).alias("p")).collect()
    for r in rows:
        if r["d"] is None:
            continue
        lines = r["d"].split("\n")
        heads = [x.split(" ")[1] for x in lines if x.startswith(("+++ ", "--- "))]
        assert r["t"] == list(dict.fromkeys(x.split("/")[-1] for x in heads if x != "/dev/null" and x.split("/")[-1])), r
        assert r["n"] == sum((x[:1] == "+" and x[:3] != "+++") or (x[:1] == "-" and x[:3] != "---") for x in lines), r
        added = [x for x in lines if x.startswith("+")]
        assert r["f"] == [x for x in gates.FORBIDDEN if any(x in a for a in added)], r
        own = [re.sub("(==|>=).*$", "", x[1:].strip(" ")) for x in added if "requirements.txt" in x]
        if '"dependencies"' in r["d"]:
            own += [x.split('"')[1] for x in added if x.startswith('+    "') and ":" in x]
        if "[dependencies]" in r["d"]:
            own += [x[1:].split("=")[0].strip(" ") for x in added if "=" in x and "[dependencies]" not in x and not x.startswith("+++")]
        assert r["p"] == list(dict.fromkeys(own)), r
    plan = frame.select(gates.forbidden(F.col("d")), gates.changed_lines(F.col("d")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_sets_of_a_band_are_those_of_the_pairs(spark):
    """the values near each row, without a row for each pair."""
    rng = random.Random(2)
    left = spark.createDataFrame([(i, rng.choice("ab"), rng.randrange(-40, 40)) for i in range(30)] + [(30, None, 1), (31, "a", None)], "id long, file string, line int")
    right = spark.createDataFrame([(rng.choice("abc"), rng.randrange(-40, 40), rng.choice("xyz")) for _ in range(60)], "file string, at int, name string")
    want = {}
    for r in findings.band_join(left, right, "file", "line", "at", 4).collect():
        want.setdefault(r["id"], set()).add(r["name"])
    found = findings.band_sets(left, right, "file", "line", "at", 4, "name")
    got = found.collect()
    assert {r["id"]: set(r["near"]) for r in got} == want and all(len(r["near"]) == len(set(r["near"])) for r in got)


def test_guided_paths_are_searched_in_tasks(spark):
    """no join of a step, and ties in the order of names."""
    from lodestone.operators import walks

    frame = spark.createDataFrame([("a", "é"), ("a", "b"), ("é", "z"), ("b", "z"), ("z", "a"), (None, "z")], "src string, dst string")
    found = walks.guided_paths(frame, spark.createDataFrame([("a", "z"), ("z", "q")], "source string, target string"), 5, 5)
    assert [r["path"] for r in found.collect()] == [["a", "b", "z"], ["a", "é", "z"]]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tree_of_rows(spark, tmp_path):
    """a tree of many small files is rows; what is left out, and sizes in bytes."""
    from lodestone.plans import catalogue, symbolgraph  # noqa: F401 (fills the catalogue)
    from lodestone.sources import repo

    files = [("src/a/main.py", "é = 1\r\n".encode()), ("src/build/b.py", b"y"), ("src/skip_c.go", b"z"), ("notes.md", b"z"), ("lib.rs", b"\xff"), ("e.js", b"")]
    found = repo.sources(spark.createDataFrame(files, "path string, content binary"), globs=("skip*",))
    assert sorted(tuple(r) for r in found.collect()) == [("e.js", "javascript", 0, ""), ("lib.rs", "rust", 1, "\ufffd"), ("src/a/main.py", "python", 8, "é = 1\n")]
    spark.range(1, 13).selectExpr("id as s_suppkey", "id as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    plan = catalogue.QUERIES["repo_scan"](spark, str(tmp_path))
    assert plan.count() == 7 and plan.inputFiles() and all("supplier.parquet" in f for f in plan.inputFiles())


def test_edges_of_ranks_stay_in_place(spark, monkeypatch):
    """the edges are dealt by their source once, and let go at the end."""
    deals = []
    dealt = graph.dealt
    monkeypatch.setattr(graph, "dealt", lambda df, *keys: deals.append(keys) or dealt(df, *keys))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = graph.pagerank(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long"), 3, tolerance=0)
    ranks = {r["node"]: round(r["rank"], 6) for r in found.collect()}
    assert deals == [("src",)] and round(sum(ranks.values()), 5) == 1 and ranks[3] == 0.05
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_steps_of_hubs_move_no_row_for_an_edge(spark, monkeypatch):
    """edges stay in blocks; many small segments and rows of blocks give the same."""
    monkeypatch.setattr(graph, "SEGMENT", 3)
    monkeypatch.setattr(graph, "BLOCK", 4)
    rows, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: (rows.append((label, out := kept(df, label))), out)[1])
    rng = random.Random(6)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(60)}
    found = {r["node"]: (r["hub"], r["authority"]) for r in graph.hits(spark.createDataFrame(sorted(edges), "src long, dst long"), 4, tolerance=0).collect()}
    hub = dict.fromkeys((a for a, _ in edges), 1.0)
    for _ in range(4):
        got = {x: sum(hub.get(a, 0) for a, b in edges if b == x) for x in range(14)}
        got = {x: v / sum(got.values()) for x, v in got.items()}
        hub = {x: sum(got[b] for a, b in edges if a == x) for x in range(14)}
        hub = {x: v / sum(hub.values()) for x, v in hub.items()}
    assert all(abs(h - hub[x]) < 1e-12 and abs(a - got[x]) < 1e-12 for x, (h, a) in found.items()) and found.keys() == {x for e in edges for x in e}
    sums = [df.count() for label, df in rows if label == "sums"]
    assert len(sums) == 8 and max(sums) <= 5  # a row for a segment


def test_degrees_take_as_many_tasks_as_edges_need(spark, monkeypatch):
    """F32: the part of a task does not grow with the edges."""
    monkeypatch.setattr(graph, "PART", 4)
    edges = [(i % 9, i % 4) for i in range(50)] + [(None, 1), (None, 1), (2, None)]
    found = graph.degrees(spark.createDataFrame(edges, "src long, dst long"))
    assert "REPARTITION_BY_NUM, " in (plan := found._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(src" in plan and ", 14)" in plan
    want = {}
    for a, b in set(edges):
        for x, side in ((a, 1), (b, 0)):
            want.setdefault(x, [0, 0])[side] += 1
    assert {r["node"]: [r["d_in"], r["d_out"]] for r in found.collect()} == want


def test_steps_of_communities_send_nothing_to_all(spark):
    """no join of a step goes through the driver, whatever the estimates are."""
    from lodestone.operators import symbolgraph

    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "src long, dst long, weight double")
    degree = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 1.0), (4, 1.0), (5, 1.0)], "node long, degree double")
    labels = degree.selectExpr("node", "node as community")
    for apart in (False, True):
        found = symbolgraph._moved(e, degree, labels, 3.0, 0, 1, apart)
        assert found.count() == 5 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_edges_of_triangles_are_made_once(spark, monkeypatch):
    """the distinct edges are written once and used for degrees, lists and shares."""
    labels, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: (labels.append(label), kept(df, label))[1])
    frame = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 4), (None, 4)], "src long, dst long")
    found = graph.clustering(frame)
    assert {r["node"]: (r["degree"], r["clustering"]) for r in found.collect()} == {1: (2, 1.0), 2: (2, 1.0), 3: (3, 0.3333), 4: (1, 0.0)}
    assert labels == ["edges", "nodes", "lists"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
