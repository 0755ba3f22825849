"""Nulls, empty tables, ties and repeated rows in the operators, and brute force."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone import plugins
from lodestone.functions import vectors
from lodestone.operators import code, delta, features, findings, gates, graph, history, ingest, paths, problems, reports, rules, symbolgraph, symbols, syntax, votes, walks
from lodestone.sources import repo
from lodestone.sources.tables import scratch

DOCS = "doc_id long, text string, extra string"
ROWS = [(1, None, "a"), (2, "", None), (3, "if x:\n    eval(y)\n# 42\nz = 7\n", "b"), (3, "if x:\n    eval(y)\n# 42\nz = 7\n", "b"), (None, "token = \"abcdefghij\"", "c"), (5, "é if\nälif or\n\n", "d")]
EDGES = "src long, dst long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def graph_of(spark, pairs):
    return spark.createDataFrame(list(pairs), EDGES)


def test_texts(docs, none):
    got = sorted(((r["doc_id"] or 0), r["loc"], r["comments"], r["cc"], r["priority"]) for r in code.complexity(docs).collect())
    assert got == [(0, 1, 0, 1, "P3"), (1, 0, 0, 1, "P3"), (2, 0, 0, 1, "P3"), (3, 4, 1, 2, "P3"), (3, 4, 1, 2, "P3"), (5, 3, 0, 3, "P3")]
    assert code.complexity(none).count() == 0
    assert {(r["doc_id"], r["line_no"], r["rule"]) for r in rules.line_hits(docs).collect()} == {(3, 2, "command_injection")}
    assert rules.line_hits(docs).count() == 2 and rules.line_hits(none).count() == 0
    assert {(r["doc_id"], r["rule"], r["line_start"]) for r in rules.text_hits(docs).collect()} == {(3, "unsafe_deserialization", 2), (None, "hardcoded_secrets", 1)}
    assert sorted(r["hits"] for r in rules.line_counts(docs).collect()) == [0, 0, 0, 0, 1, 1]
    assert [r["n"] for r in docs.select(F.size(code.numbers(F.col("text"))).alias("n")).collect() if r["n"] and r["n"] > 0] == [1, 1]
    assert code.duplicate_blocks(none).count() == 0 and code.duplicate_blocks(docs).count() == 0
    assert reports.chunks(docs, 2).where("doc_id = 2").count() == 1 and reports.chunks(none).count() == 0


def test_a_block_can_be_its_own_copy(spark):
    rows = spark.createDataFrame([(1, "a=1\nb=2\nc=3\n\nd=4")], "doc_id long, text string")
    assert [(r["n"], r["first_line"]) for r in code.duplicate_blocks(rows).collect()] == [(2, 0)]


def test_matches_over_lines(spark):
    rows = spark.createDataFrame([(1, "x\nexec(a,\nb)\n\nexec(c)")], "doc_id long, text string")
    assert sorted((r["line_start"], r["line_end"]) for r in rules.text_hits(rows).collect() if r["n_rule"] == 9) == [(2, 3), (5, 5)]


def test_problems(spark, docs, none):
    low = F.lower("text")
    got = docs.select(problems.first_fit(low, problems.TYPES, "unknown").alias("k"), problems.severity(low, F.lit("bug")).alias("s"), F.size(problems.components(low)).alias("c")).collect()
    assert all(r["k"] is not None and r["s"] == "medium" for r in got)
    assert docs.select(F.inline(problems.scores(low))).count() == 8 * len(ROWS)
    text = spark.createDataFrame([("One ui. Two api. ui again",), (None,)], "text string")
    assert [list(r[0] or []) for r in text.select(problems.evidence_sentences(F.col("text"), ["api", "ui", "no"])).collect()] == [["Two api.", "One ui."], []]
    flags = spark.createDataFrame([("while true: sleep",), ("try:\n  x",), ("try:\n except",), (None,)], "t string")
    assert [r[0] for r in flags.select(F.array_join(F.map_keys(problems.code_indicators(F.col("t"))), ",")).collect()] == ["performance_risk", "error_handling_gap", "", ""]


def kahn(items):
    left = {i: len(n) for i, _, n in items}
    rank = {i: p for i, p, _ in items}
    queue, out = [i for i, *_ in items if not left[i]], []
    while queue:
        queue.sort(key=rank.get)
        now = queue.pop(0)
        out.append(now)
        for i, _, n in items:
            for _ in range(list(n).count(now)):
                left[i] -= 1
                if not left[i]:
                    queue.append(i)
    return out + sorted((i for i, *_ in items if i not in out), key=rank.get)


def test_execution_order(spark):
    rng, rows = random.Random(3), []
    for plan in range(30):
        n = rng.randint(1, 9)
        for i in range(n):
            needs = rng.sample(range(n), rng.randint(0, min(2, n - 1))) if rng.random() < 0.7 else []
            needs = [x for x in needs if x != i and (plan % 3 == 0 or x < i)] + ([99] if rng.random() < 0.1 else [])
            rows.append((plan, i, rng.randint(1, 100) if plan % 2 else rng.randint(1, 3), needs))
    frame = spark.createDataFrame(rows, "plan long, id long, priority int, needs array<long>")
    got = {p: [r["id"] for r in sorted(g, key=lambda r: r["position"])] for p, g in itertools.groupby(sorted(problems.execution_order(frame).collect(), key=lambda r: r["plan"]), key=lambda r: r["plan"])}
    for plan in range(30):
        assert got[plan] == kahn([(i, p, n) for q, i, p, n in rows if q == plan]), plan
    assert problems.execution_order(frame.limit(0)).count() == 0 and heapq


def test_gates(spark):
    schema = "before string, after string, path string, passed long, total long"
    rows = spark.createDataFrame([(None, None, "a.py", None, None), ("def f(a):\n    pass", "def f(a):\n    pass", "a.py", 1, 2), ("x", "(", "a.js", 0, 0)], schema)
    got = gates.fix_confidence(rows).collect()
    assert [(r["syntax"], r["tests"], r["api"]) for r in got] == [(100.0, 75.0, 100.0), (100.0, 50.0, 100.0), (50.0, 75.0, 100.0)]
    assert gates.fix_confidence(rows.limit(0)).count() == 0
    diff = "--- /dev/null\n+++ b/new.py\n+import os\n+os.system(x)\n-y"
    out = spark.createDataFrame([(diff,), (None,), ("",)], "diff string").select(F.size(gates.touched(F.coalesce("diff", F.lit("")))).alias("n"), gates.changed_lines(F.coalesce("diff", F.lit(""))).alias("l"), F.size(gates.dangers(F.coalesce("diff", F.lit("")))).alias("d")).collect()
    assert [tuple(r) for r in out] == [(1, 3, 1), (0, 0, 0), (0, 0, 0)]
    assert [len(r["violations"]) for r in gates.policy(spark.createDataFrame([(diff,), (None,)], "diff string")).collect()] == [1, 0]


def test_a_valid_package_passes(spark):
    hyp = "array<struct<title:string,type:string,confidence:double,data_flow_path:array<string>>>"
    schema = f"candidate_id string, file_path string, line_start int, line_end int, repro struct<description:string,code_snippet:string,input_data:string>, symbols array<string>, snippet string, call_depth int, invariant struct<type:string,description:string,details:string>, scope string, risk_class string, hypotheses {hyp}"
    three = [("a", "sql", 0.8, ["x"]), ("b", "auth", 0.7, []), ("c", "race", 0.6, [])]
    good = ("c1", "src/a.py", 1, 9, ("d", "c", "i"), ["s"], "g", 1, ("t", "input reaches query", "a value is not checked at all"), "local", "high", three)
    change = lambda i, v: tuple(v if k == i else x for k, x in enumerate(good))
    rows = [good, change(11, three[:2]), change(5, []), change(8, ("t", "There is a bug", good[8][2])), change(1, "a.txt"), change(11, [])]
    got = gates.evidence_gate(spark.createDataFrame(rows, schema)).collect()
    assert math.isclose(got[0]["score"], 0.88) and [r["decision"] for r in got] == ["PASSED", "RETRY", "RETRY", "RETRY", "REJECTED", "RETRY"]


def test_votes(spark):
    schema = "context string, seq long, model string, fix string, confidence double, weight double, success double"
    rows = [("a", 1, "m1", "x = 1", 0.8, 1.0, 1.0), ("a", 2, "m2", " x = 1 \n# note", 0.9, 1.0, 0.0), ("a", 3, "m3", "y", 0.95, 1.0, 0.0), ("a", 4, "m4", "y", 0.1, 1.0, 1.0), ("b", 1, "m1", None, 0.9, 1.0, 1.0), ("c", 1, "m1", "p", 0.7, 1.0, 1.0), ("c", 2, "m2", "q", 0.7, 1.0, 1.0)]
    got = {(r["context"], r["asked"]): (r["model"], r["strategy"], r["agreement"]) for r in gates.vote(spark.createDataFrame(rows, schema), "context").collect()}
    assert got["a", "majority"] == ("m2", "majority", 0.6667) and got["a", "weighted"][0] == "m1" and got["a", "confidence"][0] == "m3"
    assert got["a", "consensus"][1] == "weighted" and ("b", "majority") not in got and got["c", "majority"][0] == "m1"
    assert gates.vote(spark.createDataFrame([], schema), "context").count() == 0


def test_graphs(spark):
    empty = graph_of(spark, [])
    for f in (graph.degrees, graph.triangles, graph.clustering, graph.reachable, graph.pagerank, graph.hits, graph.neighbours, graph.cycles, symbolgraph.communities, walks.simple_paths):
        assert f(empty).count() == 0, f
    chain = graph_of(spark, [(i, i + 1) for i in range(22)] + [(0, 1)])
    assert graph.reachable(chain).count() == 22 * 23 // 2  # farther than any fixed number of rounds
    start = spark.createDataFrame([(0,)], "node long")
    assert walks.distances(chain, start).agg(F.max("distance")).first()[0] == 22
    assert max(len(r["path"]) for r in walks.shortest_paths(chain, start).collect()) == 23
    loop = graph_of(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    got = {r["node"]: (r["root"], r["length"]) for r in symbolgraph.chains(loop.withColumn("seq", F.col("src"))).collect()}
    assert got == {1: (2, 3), 2: (3, 3), 3: (1, 3), 4: (1, 4)}
    assert {r["node"]: r["depth"] for r in symbolgraph.call_depth(loop, spark.createDataFrame([(4, 1), (2, 2)], "node long, seq int")).collect()} == {1: 3, 2: 1, 3: 2, 4: 1}


def test_pagerank_against_power_iteration(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(12), rng.randrange(14)) for _ in range(40)}
    nodes = sorted({x for e in edges for x in e})
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(60):
        lost = sum(rank[n] for n in nodes if not out[n])
        new = {n: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for n in nodes}
        for n in nodes:
            for m in out[n]:
                new[m] += 0.85 * rank[n] / len(out[n])
        rank = new
    got = {r["node"]: r["rank"] for r in graph.pagerank(graph_of(spark, edges)).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-5 for n in nodes)


def test_resolution_and_changes(spark):
    nodes = spark.createDataFrame([(1, "f", 1), (2, "f", 2), (3, None, 3)], "id long, name string, seq int")
    edges = spark.createDataFrame([("f", "f", "A", 1), ("f", "f", "B", 2), ("f", "gone", "C", 3), (None, "f", "D", 4)], "src_name string, dst_name string, edge_type string, seq int")
    assert [tuple(r) for r in symbolgraph.simple_edges(symbolgraph.resolved(edges, nodes)).collect()] == [(1, 1, "B")]
    one = spark.createDataFrame([(1, "f", "f()"), (2, "_g", None)], "id long, name string, signature string")
    two = spark.createDataFrame([(1, "f", "f(a)"), (3, "h", "h()")], "id long, name string, signature string")
    assert {(r["id"], r["change"], r["impact"]) for r in symbolgraph.node_changes(one, two).collect()} == {(1, "modified", "high"), (2, "removed", "medium"), (3, "added", "low")}
    text = spark.createDataFrame([("class A(B):\n def f(x): pass\ndef f(y): q.f(1)",), (None,), ("",)], "t string")
    got = text.select(symbolgraph.signatures(F.col("t")).alias("s"), symbolgraph.calls(F.col("t")).alias("c")).collect()
    assert got[0]["s"] == {"A": "class A(B)", "f": "def f(y)"} and "q->f" in got[0]["c"] and got[2]["s"] == {}


def test_numbers_in_order(spark):
    rows = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("id"), (F.col("id") % 5).alias("k"))
    got = sorted(reports.numbered(rows, [F.col("k"), F.desc("id")]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 501)) and [(r["k"], -r["id"]) for r in got] == sorted((r["k"], -r["id"]) for r in got)
    assert reports.numbered(rows.limit(0), [F.col("id")]).count() == 0


def test_reports(spark):
    streams = reports.union(spark.createDataFrame([("a", "odd")], "file string, severity string"), spark.createDataFrame([("a", None, 0.5), (None, "error", None)], "file string, severity string, confidence double"))
    assert {r["file"]: (r["n"], r["error"], r["info"]) for r in reports.by_file(streams).collect()} == {"a": (2, 0, 2), None: (1, 1, 0)}
    assert reports.by_file(streams.limit(0)).count() == 0
    names = spark.createDataFrame([("src/a.py",), ("docs/a.py",), ("a/test_b.py",), ("a/b_spec.js",), ("README.MD",), (None,)], "p string")
    assert [r[0] for r in names.select(reports.left_out(F.col("p"))).collect()] == [False, True, True, True, True, None]


def test_workflow_bounds_its_loops(spark):
    flow = plugins.Workflow({"a": plugins.Step(lambda r: r.withColumn("n", F.col("n") + 1), [("a", "n < need"), ("b", "true")], 4), "b": plugins.Step(lambda r: r, [])}, "a")
    got = {r["need"]: (r["n"], r["state"]) for r in flow(spark.createDataFrame([(0, 1), (0, 3), (0, 99)], "n int, need int")).collect()}
    assert got == {1: (1, "b"), 3: (3, "b"), 99: (4, "b")}
    assert flow(spark.createDataFrame([], "n int, need int")).count() == 0


def test_tree_of_files(spark):
    root = scratch(spark, "tree")
    rows = spark.createDataFrame([("src", "main.py", "import os\nx = 1"), ("build", "b.py", "y"), ("src", "notes.txt", "z")], "dir string, name string, value string")
    rows.write.partitionBy("dir", "name").text(root)
    where = lambda c: F.regexp_replace(c, r"^.*/dir=([^/]+)/name=([^/]+)/.*$", "$1/$2")
    files = repo.scan(spark, root, relative=where)
    assert [(r["path"], r["language"], r["text"]) for r in files.collect()] == [("src/main.py", "python", "import os\nx = 1\n")]
    assert [tuple(r) for r in repo.manifest(files).collect()] == [("python", 1, 2)] and repo.scan(spark, root, relative=where, most=0).count() == 0


def test_flow_of_data(spark):
    files = spark.createDataFrame([("a", None), ("b", ""), ("c", "def f(:"), ("d", "def f(x):\n    return x")], "path string, text string")
    assert [tuple(r)[2:] for r in syntax.flow_edges(syntax.data_flow(files)).collect()] == [("x", 1, 2)]
    assert syntax.early_uses(syntax.data_flow(files)).count() == 0 and syntax.statements(files).count() == 0
    assert syntax.sink_of("cursor.executemany") == "execute" and syntax.sink_of("len") is None


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    whole = {tuple(r) for r in vectors.top_k(rows, rows, 2).collect()}
    block = vectors.BLOCK
    try:
        vectors.BLOCK = 1  # many blocks of queries give the same
        assert {tuple(r) for r in vectors.top_k(rows, rows, 2).collect()} == whole
    finally:
        vectors.BLOCK = block
    assert (1, 2, 1.0, 1) in whole and not any(4 in r[:2] or 5 in r[:2] for r in whole)
    assert vectors.top_k(rows, rows, 2, 0.5).count() == 2


def test_features_count_what_is_missing_as_default(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    names = ["cc", "cognitive", "lines", "params", "nesting", "functions", "class_size", "mi"]
    c = spark.createDataFrame([(1, *[200.0] * 7, 40.0)], "node long, " + ", ".join(f"{n} double" for n in names))
    h = spark.createDataFrame([], "node long, churn double, fixes double, days double, authors double, commit_size double, refactors double, hotspot double, age double")
    got = {r["node"]: r for r in features.enriched(nodes, c, h).collect()}
    assert got[1]["complexity"][0] == 1.0 and got[1]["complexity"][7] == 0.6 and got[2]["complexity"][7] == 0.5
    assert len(features.NAMES) == 32 and got[2]["history"][3] == 0.05


def test_periods_and_weights(spark):
    rows = spark.createDataFrame([("3 days",), ("2 Weeks ago",), ("x weeks",), ("1 month",), (None,)], "t string")
    assert [r[0] for r in rows.select(history.period(F.col("t"))).collect()] == [3, 14, 90, 30, 90]
    days = spark.createDataFrame([(x,) for x in (0, 7, 14, 30, 60, 61, None)], "d int")
    assert [r[0] for r in days.select(history.recency(F.col("d"))).collect()] == [2.0, 1.8, 1.5, 1.2, 1.0, 0.8, 1.0]


def test_empty_tables_elsewhere(spark):
    files = spark.createDataFrame([], "path string, language string, text string")
    for f in (symbols.by_pattern, symbols.imports, symbols.calls, symbols.classes, symbols.block_ends, ingest.commits, ingest.lcov, ingest.traces, ingest.packages, syntax.symbols, syntax.metrics, syntax.taints):
        assert f(files.drop("language") if f in (syntax.symbols, syntax.metrics, syntax.taints) else files).count() == 0, f
    e = spark.createDataFrame([], "user long, kind string, value double, ok boolean, seq long")
    assert votes.tally(e, "user", "kind", "value").count() == votes.weighted(e, "user", "kind", "value").count() == votes.evidence(e, "user", "kind", "ok", "value").count() == 0
    assert findings.keep_first(e, ["user"], [F.col("seq")], "value", "kind").count() == 0 and findings.risk(e, "kind", ["user"]).count() == 0
    assert delta.snapshot(e.select("user", "kind"), e.select("user", "kind"), "user", "kind").count() == 0
    assert paths.with_language(spark.createDataFrame([(None,), ("a.PY",)], "p string"), "p").collect()[1]["language"] == "python"


def test_parsing_is_dealt(spark):
    """The rows of one task's read are parsed in several."""
    files = spark.range(200, numPartitions=1).select(F.col("id").cast("string").alias("path"), F.lit("c").alias("language"), F.lit("def f(a): return a").alias("text"))
    for made in (syntax.symbols(files), syntax.metrics(files), gates.parsed(files, {"text": "p"})):
        assert made.select(F.spark_partition_id().alias("k")).distinct().count() > 1
