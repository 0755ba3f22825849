"""Queries on small texts with known results: sources, logs, tool output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, symbols, syntax
from ..sources.tables import table
from .catalogue import query


def golden(columns: str, *rows: tuple) -> str:
    """The rows a query must give for each supplier, as SQL: ``§`` stands for its key."""
    value = lambda x: "null" if x is None else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    names = columns.split(", ")
    text = [any(isinstance(r[i], str) for r in rows) for i in range(len(names))]
    picked = [f"s_suppkey || '/' || {n} as {n}" if n == "path" else f"replace({n}, '§', s_suppkey::varchar) as {n}" if t else n for n, t in zip(names, text, strict=True)]
    return f"select {', '.join(picked)} from (values {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v({columns}), supplier"


def keyed(spark, d, rows, schema: str):
    """Given rows once for each supplier: its key is before each path and stands for
    each ``§``.  The rows given are constant, so they are what is broadcast."""
    given = spark.createDataFrame(rows, schema)
    out = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("__k")).crossJoin(F.broadcast(given))
    columns = [F.concat_ws("/", "__k", "path").alias("path") if f.name == "path" else F.replace(f.name, F.lit("§"), F.col("__k")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in given.schema]
    return out.select(*columns)


FILES = [
    ("a.py", "python", "import os.path as p\nfrom m§ import x as y, z\n\nclass A§(B, C):\n    def f(self):\n        return p.join(1, 2)\n    async def g(self):\n        pass\n\ndef h(n):\n    if n:\n        # note\n        go§(n, 3)\n    return 1\n"),
    ("b.js", "javascript", "import {a, b as c} from 'lib'\nimport D from \"d\"\nexport class E {\n}\nfunction f(x) {\n  if (x) { c(x) }\n}\nconst g = (y) => y\n"),
    ("c.rs", "rust", "use std::io;\npub struct S {\n}\nenum T {\n}\npub(crate) fn f() {\n}\ntrait U {\n}\n"),
    ("d.go", "go", "import \"fmt\"\ntype S struct {\n}\ntype I interface {\n}\nfunc F() {\n}\nfunc (s S) M() {\n}\n"),
    ("E.java", "java", "import java.util.List;\npublic class E {\n    public static int f(int x) {\n    }\n}\n"),
    ("n.py", "python", None),
]


def _files(spark, d):
    return keyed(spark, d, FILES, "path string, language string, text string")


def _texts(spark, d, *rows):
    return keyed(spark, d, [*rows, ("empty", ""), ("null", None)], "path string, text string")


@query(golden("path, line_no, kind, name", ("a.py", 4, "class", "A§"), ("a.py", 5, "method", "f"), ("a.py", 7, "method", "g"), ("a.py", 10, "function", "h"), ("b.js", 3, "class", "E"), ("b.js", 5, "function", "f"), ("b.js", 8, "function", "g"),
    ("c.rs", 1, "import", "std::io"), ("c.rs", 2, "struct", "S"), ("c.rs", 4, "enum", "T"), ("c.rs", 6, "function", "f"), ("c.rs", 8, "trait", "U"), ("d.go", 1, "import", "fmt"), ("d.go", 2, "struct", "S"), ("d.go", 4, "interface", "I"), ("d.go", 6, "function", "F"), ("d.go", 8, "method", "M"),
    ("E.java", 1, "import", "java.util.List"), ("E.java", 2, "class", "E"), ("E.java", 3, "method", "f")))
def pattern_symbols(spark, d):
    return symbols.by_pattern(_files(spark, d))


@query(golden("path, line_no, module, name", ("a.py", 1, "os.path", "p"), ("a.py", 2, "m§", "y"), ("a.py", 2, "m§", "z"), ("b.js", 1, "lib", "a"), ("b.js", 1, "lib", "c"), ("b.js", 2, "d", "D")))
def import_rows(spark, d):
    return symbols.imports(_files(spark, d))


@query(golden("path, line_no, receiver, name, args", ("a.py", 6, "p", "join", "1,2"), ("a.py", 13, "", "go§", "n,3"), ("b.js", 6, "", "c", "x")))
def call_rows(spark, d):
    return symbols.calls(_files(spark, d))


@query(golden("path, class, bases, methods", ("a.py", "A§", "B, C", "f,g")))
def class_hierarchy(spark, d):
    return symbols.classes(_files(spark, d))


@query(golden("path, line_no, end_line", ("a.py", 4, 8), ("a.py", 5, 6), ("a.py", 7, 8), ("a.py", 10, 14), ("a.py", 11, 13)))
def block_ends(spark, d):
    return symbols.block_ends(_files(spark, d))


@query(golden("path, importer", ("m.py", "§/a.py")))
def importer_lookup(spark, d):
    """Files that import a file's stem: an equi-join on the module."""
    stems = keyed(spark, d, [("m.py", "m§"), ("q.py", "q§")], "path string, module string")
    used = symbols.imports(_files(spark, d)).select("module", F.col("path").alias("importer")).distinct()
    return stems.join(used, "module").select("path", "importer")


LOG = "abc1234|Ann|2024-03-01T10:00:00|first\n3\t1\tx§.py\n-\t-\tlogo.png\n\ndef5678|Bob|2024-03-02T10:00:00|second | part\n10\t0\tx§.py\n"


@query(golden("commit, author, day, file, changed", ("abc1234", "Ann", "2024-03-01", "x§.py", 4), ("abc1234", "Ann", "2024-03-01", "logo.png", 0), ("def5678", "Bob", "2024-03-02", "x§.py", 10)))
def commit_log(spark, d):
    return ingest.commits(_texts(spark, d, ("log", LOG)))


@query(golden("file, last", ("x§.py", "2024-03-02")))
def changed_since(spark, d):
    """Distinct files of the commits since a day."""
    return ingest.commits(_texts(spark, d, ("log", LOG))).where("day >= '2024-03-02'").groupBy("file").agg(F.max("day").alias("last"))


_C1, _C2 = "a" * 40, "b" * 40


@query(golden("path, line_no, commit, author, time, content", ("f", 1, _C1, "Ann", 100, "x = 1"), ("f", 2, _C2, "Bob", 200, "author = 3")))
def blame_lines(spark, d):
    return ingest.blame(_texts(spark, d, ("f", f"{_C1} 1 1 1\nauthor Ann\nauthor-time 100\n\tx = 1\n{_C2} 5 2\nauthor Bob\nauthor-time 200\n\tauthor = 3\n")))


SCAN = '{"results": [{"check_id": "py.sql", "path": "x§.py", "start": {"line": 3}, "extra": {"severity": "ERROR", "message": "a"}}, {"check_id": "py.performance.loop", "path": "y.py", "start": {"line": 9}, "extra": {"severity": "odd", "message": "b"}}, {"check_id": "z", "path": "x.py", "start": {"line": 4}, "extra": {"severity": "info", "message": "c", "metadata": {"category": "style"}}}]}'


@query(golden("file, line_no, rule, severity, category, message", ("x§.py", 3, "py.sql", "ERROR", "security", "a"), ("y.py", 9, "py.performance.loop", "WARNING", "performance", "b"), ("x.py", 4, "z", "INFO", "style", "c")))
def scanner_findings(spark, d):
    return ingest.scan_findings(_texts(spark, d, ("s.json", SCAN), ("bad", "{")))


@query(golden("file, n_lines, hit, functions, called, percent", ("x§.c", 3, 2, 2, 1, 66.6667), ("y.c", 0, 0, 0, 0, 0.0)))
def lcov_records(spark, d):
    return ingest.lcov(_texts(spark, d, ("l", "TN:\nSF:x§.c\nFN:1,f\nFN:9,g\nFNDA:4,f\nFNDA:0,g\nDA:1,1\nDA:2,0\nDA:3,7\nend_of_record\nSF:y.c\nend_of_record\n")))


@query(golden("path, execs_done, bitmap_cvg, missing", ("s", 1200.0, 3.5, 0.0), ("empty", 0.0, 0.0, 0.0)))
def fuzzer_statistics(spark, d):
    return ingest.key_values(_texts(spark, d, ("s", "execs_done        : 1200\nbitmap_cvg : 3.50%\nodd line\n")), ["execs_done", "bitmap_cvg", "missing"])


@query(golden("id, signal, kind, op", ("000001", 11, "segmentation", "havoc§"), ("000002", 99, "unknown", None), (None, -1, "unknown", None)))
def crash_names(spark, d):
    rows = keyed(spark, d, [("id:000001,sig:11,src:000000,op:havoc§",), ("id:000002,sig:99",), ("plain",)], "name string")
    return rows.select(ingest.crash_name(F.col("name")).alias("c")).select("c.*").fillna(-1, ["signal"])


_TRACE = "==1==ERROR: AddressSanitizer: {0} on address 0x1\n    #0 0x1 in ?? (lib)\n    #1 0x2 in {1}(char*) x.c:3\n    #2 0x3 in main x.c:9\nSUMMARY: AddressSanitizer: {0}\n    #9 0x9 in other\n"


@query(golden("kind, frame, n, path, severity", ("heap-buffer-overflow", "parse§", 2, "1", "critical"), ("SEGV", "run§", 1, "3", "high")))
def crash_dedup(spark, d):
    found = ingest.traces(_texts(spark, d, ("2", _TRACE.format("heap-buffer-overflow", "parse§")), ("1", _TRACE.format("heap-buffer-overflow", "parse§")), ("3", _TRACE.format("SEGV", "run§")), ("4", "no error")))
    return ingest.unique_crashes(found).drop("crash")


@query(golden("path, covered, statements, percent", ("c", 8, 10, 80.0), ("d", 0, 0, 0.0)))
def coverage_json(spark, d):
    found = ingest.coverage_totals(_texts(spark, d, ("c", '{"totals": {"covered_lines": 8, "num_statements": 10, "percent_covered": 80.0}}'), ("d", "{}")))
    return found.where(F.col("path").rlike("/[cd]$"))


@query(golden("path, package", ("requirements.txt", "numpy§"), ("requirements.txt", "pandas"), ("w/package.json", "left"), ("w/package.json", "jest"), ("Cargo.toml", "serde"), ("Cargo.toml", "tokio-util")))
def package_manifest(spark, d):
    return ingest.packages(_texts(spark, d, ("requirements.txt", "numpy§==1.2\n# note\npandas >= 2\n-r other.txt\n"), ("w/package.json", '{"dependencies": {"left": "1"}, "devDependencies": {"jest": "2", "left": "1"}}'), ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1"\ntokio-util = { version = "1" }\n')))


PROGRAM = """import os
def safe(a):
    return a
def f(n, m):
    q = input()
    if n and m:
        for i in range(n):
            q = q + str(i)
    elif n:
        os.system(q)
    else:
        with open(n) as h:
            pass
    return q
def g§(x):
    s = safe(escape(input()))
    eval(s)
"""


@query(golden("name, cc, cognitive, nesting, params, n_lines", ("safe", 1, 0, 0, 1, 2), ("f", 6, 3, 2, 2, 11), ("g§", 1, 0, 0, 1, 3)))
def ast_metrics(spark, d):
    return syntax.metrics(_texts(spark, d, ("p.py", PROGRAM), ("broken.py", "def f("))).drop("path")


@query(golden("function, source, sink, line_no, sanitised", ("f", "input", "os.system", 10, False), ("g§", "input", "eval", 17, True)).replace("False", "false").replace("True", "true"))
def taint_paths(spark, d):
    return syntax.taints(_texts(spark, d, ("p.py", PROGRAM), ("broken.py", "def f("))).drop("path")


LOOP = "def f(x):\n    a = 1\n    while x:\n        if a:\n            break\n        a = 2\n    return a\n"


@query(golden("src, dst, kind", (1, 2, "next"), (2, 3, "next"), (3, 4, "true"), (4, 5, "true"), (4, 6, "false"), (5, 7, "break"), (6, 3, "loop"), (3, 7, "false"), (7, 0, "return")))
def control_flow(spark, d):
    return syntax.flow(_texts(spark, d, ("l.py", LOOP))).select("src", "dst", "kind")


@query(golden("node, dominator", (2, 1), (3, 2), (4, 3), (5, 4), (6, 4), (7, 3), (0, 7)))
def dominators(spark, d):
    return syntax.dominators(syntax.flow(_texts(spark, d, ("l.py", LOOP)))).select("node", "dominator")
