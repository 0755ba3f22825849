"""Symbols and calls of Python sources, by the language's own parser."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt

SCHEMA = "path string, name string, kind string, line_start int, line_end int, detail string"


def symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A row per function, class, import and call of each file.

    ``detail`` is the enclosing symbol.  A file that does not parse gives one
    row of kind ``error``; a null text gives none.  One narrow pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast

        names = ["path", "name", "kind", "line_start", "line_end", "detail"]
        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}

        def found(where: str, code: str) -> list[tuple]:
            try:
                todo = [(ast.parse(code), "")]
            except (SyntaxError, ValueError, RecursionError) as e:
                line = getattr(e, "lineno", None) or 0
                return [(where, type(e).__name__, "error", line, line, "")]
            out = []
            while todo:
                node, inside = todo.pop()
                kind, own = kinds.get(type(node)), inside
                if kind:
                    own = f"{inside}.{node.name}".lstrip(".")
                    out.append((where, node.name, kind, node.lineno, node.end_lineno, inside))
                elif isinstance(node, (ast.Import, ast.ImportFrom)):
                    module = getattr(node, "module", None)
                    out += [(where, f"{module}.{a.name}" if module else a.name, "import", node.lineno, node.end_lineno, inside) for a in node.names]
                elif isinstance(node, ast.Call):
                    out.append((where, ast.unparse(node.func), "call", node.lineno, node.end_lineno, inside))
                todo += [(child, own) for child in ast.iter_child_nodes(node)]
            return out

        for batch in batches:
            rows = [r for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in found(p, t)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds_of = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)], names=names)

    own = files.where(F.col(text).isNotNull()).select(F.col(path).cast("string"), F.col(text).cast("string"))
    return dealt(own).mapInArrow(run, SCHEMA)


#: Calls that bring in values not to be trusted, with their kind.
SOURCES = {
    "input": "user_input", "raw_input": "user_input", "sys.argv": "user_input", "request.get": "user_input", "request.post": "user_input", "request.args": "user_input", "request.form": "user_input",
    "urllib.request": "network", "requests.get": "network", "requests.post": "network", "socket.recv": "network", "open": "file", "io.open": "file", "file.read": "file",
    "cursor.execute": "database", "db.query": "database", "os.getenv": "environment", "os.environ": "environment", "pickle.load": "serialized", "yaml.load": "serialized",
}
#: What must not get such values; a call is of the first kind whose text
#: its name contains.
SINKS = {
    "execute": "sql_query", "executemany": "sql_query", "raw": "sql_query", "eval": "code_execution", "exec": "code_execution", "compile": "code_execution",
    "os.system": "command_execution", "subprocess.call": "command_execution", "subprocess.run": "command_execution", "subprocess.Popen": "command_execution",
    "open": "file_write", "write": "file_write", "requests.get": "network_request", "requests.post": "network_request", "urllib.request": "network_request",
}
#: Words in the name of a call that makes a value safe.
SANITISERS = ["escape", "quote", "sanitize", "clean", "validate", "filter", "strip", "html.escape", "urllib.parse.quote", "shlex.quote"]


def sink_of(name: str) -> str | None:
    """The first sink text that is in a call's name."""
    return next((s for s in SINKS if s in name), None)


def _per_function(files: DataFrame, of, schema: str, types: list, path: str = "path", text: str = "text") -> DataFrame:
    """Rows of ``of(function node)`` after (path, function), for each function of
    each file that parses; one narrow pass in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast

        for batch in batches:
            rows = []
            for where, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    tree = ast.parse(code)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows += [(where, node.name, *r) for r in of(node)]
            all_types = [pa.string(), pa.string(), *types]
            columns = list(zip(*rows, strict=True)) or [()] * len(all_types)
            names = ["path", "function", *(c.split()[0] for c in schema.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, all_types, strict=True)], names=names)

    own = files.where(F.col(text).isNotNull()).select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    return dealt(own).mapInArrow(run, f"path string, function string, {schema}")


def metrics(files: DataFrame) -> DataFrame:
    """(path, name, cc, cognitive, nesting, params, n_lines) per function: cc is 1,
    plus each branch, loop, handler and context, plus the further operands of
    each and / or; cognitive counts if and loops; nesting is the deepest of these."""

    def of(function):
        import ast

        nest, branch = (ast.If, ast.For, ast.While, ast.AsyncFor), (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith)
        cc, cognitive, deepest, todo = 1, 0, 0, [(c, 0) for c in ast.iter_child_nodes(function)]
        while todo:
            node, depth = todo.pop()
            cc += isinstance(node, branch) + (len(node.values) - 1 if isinstance(node, ast.BoolOp) else 0)
            inner = depth + isinstance(node, nest)
            cognitive, deepest = cognitive + isinstance(node, nest), max(deepest, inner)
            other = node.orelse if isinstance(node, ast.If) and len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) else []
            todo += [(c, depth if c in other else inner) for c in ast.iter_child_nodes(node)]
        a = function.args
        yield cc, cognitive, deepest, len(a.posonlyargs + a.args + a.kwonlyargs), function.end_lineno - function.lineno + 1

    out = _per_function(files, of, "cc int, cognitive int, nesting int, params int, n_lines int", [pa.int32()] * 5)
    return out.withColumnRenamed("function", "name")


def flow(files: DataFrame) -> DataFrame:
    """(path, function, src, dst, kind): control flow between the statements of
    each function, by their lines; 0 is the exit.  An exception may leave every
    statement of a try body for its handlers."""

    def of(function):
        import ast

        edges, leave = [], []

        def link(ends, to):
            edges.extend((src, to, kind) for src, kind in ends)

        def block(body, ends, loop):
            for s in body:
                if not ends:
                    break  # not reached
                back = isinstance(s, (ast.For, ast.AsyncFor, ast.While))
                link(ends, s.lineno)
                ends = [(s.lineno, "next")]
                if isinstance(s, ast.If):
                    ends = block(s.body, [(s.lineno, "true")], loop) + block(s.orelse, [(s.lineno, "false")], loop)
                elif back:
                    own = {"break": [], "continue": []}
                    inner = block(s.body, [(s.lineno, "true")], own)
                    link([(x, "loop" if k == "next" else k) for x, k in inner + own["continue"]], s.lineno)
                    ends = own["break"] + block(s.orelse, [(s.lineno, "false")], loop)
                elif isinstance(s, (ast.With, ast.AsyncWith)):
                    ends = block(s.body, ends, loop)
                elif isinstance(s, ast.Try):
                    raised = [(x.lineno, "except") for x in s.body]
                    ends = block(s.orelse, block(s.body, ends, loop), loop) if s.orelse else block(s.body, ends, loop)
                    for h in s.handlers:
                        link(raised, h.lineno)
                        ends = ends + block(h.body, [(h.lineno, "next")], loop)
                    ends = block(s.finalbody, ends, loop)
                elif isinstance(s, (ast.Return, ast.Raise)):
                    leave.append((s.lineno, type(s).__name__.lower()))
                    ends = []
                elif isinstance(s, (ast.Break, ast.Continue)) and loop is not None:
                    kind = type(s).__name__.lower()
                    loop[kind].append((s.lineno, kind))
                    ends = []
            return ends

        link(block(function.body, [(function.lineno, "next")], None) + leave, 0)
        return edges

    return _per_function(files, of, "src int, dst int, kind string", [pa.int32(), pa.int32(), pa.string()])


def dominators(edges: DataFrame) -> DataFrame:
    """(path, function, node, dominator): the closest other node on every way from
    the entry.  A function's edges are one small group."""

    def of(keys, frame):
        import pandas as pd

        entry, before = frame["src"].iloc[0], {}
        nodes = set(frame["src"]) | set(frame["dst"])
        for a, b in zip(frame["src"], frame["dst"], strict=True):
            before.setdefault(b, set()).add(a)
        entry = next(iter(nodes - set(before)), entry)
        dom, changed = {n: nodes if n != entry else {entry} for n in nodes}, True
        while changed:
            changed = False
            for n in nodes - {entry}:
                new = {n} | set.intersection(*(dom[p] for p in before[n]))
                changed, dom[n] = changed or new != dom[n], new
        rows = [(*keys, n, max(dom[n] - {n}, key=lambda x: len(dom[x]))) for n in nodes if n != entry]
        return pd.DataFrame(rows, columns=["path", "function", "node", "dominator"])

    return edges.groupBy("path", "function").applyInPandas(of, "path string, function string, node int, dominator int")


def taints(files: DataFrame) -> DataFrame:
    """(path, function, source, sink, line_no, sanitised): values of a source call
    that reach an argument of a sink call in the same function, through
    assignments and calls.  ``sanitised`` where every value that reaches the
    sink went through a call named like a sanitiser."""

    def of(function):
        import ast

        known: dict[str, set] = {}  # variable: (source, safe)
        found = set()

        def value(node) -> set:
            if isinstance(node, ast.Name):
                return known.get(node.id, set())
            got = set().union(*map(value, ast.iter_child_nodes(node)))
            if isinstance(node, ast.Call):
                name = ast.unparse(node.func)
                if sink_of(name):
                    found.update((src, sink_of(name), node.lineno, safe) for src, safe in got)
                if any(w in name.lower() for w in SANITISERS):
                    got = {(src, True) for src, _ in got}
                if name in SOURCES:
                    got = got | {(name, False)}
            return got

        for _ in range(2):  # a second pass for values carried round a loop
            for node in sorted((n for n in ast.walk(function) if isinstance(n, ast.stmt) and n is not function), key=lambda n: (n.lineno, n.col_offset)):
                if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and node.value is not None:
                    got = value(node.value)
                    for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                        for n in ast.walk(t):
                            if isinstance(n, ast.Name) and got:
                                known[n.id] = known.get(n.id, set()) | got
                elif isinstance(node, (ast.Expr, ast.Return)) and node.value is not None:
                    value(node.value)
                elif isinstance(node, (ast.If, ast.While)):
                    value(node.test)
                elif isinstance(node, (ast.For, ast.AsyncFor)):
                    got = value(node.iter)
                    for n in ast.walk(node.target):
                        if isinstance(n, ast.Name) and got:
                            known[n.id] = known.get(n.id, set()) | got
                elif isinstance(node, (ast.With, ast.AsyncWith)):
                    for item in node.items:
                        value(item.context_expr)
        sinks = {(src, sink, line) for src, sink, line, _ in found}
        return [(*s, all(safe for *k, safe in found if tuple(k) == s)) for s in sorted(sinks)]

    return _per_function(files, of, "source string, sink string, line_no int, sanitised boolean", [pa.string(), pa.string(), pa.int32(), pa.bool_()])


def statements(files: DataFrame) -> DataFrame:
    """(path, function, kind, line_no, end_line) of the loops, conditions and exception
    handlings of each function."""

    def of(function):
        import ast

        kinds = {ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.If: "condition", ast.Try: "exception"}
        return [(kinds[type(n)], n.lineno, n.end_lineno) for n in ast.walk(function) if type(n) in kinds]

    return _per_function(files, of, "kind string, line_no int, end_line int", [pa.string(), pa.int32(), pa.int32()])


def data_flow(files: DataFrame) -> DataFrame:
    """(path, function, name, kind, line_no) of the variables of each function: ``def``
    where one is set (arguments too), ``use`` where one is read."""

    def of(function):
        import ast

        rows = [(a.arg, "def", function.lineno) for a in ast.walk(function.args) if isinstance(a, ast.arg)]
        rows += [(n.id, "use" if isinstance(n.ctx, ast.Load) else "def", n.lineno) for n in ast.walk(function) if isinstance(n, ast.Name)]
        return rows

    return _per_function(files, of, "name string, kind string, line_no int", [pa.string(), pa.string(), pa.int32()])


def flow_edges(flow: DataFrame) -> DataFrame:
    """(path, function, name, def_line, use_line): each use with the last definition at
    or before it by line, which is what straight code does; ``dataflow`` follows branches
    and loops."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "function", "name").orderBy("line_no", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == "def", F.col("line_no")), ignorenulls=True).over(w)
    out = flow.withColumn("def_line", last).where("kind = 'use' and def_line is not null")
    return out.select("path", "function", "name", "def_line", F.col("line_no").alias("use_line"))


def early_uses(flow: DataFrame) -> DataFrame:
    """(path, function, name, line_no, def_line): uses above the last definition of their
    name: one aggregate of the definitions, one join by name."""
    keys = ["path", "function", "name"]
    last = flow.where("kind = 'def'").groupBy(*keys).agg(F.max("line_no").alias("def_line"))
    return flow.where("kind = 'use'").join(last, keys).where("line_no < def_line").select(*keys, "line_no", "def_line")


def file_metrics(per_function: DataFrame) -> DataFrame:
    """(path, functions, cc, cognitive, nesting) of files from ``metrics``: 1 and what
    each function adds, the deepest nesting."""
    return per_function.groupBy("path").agg(F.count(F.lit(1)).alias("functions"), (F.sum(F.col("cc") - 1) + 1).alias("cc"), F.sum("cognitive").alias("cognitive"), F.max("nesting").alias("nesting"))


def suggestions(per_function: DataFrame, complex_from: int = 10, long_from: int = 50, parameters: int = 5) -> DataFrame:
    """(path, name, suggestion) for functions over a threshold."""
    tests = [("split up", F.col("cc") > complex_from), ("shorten", F.col("n_lines") > long_from), ("group parameters", F.col("params") > parameters)]
    found = F.filter(F.array(*[F.when(t, n) for n, t in tests]), lambda x: x.isNotNull())
    return per_function.select("path", "name", F.explode(found).alias("suggestion"))


def signatures(files: DataFrame) -> DataFrame:
    """(path, function, line_no, signature, parameters) of each function, the parameters
    as an array of names."""

    def of(function):
        import ast

        args = [a.arg for a in ast.walk(function.args) if isinstance(a, ast.arg)]
        yield function.lineno, f"def {function.name}({ast.unparse(function.args)})", args

    return _per_function(files, of, "line_no int, signature string, parameters array<string>", [pa.int32(), pa.string(), pa.list_(pa.string())])


def null_uses(files: DataFrame) -> DataFrame:
    """(path, function, name, line_no) of attributes and items taken from a variable
    whose last assignment above, in the same run of statements, is None: what is meant
    by a null check, not a proof.  Races between threads are not looked for."""

    def of(function):
        import ast

        rows = []

        def run(body):
            empty: set[str] = set()
            for s in body:
                for node in ast.walk(s):
                    base = node.value if isinstance(node, (ast.Attribute, ast.Subscript)) else None
                    if isinstance(base, ast.Name) and base.id in empty:
                        rows.append((base.id, node.lineno))
                for node in ast.walk(s):
                    if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
                        empty.discard(node.id)
                if isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant) and s.value.value is None:
                    empty.update(t.id for t in s.targets if isinstance(t, ast.Name))
                for inner in ("body", "orelse", "finalbody"):
                    run(getattr(s, inner, None) or [])

        run(function.body)
        return sorted(set(rows))

    return _per_function(files, of, "name string, line_no int", [pa.string(), pa.int32()])


def calls_of(files: DataFrame) -> DataFrame:
    """(path, function, call, line_no, kind): calls that are sources or sinks."""

    def of(function):
        import ast

        rows = []
        for node in ast.walk(function):
            if isinstance(node, ast.Call):
                name = ast.unparse(node.func)
                rows += [(name, node.lineno, "source")] * (name in SOURCES) + [(name, node.lineno, "sink")] * (sink_of(name) is not None)
        return rows

    return _per_function(files, of, "call string, line_no int, kind string", [pa.string(), pa.int32(), pa.string()])
