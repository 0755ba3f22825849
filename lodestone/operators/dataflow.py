"""Definitions and uses of variables, and taints that cross functions.

A function's control flow is a small graph of statements.  Which definitions reach a
statement follows from what each statement sets and overwrites: sets of definitions, as
the bits of a number, go along the edges until none grows.  This needs one function at
a time, so it is one narrow pass over the files.

Between functions, what an argument does inside a function is summed up in edges: to
the function's result, and to the arguments of the functions that it calls.  These
summaries are tables; they are joined along the calls until nothing new is found.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .syntax import SANITISERS, SOURCES, _per_function, sink_of


def _names(node, kind) -> list:
    """Names of a context in an expression or target, in order, without those that
    belong to a lambda, a comprehension or a function inside it."""
    import ast

    found, todo = [], [(node, frozenset())]
    while todo:
        n, hidden = todo.pop()
        if isinstance(n, ast.Name):
            if isinstance(n.ctx, kind) and n.id not in hidden:
                found.append(n)
            continue
        if isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            hidden |= {x.id for g in n.generators for x in ast.walk(g.target) if isinstance(x, ast.Name)}
        elif isinstance(n, (ast.Lambda, ast.FunctionDef, ast.AsyncFunctionDef)):
            hidden |= {a.arg for a in ast.walk(n.args) if isinstance(a, ast.arg)}
            if not isinstance(n, ast.Lambda):
                hidden |= {x.id for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
        todo += [(c, hidden) for c in reversed(list(ast.iter_child_nodes(n)))]
    return found


class FlowGraph:
    """The statements of a function as nodes: ``lines``, ``parts`` (the expressions that a
    node evaluates), ``sets`` (names it defines) and ``after``, the nodes that may follow.
    ``raises``: nodes a failure in which may lead to a handler."""

    def __init__(self, function):
        import ast

        self.lines, self.parts, self.sets, self.after, self.raises = [], [], [], [], []
        self.values: dict[int, list] = {}  # what a node's names take, where that is not what it evaluates
        self.exits: list[int] = []
        self.returns: dict[int, object] = {}
        entry = self._node(function.lineno, [], [a.arg for a in ast.walk(function.args) if isinstance(a, ast.arg)])
        self.exits = self._block(function.body, [entry], None, []) + self.exits

    def _node(self, line: int, parts: list, sets: list) -> int:
        import ast

        self.lines.append(line)
        self.parts.append([p for p in parts if p is not None])
        self.sets.append([*sets, *(n.target.id for p in parts if p is not None for n in ast.walk(p) if isinstance(n, ast.NamedExpr))])
        self.after.append(set())
        return len(self.lines) - 1

    def _block(self, body: list, ends: list, loop: dict | None, tries: list) -> list:
        for s in body:
            if not ends:
                break  # not reached
            first = len(self.lines)
            ends = self._statement(s, ends, loop, tries)
            for own in tries:  # any of these may fail before or after it sets a name
                own.extend(range(first, len(self.lines)))
        return ends

    def _step(self, ends: list, line: int, parts: list, sets: list) -> int:
        n = self._node(line, parts, sets)
        for e in ends:
            self.after[e].add(n)
        return n

    def _statement(self, s, ends: list, loop: dict | None, tries: list) -> list:
        import ast

        bound = lambda t: [n.id for n in _names(t, (ast.Store, ast.Del))]
        if isinstance(s, (ast.If, ast.While)):
            head = self._step(ends, s.lineno, [s.test], [])
            if isinstance(s, ast.If):
                return self._block(s.body, [head], loop, tries) + (self._block(s.orelse, [head], loop, tries) if s.orelse else [head])
            return self._loop(s, head, [head], tries)
        if isinstance(s, (ast.For, ast.AsyncFor)):
            head = self._step([self._step(ends, s.lineno, [s.iter], [])], s.lineno, [], [])
            each = self._step([head], s.lineno, [], bound(s.target))
            self.values[each] = [s.iter]
            return self._loop(s, head, [each], tries)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            sets = [n for i in s.items if i.optional_vars for n in bound(i.optional_vars)]
            return self._block(s.body, [self._step(ends, s.lineno, [i.context_expr for i in s.items], sets)], loop, tries)
        if isinstance(s, (ast.Try, ast.TryStar)):
            own: list[int] = []
            was, self.exits = self.exits, []
            ends = self._block(s.body, ends, loop, [*tries, own])
            ends = self._block(s.orelse, ends, loop, tries)
            for h in s.handlers:
                head = self._node(h.lineno, [h.type], [h.name] if h.name else [])
                self.raises += [(n, head) for n in own]
                ends = ends + self._block(h.body, [head], loop, tries)
            if s.finalbody:  # a return on the way leaves through it
                first = len(self.lines)
                ends = self._block(s.finalbody, ends + self.exits, loop, tries)
                self.exits = ends if self.exits and len(self.lines) > first else []
            self.exits = was + self.exits
            return ends
        if isinstance(s, ast.Match):
            head = self._step(ends, s.lineno, [s.subject], [])
            out, whole = [], False
            for c in s.cases:
                names = [n.name for n in ast.walk(c.pattern) if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name] + [n.rest for n in ast.walk(c.pattern) if isinstance(n, ast.MatchMapping) and n.rest]
                whole = whole or (isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None)
                case = self._step([head], c.pattern.lineno, [c.guard], names)
                self.values[case] = [s.subject]
                out += self._block(c.body, [case], loop, tries)
            return out if whole else [*out, head]
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return [self._step(ends, s.lineno, [s], [s.name])]
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            return [self._step(ends, s.lineno, [], [(a.asname or a.name).split(".")[0] for a in s.names])]
        if isinstance(s, (ast.Return, ast.Raise)):
            n = self._step(ends, s.lineno, [s], [])
            if isinstance(s, ast.Return):
                self.exits.append(n)
                self.returns[n] = s.value
            return []
        if isinstance(s, (ast.Break, ast.Continue)):
            n = self._step(ends, s.lineno, [], [])
            if loop is not None:
                loop[type(s).__name__].append(n)
            return []
        sets = [n.id for n in _names(s, (ast.Store, ast.Del))] if not (isinstance(s, ast.AnnAssign) and s.value is None) else []
        if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
            return [self._step(ends, s.lineno, [s.value, ast.Name(s.target.id, ast.Load(), lineno=s.lineno)], sets)]
        return [self._step(ends, s.lineno, [s], sets)]

    def _loop(self, s, head: int, start: list, tries: list) -> list:
        own: dict[str, list] = {"Break": [], "Continue": []}
        for e in self._block(s.body, start, own, tries) + own["Continue"]:
            self.after[e].add(head)
        return own["Break"] + (self._block(s.orelse, [head], None, tries) if s.orelse else [head])

    def uses(self, n: int) -> list[str]:
        import ast

        return list(dict.fromkeys(x.id for p in self.parts[n] for x in _names(p, ast.Load)))

    def reaching(self) -> tuple[list, list]:
        """The definitions as (node, name), and for each node the bits of those that reach it."""
        made = [(n, name) for n, names in enumerate(self.sets) for name in dict.fromkeys(names)]
        of: dict[str, int] = {}
        gen = [0] * len(self.lines)
        for bit, (n, name) in enumerate(made):
            of[name] = of.get(name, 0) | 1 << bit
            gen[n] |= 1 << bit
        kept = [~0] * len(self.lines)
        for n, name in made:
            kept[n] &= ~of[name]
        came, todo = [0] * len(self.lines), list(range(len(self.lines)))
        fails: dict[int, list] = {}
        for n, handler in self.raises:
            fails.setdefault(n, []).append(handler)
        queued = set(todo)
        while todo:
            n = todo.pop()
            queued.discard(n)
            left = gen[n] | came[n] & kept[n]
            for to, bits in [(x, left) for x in self.after[n]] + [(x, left | came[n]) for x in fails.get(n, ())]:
                if bits & ~came[to]:
                    came[to] |= bits
                    if to not in queued:
                        queued.add(to)
                        todo.append(to)
        return made, came


def reaching_definitions(files: DataFrame) -> DataFrame:
    """(path, function, name, def_line, use_line): each use of a variable with every
    definition that reaches it on some way through the function, arguments too; names
    that the function does not define give no rows.  A file that does not parse gives
    none."""

    def of(function):
        import ast

        g = FlowGraph(function)
        made, came = g.reaching()
        rows = set()
        for n, bits in enumerate(came):
            walrus = {x.target.id for p in g.parts[n] for x in ast.walk(p) if isinstance(x, ast.NamedExpr)}
            for name in g.uses(n):
                rows |= {(name, g.lines[d], g.lines[n]) for bit, (d, x) in enumerate(made) if x == name and (bits >> bit & 1 or (d == n and name in walrus))}
        return sorted(rows)

    return _per_function(files, of, "name string, def_line int, use_line int", [pa.string(), pa.int32(), pa.int32()])


_FLOW = "line int, src_kind string, src string, src_line int, dst_kind string, dst string, dst_line int, callee string, steps int, safe boolean"


def _safe_name(name: str) -> bool:
    return any(w in name.lower() for w in SANITISERS)


def local_flows(files: DataFrame) -> DataFrame:
    """(path, function, line, src_kind, src, src_line, dst_kind, dst, dst_line, callee,
    steps, safe): how values flow inside each function.  From an argument (``param``, its
    number), a ``source`` call or the ``result`` of a call to a named function (place:name),
    to the function's ``return``, a ``sink`` call or an ``argument`` (place:number) of a
    call; the fewest uses of variables on the way; ``safe`` if a call named like a
    sanitiser is on it."""

    def of(function):
        import ast

        g = FlowGraph(function)
        made, came = g.reaching()
        bits_of: dict[str, list] = {}
        for bit, (_, name) in enumerate(made):
            bits_of.setdefault(name, []).append(bit)
        held: list[dict] = [{} for _ in made]  # by definition: (origin, safe) -> steps
        found: dict[tuple, int] = {}
        for i, a in enumerate([*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs]):
            for bit in bits_of.get(a.arg, []):
                if made[bit][0] == 0:
                    held[bit][("param", str(i), g.lines[0]), False] = 0

        def merged(into: dict, other: dict, more: int = 0) -> bool:
            grew = False
            for k, steps in other.items():
                if into.get(k, 1 << 30) > steps + more:
                    into[k], grew = steps + more, True
            return grew

        def value(node, n: int) -> dict:
            out: dict = {}
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                return out
            if isinstance(node, ast.Name):
                for bit in bits_of.get(node.id, []):
                    if came[n] >> bit & 1:
                        merged(out, held[bit], 1)
                return out
            if not isinstance(node, ast.Call):
                for c in ast.iter_child_nodes(node):
                    merged(out, value(c, n))
                return out
            name, site = ast.unparse(node.func), f"{node.lineno}.{node.col_offset}"
            given = [(str(i), value(a, n)) for i, a in enumerate(node.args)] + [(k.arg or "**", value(k.value, n)) for k in node.keywords]
            plain = isinstance(node.func, ast.Name)
            for number, own in given:
                for (origin, safe), steps in own.items():
                    if sink_of(name):
                        key = (*origin, "sink", sink_of(name), node.lineno, None, safe)
                        found[key] = min(found.get(key, steps), steps)
                    if plain:
                        key = (*origin, "argument", f"{site}:{number}", node.lineno, name, safe)
                        found[key] = min(found.get(key, steps), steps)
                if not plain:
                    merged(out, own)
            if plain:
                out[("result", f"{site}:{name}", node.lineno), False] = 0
            else:
                merged(out, value(node.func, n))
                if _safe_name(name):
                    out = {(origin, True): steps for (origin, _), steps in sorted(out.items(), reverse=True)}
            if name in SOURCES:
                out[("source", name, node.lineno), False] = 0
            return out

        grew = True
        while grew:
            grew = False
            for n in range(len(g.lines)):
                own: dict = {}
                for part in g.parts[n] + g.values.get(n, []):
                    merged(own, value(part, n))
                for bit, (d, _) in enumerate(made):
                    if d == n:
                        grew |= merged(held[bit], own)
        for n, expression in g.returns.items():
            for (origin, safe), steps in (value(expression, n) if expression is not None else {}).items():
                key = (*origin, "return", "", g.lines[n], None, safe)
                found[key] = min(found.get(key, steps), steps)
        return [(function.lineno, *k[:7], steps, k[7]) for k, steps in sorted(found.items(), key=str)]

    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_()]
    return _per_function(files, of, _FLOW, kinds)


_FN = ["path", "function", "line"]
_ENDS = ["src_kind", "src", "src_line", "dst_kind", "dst", "dst_line"]


def _site(column: str):
    return F.split_part(F.col(column), F.lit(":"), F.lit(1))


def taint_flows(files: DataFrame) -> DataFrame:
    """(path, function, source, line_no, sink_path, sink_function, sink, sink_line, length,
    sanitised): each source whose value reaches a sink, in the same function or through
    calls and returns, with the shortest way: uses of variables, and one more for each
    argument or result that is passed.  ``sanitised``: every way leads through a call
    named like a sanitiser (then its shortest).

    A call of a plain name means the function of that name in the same file (the first
    by line), else in the same folder (the first by path); calls of other names pass
    their arguments on.  What goes into a function comes back to the call it came from
    only.  Recursion ends, as only shorter ways are new."""
    flows = written(local_flows(files), "flows")
    from . import syntax

    functions = syntax.signatures(files).select("path", "function", F.col("line_no").alias("line"), "parameters")
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    first = written(functions.groupBy("path", "function").agg(F.min(F.struct("line", "parameters")).alias("f")).select("path", "function", "f.*"), "functions")
    sites = flows.where("dst_kind = 'argument'").select(*_FN, _site("dst").alias("site"), "callee")
    sites = sites.unionAll(flows.where("src_kind = 'result'").select(*_FN, _site("src"), F.split_part("src", F.lit(":"), F.lit(2))))
    sites = sites.groupBy(*_FN, "site").agg(F.max("callee").alias("callee"))
    same = first.select(F.col("path").alias("to_path"), F.col("function").alias("to"), F.col("line").alias("to_line"), F.col("parameters"))
    near = first.groupBy(folder(F.col("path")).alias("near"), F.col("function").alias("to_near")).agg(F.min(F.struct("path", "line", "parameters")).alias("n"))
    found = sites.join(same, (sites["path"] == same["to_path"]) & (sites["callee"] == same["to"]), "left")
    found = found.join(near, (folder(F.col("path")) == F.col("near")) & (F.col("callee") == F.col("to_near")), "left")
    pick = lambda own, other: F.coalesce(F.col(own), F.col(other))
    calls = written(found.select(*_FN, "site", "callee", pick("to_path", "n.path").alias("to_path"), pick("to_line", "n.line").alias("to_line"), pick("parameters", "n.parameters").alias("parameters")), "calls")
    safe_call = F.coalesce(F.lower("callee").rlike("|".join(w.replace(".", r"\.") for w in SANITISERS)), F.lit(False))
    # An argument by name becomes its number in the function that is called.
    arguments = flows.where("dst_kind = 'argument'").select(*_FN, "dst", _site("dst").alias("site"), F.split_part("dst", F.lit(":"), F.lit(2)).alias("number")).distinct().join(calls, [*_FN, "site"])
    by_name = F.array_position("parameters", F.col("number")) - 1
    number = F.when(F.col("number").rlike("^[0-9]+$"), F.col("number")).when(by_name >= 0, by_name.cast("string"))
    arguments = written(arguments.select(*_FN, "dst", "site", number.alias("number"), "to_path", F.col("callee").alias("to"), "to_line", safe_call.alias("safe_call")), "arguments")

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min("steps").alias("steps"))

    # Through unknown functions a value passes on; through known ones as they say.
    unknown = arguments.where("to_path is null").select(*_FN, "dst", "site", F.lit(1).alias("more"), F.col("safe_call").alias("s"))
    known = arguments.where("to_path is not null")
    keys = [*_FN, *_ENDS, "safe"]
    flows = written(best(flows, *keys), "flows")
    while True:
        summary = flows.where("src_kind = 'param' and dst_kind = 'return'").groupBy(F.col("path").alias("to_path"), F.col("function").alias("to"), F.col("line").alias("to_line"), F.col("src").alias("number"), F.col("safe").alias("inside")).agg(F.min("steps").alias("inner"))
        through = known.join(summary, ["to_path", "to", "to_line", "number"]).select(*_FN, "dst", "site", (F.col("inner") + 2).alias("more"), (F.col("inside") | F.col("safe_call")).alias("s"))
        through = through.unionAll(unknown)
        into = flows.where("dst_kind = 'argument'").join(through, [*_FN, "dst"]).select(*_FN, "src_kind", "src", "src_line", "site", (F.col("steps") + F.col("more")).alias("n"), (F.col("safe") | F.col("s")).alias("s"))
        out = flows.where("src_kind = 'result'").select(*_FN, _site("src").alias("site"), "dst_kind", "dst", "dst_line", "steps", "safe")
        longer = into.join(out, [*_FN, "site"]).select(*_FN, *_ENDS, (F.col("safe") | F.col("s")).alias("safe"), (F.col("steps") + F.col("n")).alias("steps"))
        new = best(longer, *keys).withColumnRenamed("steps", "less").join(flows, keys, "left").where("steps is null or less < steps")
        new = written(new.select(*keys, F.col("less").alias("steps")), "new")
        if new.isEmpty():
            break
        flows = written(best(flows.unionByName(new), *keys), "flows")

    # From the sources: up through results, then down through arguments.
    origin = ["from_path", "from_function", "from_line", "source", "line_no"]
    ends = ["dst_kind", "dst", "dst_line"]
    start = flows.where("src_kind = 'source'").select(F.col("path").alias("from_path"), F.col("function").alias("from_function"), F.col("line").alias("from_line"), F.col("src").alias("source"), F.col("src_line").alias("line_no"), *_FN, *ends, "safe", F.lit(False).alias("down"), "steps")
    state = [*origin, *_FN, *ends, "safe", "down"]
    back = calls.where("to_path is not null").select(*_FN, "site", F.col("to_path").alias("c_path"), F.col("callee").alias("c_function"), F.col("to_line").alias("c_line"), safe_call.alias("s"))
    results = flows.where("src_kind = 'result'").select(*_FN, _site("src").alias("site"), *ends, F.col("steps").alias("more"), F.col("safe").alias("s2")).join(back, [*_FN, "site"])
    inside = flows.where("src_kind = 'param'").select(F.col("path").alias("to_path"), F.col("function").alias("to"), F.col("line").alias("to_line"), F.col("src").alias("number"), *[F.col(c).alias(f"t_{c}") for c in ends], F.col("steps").alias("more"), F.col("safe").alias("s2")).where("t_dst_kind <> 'return'")
    passed = written(known.join(inside, ["to_path", "to", "to_line", "number"]), "passed")
    results = written(results, "results")
    seen = new = written(best(start, *state), "taints")
    while True:
        up = new.where("dst_kind = 'return' and not down").select(*origin, F.col("path").alias("c_path"), F.col("function").alias("c_function"), F.col("line").alias("c_line"), "safe", "down", "steps")
        up = up.join(results, ["c_path", "c_function", "c_line"]).select(*origin, *_FN, *ends, (F.col("safe") | F.col("s") | F.col("s2")).alias("safe"), "down", (F.col("steps") + F.col("more") + 1).alias("steps"))
        low = new.where("dst_kind = 'argument'").join(passed, [*_FN, "dst"])
        low = low.select(*origin, F.col("to_path").alias("path"), F.col("to").alias("function"), F.col("to_line").alias("line"), *[F.col(f"t_{c}").alias(c) for c in ends], (F.col("safe") | F.col("s2")).alias("safe"), F.lit(True).alias("down"), (F.col("steps") + F.col("more") + 1).alias("steps"))
        found = best(up.unionByName(low), *state).withColumnRenamed("steps", "less").join(seen, state, "left").where("steps is null or less < steps")
        new = written(found.select(*state, F.col("less").alias("steps")), "taints")
        if new.isEmpty():
            break
        seen = written(best(seen.unionByName(new), *state), "taints")
    sinks = seen.where("dst_kind = 'sink'").groupBy(F.col("from_path").alias("path"), F.col("from_function").alias("function"), "source", "line_no", F.col("path").alias("sink_path"), F.col("function").alias("sink_function"), F.col("dst").alias("sink"), F.col("dst_line").alias("sink_line")).agg(F.min(F.struct("safe", "steps")).alias("w"))
    return sinks.select("path", "function", "source", "line_no", "sink_path", "sink_function", "sink", "sink_line", F.col("w.steps").alias("length"), F.col("w.safe").alias("sanitised"))
