"""Confidence of fixes, evidence packages, patch policies, votes by strategy."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import dealt
from . import code, problems

#: The weights of the factors, in their order.
WEIGHTS = {"syntax": 0.20, "tests": 0.25, "dependencies": 0.15, "api": 0.20, "semantics": 0.20}
#: Modules whose import is no new dependency.
STANDARD = "os sys json re datetime collections itertools functools typing pathlib hashlib random string math statistics decimal urllib http socket subprocess tempfile shutil glob fnmatch pickle copy pprint textwrap enum dataclasses abc inspect".split()
#: What makes a fix suspicious.
SUSPICIOUS = [r"eval\s*\(", r"exec\s*\(", r"__import__\s*\(", r"subprocess\.call\s*\([^)]*shell\s*=\s*True"]
#: Phrases too general for an invariant.
GENERIC = ["something is wrong", "there is a bug", "this needs fixing", "error occurs", "invalid state"]
#: Suffixes of source files.
SUFFIXES = [".py", ".rs", ".js", ".ts", ".go", ".java", ".cpp", ".c"]
#: Limits of a patch, and what it must not use.
MAX_FILES, MAX_LINES = 3, 160
FORBIDDEN = ["os.system", "os.popen", "subprocess.call", "subprocess.Popen", "subprocess.check_output", "eval", "exec", "__import__", "pickle.load", "yaml.load", "marshal.load"]
#: What an added line must not do, with its name.
DANGEROUS = [("os.system", "System call"), ("os.popen", "Process execution"), ("subprocess", "Subprocess execution"), ("socket", "Network access"), ("eval(", "Eval execution"), ("exec(", "Exec execution"), ("__import__", "Dynamic import"), ("pickle.load", "Unsafe deserialization"), ("yaml.load(", "Unsafe YAML")]
#: Words of flows that touch security.
SECURITY_WORDS = ["sql", "query", "execute", "input", "user_input", "request", "password", "secret", "token", "key", "file", "read", "write", "network", "http", "socket", "eval", "exec", "compile"]
#: Boolean texts and what stands for them, in this order.
SIMPLER = [("not True", "False"), ("not False", "True"), ("True and", ""), ("False or", ""), ("True or", "True"), ("False and", "False")]
#: Attacks with the patterns that show them, and the payloads that hold a quote.
ATTACKS = [
    ("injection", True, [r"execute\s*\(.*\+", r"cursor\.execute\s*\([^,]+\s*\+", r"os\.system\s*\(", r"eval\s*\(", r"exec\s*\("]),
    ("bola", False, [r"get_object\s*\(\s*request\.", r"user_id\s*=\s*request\.", r"id\s*=\s*kwargs\['id'\]"]),
    ("auth_bypass", True, [r"password\s*==", r"if\s+user\s*==", r"""==\s*["']admin["']""", r"login.*without.*hash"]),
    ("xss", True, [r"render.*user.*input", r"\{\{.*\|\s*safe\s*\}\}", r"dangerouslySetInnerHTML", r"innerHTML\s*="]),
    ("ssrf", False, [r"requests\.get\s*\([^)]*\+[^)]*\)", r"urlopen\s*\([^)]*\+[^)]*\)", r"http://\{"]),
]
#: Hypotheses of this engine by kind of fault, the first words that fit choose.
HYPOTHESES = [
    (["sql", "injection"], ["input reaches a query unescaped", "a query is built from text", "a stored value is used in a query"]),
    (["auth", "bypass"], ["a token is not verified", "a role is taken from the request", "a password is compared in clear"]),
    (["race", "concurrent"], ["two writers share a value", "a check and its use are apart", "locks are taken in two orders"]),
    ([""], ["a value may be absent", "a bound is off by one", "an error is not handled"]),
]


# Confidence of a fix.


def balanced(text: Column) -> Column:
    """100, or 50 where round, square or curly brackets do not match in number."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    even = (count("{") == count("}")) & (count("(") == count(")")) & (count("[") == count("]"))
    return F.when(even, 100.0).otherwise(50.0)


def parsed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with a struct (ok, imports, functions) for each text column of ``names``
    (column -> name of the struct): whether it parses, the first parts of imported
    modules, and the functions with the arguments they cannot do without and all of
    them.  Null counts as empty; one narrow pass in Arrow batches."""
    kind = T.StructType.fromDDL("ok boolean, imports array<string>, functions array<struct<name:string,needed:array<string>,args:array<string>>>")
    out = T.StructType([*rows.schema.fields, *[T.StructField(n, kind) for n in names.values()]])
    at = [rows.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        @functools.lru_cache(maxsize=1024)
        def read(text: str | None) -> dict:
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return {"ok": False, "imports": [], "functions": []}
            imports, functions = set(), {}
            for node in ast.walk(tree):
                if isinstance(node, ast.Import):
                    imports.update(a.name.split(".")[0] for a in node.names)
                elif isinstance(node, ast.ImportFrom) and node.module:
                    imports.add(node.module.split(".")[0])
                elif isinstance(node, ast.FunctionDef):
                    args = [a.arg for a in node.args.args]
                    functions[node.name] = {"name": node.name, "needed": args[: len(args) - len(node.args.defaults)], "args": args}
            return {"ok": True, "imports": sorted(imports), "functions": list(functions.values())}

        for batch in batches:
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            for k, i in enumerate(at):
                arrays.append(pa.array(list(map(read, batch.column(i).to_pylist())), arrow.field(len(batch.columns) + k).type))
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return dealt(rows).mapInArrow(run, out)


def dependency_score(before: Column, after: Column) -> Column:
    """100 minus 20 for each new module outside the standard ones, 50 at most."""
    new = F.filter(F.array_except(after, before), lambda x: ~x.isin(STANDARD))
    return F.lit(100.0) - F.least(F.size(new) * 20, F.lit(50))


def api_score(before: Column, after: Column) -> Column:
    """100 minus 25 for each function that lost an argument it needed, 30 for each
    public one that is gone; at least 0."""
    of = lambda f: F.filter(after, lambda g: g["name"] == f["name"])
    gone = F.filter(before, lambda f: (F.size(of(f)) == 0) & ~f["name"].startswith("_"))
    lost = F.filter(before, lambda f: (F.size(of(f)) > 0) & (F.size(F.array_except(f["needed"], F.flatten(F.transform(of(f), lambda g: g["args"])))) > 0))
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.size(lost) * 25 - F.size(gone) * 30)


def semantic_score(before: Column, after: Column) -> Column:
    """100, less for a fix much longer than the text and for suspicious calls."""
    ratio = F.size(F.split(after, "\n")) / F.greatest(F.size(F.split(before, "\n")), F.lit(1))
    calls = sum((F.when(after.rlike(p), 30).otherwise(0) for p in SUSPICIOUS), F.lit(0))
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.when(ratio > 2, 20).when(ratio > 1.5, 10).otherwise(0) - calls)


def tests_score(passed: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(passed * 100, total), F.lit(75.0))


def fix_confidence(rows: DataFrame, before: str = "before", after: str = "after", path: str = "path", passed: str = "passed", total: str = "total") -> DataFrame:
    """``rows`` with the five factors, overall (one decimal), level, and the factors by
    score as text (``strong``, at least 90, then ``weak``, under 70; two each)."""
    out = parsed(rows, {before: "__before", after: "__after"})
    text, old = F.coalesce(F.col(after), F.lit("")), F.coalesce(F.col(before), F.lit(""))
    factors = {
        "syntax": F.when(F.col(path).endswith(".py"), F.when(F.col("__after.ok"), 100.0).otherwise(0.0)).otherwise(balanced(text)),
        "tests": tests_score(F.col(passed), F.col(total)),
        "dependencies": dependency_score(F.col("__before.imports"), F.col("__after.imports")),
        "api": api_score(F.col("__before.functions"), F.col("__after.functions")),
        "semantics": semantic_score(old, text),
    }
    for name, score in factors.items():
        out = out.withColumn(name, score.cast("double"))
    out = out.withColumn("overall", F.round(sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0)), 1))
    order = F.array_sort(F.array(*[F.struct((-F.col(n)).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(WEIGHTS)]))
    two = lambda test: F.array_join(F.slice(F.transform(F.filter(order, test), lambda x: x["n"]), 1, 2), ",")
    level = F.when(F.col("overall") >= 90, "high").when(F.col("overall") >= 70, "medium").otherwise("low")
    return out.withColumn("level", level).withColumn("strong", two(lambda x: x["s"] <= -90)).withColumn("weak", two(lambda x: x["s"] > -70)).drop("__before", "__after")


# Evidence.


def plausible(text: Column) -> Column:
    low = F.lower(text)
    return ~problems.has_any(low, GENERIC)


def package_score(p: DataFrame) -> Column:
    """.4 of the mean confidence of the hypotheses, and shares for a symbol snippet, the
    depth of calls, a data flow, and the parts of a reproduction; within 0 and 1."""
    h = F.col("hypotheses")
    mean = F.coalesce(F.try_divide(F.aggregate(h, F.lit(0.0), lambda a, x: a + x["confidence"]), F.size(h)), F.lit(0.0))
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    parts = [(has(F.col("snippet")), 0.1), (F.col("call_depth") > 0, 0.1), (F.exists(h, lambda x: F.size(x["data_flow_path"]) > 0), 0.2), (has(F.col("repro.description")), 0.1), (has(F.col("repro.code_snippet")), 0.05), (has(F.col("repro.input_data")), 0.05)]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean * 0.4 + sum((F.when(t, v).otherwise(0.0) for t, v in parts), F.lit(0.0))))


def evidence_gate(packages: DataFrame) -> DataFrame:
    """``packages`` with score, strength, threshold, errors, warnings and decision.

    PASSED without an error; REJECTED on a missing id or path, on a path of no source
    file, on five errors or three missing core parts; else RETRY.  Columns: candidate_id,
    file_path, line_start, line_end, repro (description, code_snippet, input_data),
    symbols, snippet, call_depth, invariant (type, description, details), scope,
    risk_class, hypotheses (title, type, confidence, data_flow_path).
    """
    out = packages.withColumn("score", F.round(package_score(packages), 6))
    score, h, n = F.col("score"), F.col("hypotheses"), F.size("hypotheses")
    risk, empty = F.col("risk_class"), lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    strength = F.when(score < 0.4, "weak").when(score < 0.6, "moderate").when(score < 0.8, "strong").otherwise("very_strong")
    threshold = F.when(risk.isin("critical", "high"), 0.6).when(risk == "medium", 0.5).otherwise(0.4)
    vague = ~(plausible(F.col("invariant.description")) & plausible(F.col("invariant.details")))
    titles, kinds = F.transform(h, lambda x: F.lower(x["title"])), F.array_distinct(F.transform(h, lambda x: x["type"]))
    mean = F.coalesce(F.try_divide(F.aggregate(h, F.lit(0.0), lambda a, x: a + x["confidence"]), n), F.lit(0.0))
    tests = [
        ("no candidate", empty(F.col("candidate_id").cast("string"))),
        ("no path", empty(F.col("file_path"))),
        ("no reproduction", empty(F.col("repro.description")) | empty(F.col("repro.code_snippet"))),
        ("no symbols", F.size("symbols") == 0),
        ("no invariant", empty(F.col("invariant.description")) | empty(F.col("invariant.details"))),
        ("vague invariant", vague),
        ("few hypotheses", n < 3),
        ("many hypotheses", n > 5),
        ("no source file", ~F.lower("file_path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")),
        ("bad lines", (F.col("line_start") <= 0) | (F.col("line_end") < F.col("line_start"))),
        ("under threshold", score < threshold),
        ("weak", score < 0.4),
        ("vague invariant again", vague),
        ("short details", F.length(F.coalesce("invariant.details", F.lit(""))) < 20),
        ("few hypotheses again", n < 3),
        ("many hypotheses again", n > 5),
        ("equal titles", F.size(F.array_distinct(titles)) < n),
        ("one kind", (F.size(kinds) < 2) & (n >= 3)),
        ("low confidence", mean < 0.3),
    ]
    some = F.filter(F.array(*[F.when(t, name) for name, t in tests]), lambda x: x.isNotNull())
    hints = [("critical with moderate evidence", (risk == "critical") & (score < 0.7)), ("high without input", (risk == "high") & empty(F.col("repro.input_data"))), ("wide with little evidence", (F.col("scope") == "cross_module") & (score < 0.5))]
    out = out.withColumn("strength", strength).withColumn("threshold", threshold).withColumn("errors", some)
    out = out.withColumn("warnings", F.filter(F.array(*[F.when(t, name) for name, t in hints]), lambda x: x.isNotNull()))
    e = F.col("errors")
    core = F.size(F.array_intersect(e, F.array(F.lit("no reproduction"), F.lit("no symbols"), F.lit("no invariant")))) >= 3
    flawed = F.arrays_overlap(e, F.array(F.lit("no candidate"), F.lit("no path"), F.lit("no source file"))) | (F.size(e) >= 5) | core
    return out.withColumn("decision", F.when(F.size(e) == 0, "PASSED").when(flawed, "REJECTED").otherwise("RETRY"))


def hypothesis_confidence(kind: Column, paths: Column, shortest: Column) -> Column:
    """.5, up to .3 for the number of taint paths, .1 or .05 for a short one, .1 for
    four telling kinds; at most 1."""
    out = F.lit(0.5) + F.least(F.lit(0.3), paths * 0.1) + F.when((paths > 0) & (shortest <= 3), 0.1).when((paths > 0) & (shortest <= 5), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), out + F.when(kind.isin("sql_injection_user_input", "sql_injection_dynamic_query", "auth_jwt_signature", "auth_password_not_hashed"), 0.1).otherwise(0.0))


def path_evidence(kind: Column, length: Column, tainted: Column, sanitised: Column, branch: Column) -> Column:
    """(sign, weight, quality) of a path: call chains by length, flows by taint, control
    flow by branches; null for an empty chain."""
    item = lambda s, w, q: F.struct(F.lit(s).alias("sign"), F.lit(w).alias("weight"), q.alias("quality"))
    calls = F.when(length > 0, item(1, 0.7, F.least(F.lit(1.0), F.lit(0.5) + F.least(length, F.lit(5)) * 0.1)))
    flow = F.when(tainted & ~sanitised, item(1, 1.0, F.lit(0.9))).otherwise(item(-1, 0.5, F.lit(0.7)))
    return F.when(kind == "call", calls).when(kind == "flow", flow).otherwise(item(1, 0.6, F.when(branch, 0.7).otherwise(0.5)))


def estimate(features: Column) -> Column:
    """1 minus the share of zeros, .1 more where the deviation lies between .1 and .5."""
    n = F.size(features)
    mean = F.aggregate(features, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(F.transform(features, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(var)
    return F.least(F.lit(1.0), F.lit(1.0) - F.size(F.filter(features, lambda x: x == 0)) / n + F.when((std > 0.1) & (std < 0.5), 0.1).otherwise(0.0))


def agreement(a: Column, b: Column) -> Column:
    """How far two scores of 0 to 100 support each other."""
    gap = F.abs(a - b)
    return F.when(gap < 10, 0.95).when(gap < 20, 0.85).when(gap < 30, 0.7).otherwise(0.5)


def risk(severities: Column, own: Column, bug_type: Column, scope: Column) -> Column:
    """(risk_class, exploitability, blast_radius, cvss) by the highest severity of the
    hypotheses (the candidate's own without any), by order, not by name."""
    rank = lambda s: F.when(s == "critical", 4).when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(2)
    top = F.coalesce(F.array_max(F.transform(severities, rank)), rank(own))
    low = F.lower(bug_type)
    exploit = F.when(low.contains("injection") | low.contains("bypass"), "HIGH").when(low.contains("race"), "MEDIUM").when(scope == "local", "LOW").otherwise("MEDIUM")
    name = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), top)
    blast = F.when(scope == "system", "system").when(scope == "cross_module", "modules").when(scope == "module", "module").otherwise("function")
    return F.struct(name.alias("risk_class"), exploit.alias("exploitability"), blast.alias("blast_radius"), F.element_at(F.array(*map(F.lit, (2.5, 5.0, 7.5, 9.0))), top).alias("cvss"))


def scope(entry: Column, symbols: Column) -> Column:
    """The reach of a fault; the larger bound is tried first."""
    return F.when(entry, "cross_module").when(symbols > 10, "system").when(symbols > 5, "module").otherwise("local")


def hypotheses(bug_type: Column) -> Column:
    """The hypotheses of the first kind whose words are in the type."""
    low = F.lower(F.coalesce(bug_type, F.lit("")))
    out = None
    for words, texts in reversed(HYPOTHESES):
        own = F.array(*map(F.lit, texts))
        out = own if out is None else F.when(problems.has_any(low, words), own).otherwise(out)
    return out


# Patches.


def _added(diff: Column) -> Column:
    return F.filter(F.split(diff, "\n"), lambda x: x.startswith("+"))


def touched(diff: Column) -> Column:
    """The distinct base names of a diff's files; /dev/null is none."""
    paths = F.filter(F.regexp_extract_all(diff, F.lit(r"(?md)^(?:\+\+\+|---) ([^ \n]*)"), 1), lambda x: x != "/dev/null")
    return F.array_distinct(F.filter(F.transform(paths, lambda x: F.substring_index(x, "/", -1)), lambda x: x != ""))


def changed_lines(diff: Column) -> Column:
    """Lines that begin with + or -, but not with three of them."""
    d = F.concat(F.lit("\n"), diff)
    starts = lambda c: F.length(d) - F.length(F.replace(d, F.lit("\n" + c), F.lit("\n" + c[1:])))
    return starts("+") - starts("+++") + starts("-") - starts("---")


def forbidden(diff: Column) -> Column:
    """The forbidden names that added lines have, in the table's order."""
    has = [F.when(diff.contains(x) & diff.rlike(r"(?md)^\+.*" + re.escape(x)), x) for x in FORBIDDEN]
    return F.filter(F.array(*has), lambda x: x.isNotNull())


def new_packages(diff: Column) -> Column:
    """Distinct packages that a diff adds to a requirements file, to the dependencies of
    a package.json, or to a manifest with [dependencies]; lines are only cut where the
    diff has the word at all."""
    added = _added(diff)
    required = F.transform(F.filter(added, lambda x: x.contains("requirements.txt")), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^\+", "")), "(==|>=).*$", ""))
    required = F.filter(required, lambda x: (x != "") & ~x.isin("#", "-r", "-e"))
    script = F.transform(F.filter(added, lambda x: x.startswith('+    "') & x.contains(":")), lambda x: F.split_part(x, F.lit('"'), F.lit(2)))
    cargo = F.transform(F.regexp_extract_all(diff, F.lit(r"(?md)^\+(?!\+\+)(?!.*\[dependencies\])([^=\n]*)="), 1), lambda x: F.trim(x))
    none = F.array().cast("array<string>")
    parts = [F.when(diff.contains("requirements.txt"), required).otherwise(none), F.when(diff.contains('"dependencies"') | diff.contains('"devDependencies"'), script).otherwise(none), F.when(diff.contains("[dependencies]"), cargo).otherwise(none)]
    return F.array_distinct(F.concat(*parts))


def policy(rows: DataFrame, diff: str = "diff", allow_new: bool = False) -> DataFrame:
    """``rows`` with an array of (rule, severity) that the diff breaks.  New packages are
    an error where they are not allowed."""
    d = F.coalesce(F.col(diff), F.lit(""))
    # Columns of their own, so that the rules do not count again.
    own = rows.withColumn("__lines", changed_lines(d)).withColumn("__bad", F.size(forbidden(d)) > 0)
    lines = F.col("__lines")
    rules = [("max_files_touched", "block", F.size(touched(d)) > MAX_FILES), ("max_lines_changed", "block", lines > 2 * MAX_LINES), ("max_lines_changed", "error", (lines > MAX_LINES) & (lines <= 2 * MAX_LINES)), ("forbidden_imports", "block", F.col("__bad"))]
    if not allow_new:
        rules.append(("no_new_dependencies", "error", F.size(new_packages(d)) > 0))
    found = F.array(*[F.when(t, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, t in rules])
    return own.withColumn("violations", F.filter(found, lambda x: x.isNotNull())).drop("__lines", "__bad")


def dangers(diff: Column) -> Column:
    """For each added line and each dangerous text in it: (name, the line's first 50
    characters)."""
    hits = F.transform(_added(diff), lambda line: F.filter(F.array(*[F.when(line.contains(p), F.struct(F.lit(n).alias("danger"), F.substring(F.trim(line), 1, 50).alias("line"))) for p, n in DANGEROUS]), lambda x: x.isNotNull()))
    return F.flatten(hits)


def simplified(condition: Column) -> Column:
    out = condition
    for old, new in SIMPLER:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def touches_security(source: Column, target: Column) -> Column:
    return problems.has_any(F.lower(source), SECURITY_WORDS) | problems.has_any(F.lower(target), SECURITY_WORDS)


def attacks(rows: DataFrame, text_col: str = "text", scenarios: list = ATTACKS) -> DataFrame:
    """``rows`` with (attack, evidence, severity) for each scenario that fits the text: a
    pattern anywhere, or a quoted payload where text is joined to SQL.  Evidence is the
    first line that a pattern fits."""
    text = F.col(text_col)
    low, lines = F.lower(text), F.split(text, "\n")
    joined = text.contains("+") & low.contains("sql")
    severity = F.when(problems.has_any(low, ["eval", "exec", "system", "raw"]), "CRITICAL").when(problems.has_any(low, ["execute", "query", "open", "request"]), "HIGH").otherwise("MEDIUM")
    found = []
    for name, quoted, patterns in scenarios:
        rule = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
        first = F.try_element_at(F.filter(F.transform(lines, _numbered), _fits(rule)), F.lit(1))
        evidence = F.coalesce(F.concat(F.lit("Line "), first["n"].cast("string"), F.lit(": "), F.substring(F.trim(first["line"]), 1, 100)), F.lit(""))
        found.append(F.when(text.rlike(rule) | (joined if quoted else F.lit(False)), F.struct(F.lit(name).alias("attack"), evidence.alias("evidence"), severity.alias("severity"))))
    return rows.withColumn("attacks", F.filter(F.array(*found), lambda x: x.isNotNull()))


def _numbered(line: Column, i: Column) -> Column:
    return F.struct((i + 1).alias("n"), line.alias("line"))


def _fits(rule: str):
    return lambda x: x["line"].rlike(rule)


# Votes.


def vote(votes: DataFrame, context: str, least: float = 0.7) -> DataFrame:
    """Per context the winner by each of four strategies.  ``votes``: context, seq,
    model, fix, confidence, weight, success (share of the model's calls); votes under
    ``least`` or without a fix are dropped.  Fixes are compared by their normal form.

    majority: the largest group (the first on ties), its surest vote; weighted: the
    highest confidence * weight * (.5 + .5 success); confidence: the surest;
    consensus: a group of three quarters, else weighted.  Ties by seq.
    """
    own = votes.where((F.col("confidence") >= least) & F.col("fix").isNotNull())
    own = own.withColumn("key", F.substring(F.md5(code.normal_form(F.col("fix"))), 1, 16)).withColumn("score", F.col("confidence") * F.col("weight") * (F.col("success") * 0.5 + 0.5))
    best = lambda c: F.max(F.struct(F.col(c).alias("by"), (-F.col("seq")).alias("seq"), "model", "confidence", "key"))
    per = own.groupBy(context, "key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), best("confidence").alias("sure"), best("score").alias("heavy"))
    groups = F.struct("n", (-F.col("first")).alias("first"), "sure", "key")
    out = per.groupBy(context).agg(F.sum("n").alias("total"), F.max(groups).alias("g"), F.max("sure").alias("sure"), F.max("heavy").alias("heavy"), F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("sizes"))
    share = lambda key: F.round(F.col("sizes")[key] / F.col("total"), 4)
    row = lambda name, v, s: F.struct(F.lit(name).alias("strategy"), v["model"].alias("model"), v["confidence"].alias("confidence"), s.alias("agreement"))
    heavy, sure, group = F.col("heavy"), F.col("sure"), F.col("g.sure")
    majority = F.round(F.col("g.n") / F.col("total"), 4)
    agreed = F.col("g.n") >= F.col("total") * 0.75
    consensus = F.when(agreed, row("consensus", group, majority)).otherwise(row("weighted", heavy, share(heavy["key"])))
    rows = F.array(F.struct(F.lit("majority").alias("asked"), row("majority", group, majority).alias("r")), F.struct(F.lit("weighted").alias("asked"), row("weighted", heavy, share(heavy["key"])).alias("r")), F.struct(F.lit("confidence").alias("asked"), row("confidence", sure, share(sure["key"])).alias("r")), F.struct(F.lit("consensus").alias("asked"), consensus.alias("r")))
    out = out.select(context, "total", F.inline(rows)).select(context, "total", "asked", "r.*")
    return out.withColumn("consensus", F.col("agreement") >= 0.75)


def first_results(results: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first result of each key is kept and replayed for the later ones: ``replayed``
    marks these."""
    w = Window.partitionBy(key).orderBy(*order)
    return results.withColumn("replayed", F.row_number().over(w) > 1)


def escalation(loops: Column, stalled: Column, level: Column) -> Column:
    """The next level (at most 4) after ten loops or three without improvement."""
    return F.when((loops >= 10) | (stalled >= 3), F.least(level + 1, F.lit(4))).otherwise(level)


#: Harness templates of this engine by language; {name} and {call} are filled in.
HARNESSES = {
    "python": "import sys\n\n\ndef main():\n    data = sys.stdin.buffer.read()\n    {name}({call})\n\n\nmain()\n",
    "c": "int LLVMFuzzerTestOneInput(const uint8_t *data, size_t size) {{\n    {name}({call});\n    return 0;\n}}\n",
}


def harness(name: Column, parameters: Column, language: Column) -> Column:
    """The text of a fuzz harness that calls a function with the input for each of its
    parameters; null for other languages."""
    call = F.array_join(F.transform(parameters, lambda _: F.lit("data")), ", ")
    out = F.lit(None).cast("string")
    for lang, text in HARNESSES.items():
        head, tail = text.replace("{{", "{").replace("}}", "}").split("{name}({call})")
        out = F.when(language == lang, F.concat(F.lit(head), name, F.lit("("), call, F.lit(")"), F.lit(tail))).otherwise(out)
    return out


def outcomes(runs: DataFrame, seconds: str, failed: str, limit: float) -> DataFrame:
    """``runs`` with ``outcome``: a model's run that takes longer than the limit or fails
    is a value like any other, so one run never ends the others."""
    return runs.withColumn("outcome", F.when(F.col(seconds) > limit, "timeout").when(F.col(failed), "error").otherwise("ok"))
