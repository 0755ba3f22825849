"""Reaching definitions against runs of the program with every choice of branches."""

import ast
import random

from lodestone.operators import dataflow

PROGRAMS = [
    "def f(a, b):\n    x = a\n    if b:\n        x = 1\n    else:\n        y = x\n        x = 2\n    z = x\n    return z\n",
    "def f(a):\n    x = a\n    while x:\n        y = x\n        if y:\n            break\n        x = y\n    else:\n        x = 0\n    return x\n",
    "def f(a):\n    x = 1\n    if a:\n        return x\n    x = 2\n    for i in a:\n        if i:\n            x = i\n            continue\n        a = x\n    return x + a\n",
    "def f(a):\n    n = 0\n    while a:\n        while n:\n            n += 1\n            if a:\n                a = n\n        n = a\n    return n\n",
    "def f(a):\n    for i in a:\n        for j in i:\n            a = j\n            if j:\n                break\n        i = a\n    b = [i for i in a if a]\n    return lambda a: a + b\n",
]


def observed(source, runs=4000, seed=1):
    """(name, def line, use line) seen when branches are taken at random."""
    function = ast.parse(source).body[0]
    rng, seen = random.Random(seed), set()

    class Leave(Exception):
        pass

    def run():
        last = {a.arg: function.lineno for a in function.args.args}

        def read(node, line):
            for n in dataflow._names(node, ast.Load):
                if n.id in last:
                    seen.add((n.id, last[n.id], line))

        def write(node, line):
            for n in dataflow._names(node, ast.Store):
                last[n.id] = line

        def block(body):
            for s in body:
                how = one(s)
                if how:
                    return how
            return None

        def one(s):
            if isinstance(s, ast.If):
                read(s.test, s.lineno)
                return block(s.body if rng.random() < 0.5 else s.orelse)
            if isinstance(s, (ast.While, ast.For)):
                read(s.test if isinstance(s, ast.While) else s.iter, s.lineno)
                while rng.random() < 0.6:
                    if isinstance(s, ast.For):
                        write(s.target, s.lineno)
                    how = block(s.body)
                    if how == "break":
                        return None
                    if how == "return":
                        return how
                    if isinstance(s, ast.While):
                        read(s.test, s.lineno)
                return block(s.orelse)
            if isinstance(s, ast.Break):
                return "break"
            if isinstance(s, ast.Continue):
                return "continue"
            if isinstance(s, ast.AugAssign):
                read(ast.Name(s.target.id, ast.Load()), s.lineno)
            read(s, s.lineno)
            write(s, s.lineno)
            return "return" if isinstance(s, ast.Return) else None

        block(function.body)

    for _ in range(runs):
        run()
    return seen


def test_reaching_definitions_against_runs(spark):
    files = spark.createDataFrame([*((f"{i}.py", p) for i, p in enumerate(PROGRAMS)), ("bad.py", "def f("), ("none.py", None), ("empty.py", "")], "path string, text string")
    got = dataflow.reaching_definitions(files).collect()
    for i, p in enumerate(PROGRAMS):
        found = {(r["name"], r["def_line"], r["use_line"]) for r in got if r["path"] == f"{i}.py"}
        assert found == observed(p), p
    assert {r["path"] for r in got} == {f"{i}.py" for i in range(len(PROGRAMS))}


def test_failures_and_matches(spark):
    source = "def f(a):\n    x = 1\n    try:\n        x = a()\n        y = x\n    except E as e:\n        return x, e\n    finally:\n        z = x\n    match a:\n        case [q]:\n            x = q\n        case _:\n            pass\n    if (n := x) and n:\n        del x\n    return x\n"
    got = {(r["name"], r["def_line"], r["use_line"]) for r in dataflow.reaching_definitions(spark.createDataFrame([("a.py", source)], "path string, text string")).collect()}
    assert {("x", 2, 7), ("x", 4, 7), ("e", 6, 7), ("x", 4, 9), ("x", 2, 9), ("q", 11, 12), ("n", 15, 15), ("x", 12, 17)} <= got
    assert ("y", 5, 7) not in got


def flows(spark, *texts):
    rows = dataflow.taint_flows(spark.createDataFrame([(f"p/{i}.py", t) for i, t in enumerate(texts)], "path string, text string")).collect()
    return {(r["path"][2], r["function"], r["source"], r["line_no"], r["sink_path"][2], r["sink_function"], r["sink"], r["sink_line"], r["length"], r["sanitised"]) for r in rows}


def test_taints_across_functions(spark):
    got = flows(
        spark,
        "def start():\n    x = input()\n    return middle(x)\ndef middle(a):\n    b = a\n    last(1, b)\ndef last(n, v):\n    eval(v)\n    eval(n)\n",
        "def get():\n    return input()\ndef use():\n    q = get()\n    os.system(q)\n    os.system(escape(q))\ndef clean_one(x):\n    return x\ndef safe():\n    s = clean_one(get())\n    exec(s)\n",
        "def same(x):\n    return x\ndef a():\n    t = same(input())\n    return t\ndef b():\n    t = same('fixed')\n    eval(t)\n",
        "def loop(n, x):\n    if n:\n        return loop(n, x)\n    eval(x)\n    return x\ndef go():\n    loop(x=input(), n=3)\n",
        "def far():\n    last(0, input())\n",
    )
    assert got == {
        ("0", "start", "input", 2, "0", "last", "eval", 8, 6, False),  # x, passed, a, b, passed, v
        ("1", "get", "input", 2, "1", "use", "os.system", 5, 2, False),  # result, q
        ("1", "get", "input", 2, "1", "use", "os.system", 6, 3, True),
        ("1", "get", "input", 2, "1", "safe", "exec", 11, 5, True),
        ("3", "go", "input", 7, "3", "loop", "eval", 4, 2, False),
        ("4", "far", "input", 2, "0", "last", "eval", 8, 2, False),
    }
