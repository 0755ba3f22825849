"""Tree patterns as joins against a plain walk that tries every place."""

import ast
import re

import pytest

from lodestone.operators import structure

SOURCE = '''
def f(a, b, items):
    if a == a:
        return True
    else:
        return False
    if a.x[0] == a.x[ 0 ]:
        b = b
    q = "select " + a
    print(q)
    b.execute(q)
    b.execute(a)
    subprocess.run(a, b, check=True, shell=True)
    subprocess.run(a, shell=False)
    subprocess.run(shell=True)
    try:
        a()
        b()
    except ValueError:
        pass
    try:
        a()
    except E:
        print(a)
    for i in range(len(items)):
        if i:
            print(items[i] + 1)
    for i in range(len(items)):
        print(items[i + 1])
    f(a, 1, b)
    f(1, b)
    f(a, b, 1)
    return g("a == a")
'''


def naive(pattern, source):
    """Lines where a pattern fits, by a walk with backtracking."""
    p = ast.parse(re.sub(r"\$([A-Z]+)", r"HOLE_\1", pattern)).body
    same = lambda x, y: structure._digest(x) == structure._digest(y)

    def fit(p, x, held):
        """All bindings under which x fits p."""
        if structure._deep(p) is not None or (isinstance(p, ast.Expr) and structure._deep(p.value) is not None):
            inner = structure._deep(p) or structure._deep(p.value)
            return [h for y in ast.walk(x) for h in fit(inner, y, held)]
        hole = structure._hole(p)
        if hole:
            if hole in held:
                return [held] if same(held[hole], x) else []
            return [held | {hole: x}]
        if type(p) is not type(x) or structure._label(p) != structure._label(x):
            return []
        out = [held]
        for name, value in ast.iter_fields(p):
            if name in structure._IGNORED or (name in structure._OPEN and not value) or not isinstance(value, (list, ast.AST)):
                continue
            other = getattr(x, name)
            if isinstance(value, list):
                out = [h2 for h in out for h2 in (anyorder(value, other, h) if name == "keywords" else run(value, other, h))]
            else:
                out = [h2 for h in out for h2 in (fit(value, other, h) if isinstance(other, ast.AST) else [])]
        return out

    def anyorder(ps, xs, held):
        if not ps:
            return [held]
        return [h2 for x in xs for h in fit(ps[0], x, held) for h2 in anyorder(ps[1:], xs, h)]

    def run(ps, xs, held, open_end=False):
        if not ps:
            return [held] if not xs or open_end else []
        if structure._is_any(ps[0]):
            return [h for k in range(len(xs) + 1) for h in run(ps[1:], xs[k:], held, open_end)]
        if len(ps) == 1 and isinstance(ps[0], ast.Expr) and structure._deep(ps[0].value) is not None:
            return [h for x in xs for h in fit(ps[0], x, held)]
        return [h2 for h in (fit(ps[0], xs[0], held) if xs else []) for h2 in run(ps[1:], xs[1:], h, open_end)]

    tree, lines = ast.parse(source), []
    for x in ast.walk(tree):
        if len(p) == 1:
            one = p[0].value if isinstance(p[0], ast.Expr) else p[0]
            if fit(one, x, {}):
                lines.append(x.lineno)
        for name in ("body", "orelse", "finalbody"):
            block = getattr(x, name, None)
            if len(p) > 1 and isinstance(block, list):
                lines += [s.lineno for i, s in enumerate(block) if fit(p[0], s, {}) and run(p, block[i:], {}, True)]
    return sorted(lines)


PATTERNS = [p for rules in structure.PACKS.values() for _, _, p in rules] + ["f(..., $X, 1)", "f(1, ...)", "f(..., b)", "f(a, ..., b)", "f($X, $Y)", "print($X)\n$B.execute(...)", "$F(deep(a))", "b"]


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None), ("empty.py", "")], "path string, text string")
    return structure.nodes(files).cache()


@pytest.mark.parametrize("pattern", PATTERNS)
def test_pattern_against_a_plain_walk(tree, pattern):
    got = sorted(r["line_no"] for r in structure.matches(tree, pattern).where("path = 'a.py'").collect())
    assert got == naive(pattern, SOURCE)
