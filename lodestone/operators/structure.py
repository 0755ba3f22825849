"""Rules on the structure of Python sources: tree patterns as joins of node rows.

Every syntax node is a row: its place in pre-order and the last place below it, its
parent, the field of the parent and its position there, its kind and label, and a
digest of all below.  A pattern is source text with ``$X`` (any expression, the same
wherever the name stands again), ``...`` (any run of arguments, elements or
statements) and ``deep(p)`` (p anywhere inside).  It becomes a chain of joins: a child
meets its parent by key, ``deep`` by a range of places, and equal names by equal
digests.  Parts of a pattern without holes are one row, found by their digest.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt

_HOLE = "HOLE_"
#: Fields that say nothing about what code does.
_IGNORED = {"ctx", "type_comment", "type_ignores", "kind", "type_params", "simple"}
#: Fields that a pattern leaves open where it says nothing.
_OPEN = {"decorator_list", "returns", "annotation", "keywords", "orelse", "finalbody", "defaults", "kw_defaults", "kwonlyargs", "posonlyargs", "vararg", "kwarg"}
NODES = "path string, pre int, last int, parent int, slot string, pos int, kind string, label string, digest string, sizes map<string,int>, line_no int"


def _label(node: ast.AST) -> str | None:
    """The name or value that a node itself has."""
    if isinstance(node, ast.Constant):
        return f"{type(node.value).__name__}:{node.value!r}"
    return next((str(v) for n in ("id", "attr", "name", "arg", "module", "level", "rest") if isinstance(v := getattr(node, n, None), str)), None)


def _digest(node: ast.AST) -> str:
    """The same for trees that differ in their places only."""
    parts = [type(node).__name__, _label(node) or ""]
    for name, value in ast.iter_fields(node):
        if name in _IGNORED or isinstance(value, (str, int, float, complex, bytes)) or value is None:
            continue
        items = value if isinstance(value, list) else [value]
        parts.append(name + "(" + ",".join(_digest(x) if isinstance(x, ast.AST) else repr(x) for x in items) + ")")
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def nodes(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The node rows of each file; one that does not parse, is null or empty has none.
    One narrow pass."""

    def rows_of(where: str, source: str) -> list[tuple]:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return []
        out: list[list] = []

        def visit(node: ast.AST, parent: int, slot: str, pos: int, line: int) -> tuple[int, str]:
            at, line = len(out), getattr(node, "lineno", line)
            out.append([])
            sizes, parts = {}, [type(node).__name__, _label(node) or ""]
            for name, value in ast.iter_fields(node):
                if name in _IGNORED or not isinstance(value, (list, ast.AST)):
                    continue
                items = value if isinstance(value, list) else [value]
                sizes[name] = len(items)
                parts.append(name + "(" + ",".join(visit(x, at, name, i, line)[1] if isinstance(x, ast.AST) else repr(x) for i, x in enumerate(items)) + ")")
            digest = hashlib.md5("|".join(parts).encode()).hexdigest()
            out[at] = [where, at, len(out) - 1, parent, slot, pos, type(node).__name__, _label(node), digest, list(sizes.items()), line]
            return at, digest

        try:
            visit(tree, -1, "", 0, 0)
        except RecursionError:
            return []
        return out

    kinds = [pa.string(), *[pa.int32()] * 3, pa.string(), pa.int32(), *[pa.string()] * 3, pa.map_(pa.string(), pa.int32()), pa.int32()]
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows_of(p, t)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    own = files.where(F.col(text).isNotNull()).select(F.col(path).cast("string"), F.col(text).cast("string"))
    return dealt(own).mapInArrow(run, NODES)


@dataclass
class Atom:
    """A node that a pattern asks for."""

    parent: int | None
    slot: str | None = None  # None: anywhere below the parent
    kind: str | None = None
    label: str | None = None
    digest: str | None = None
    hole: str | None = None
    pos: int | None = None
    from_end: int | None = None
    after: int | None = None  # the atom that it follows in the same list
    sizes: dict = field(default_factory=dict)


def _is_any(node) -> bool:
    node = node.value if isinstance(node, ast.Expr) else node
    return isinstance(node, ast.Constant) and node.value is Ellipsis


def _hole(node) -> str | None:
    node = node.value if isinstance(node, ast.Expr) else node
    return node.id if isinstance(node, ast.Name) and node.id.startswith(_HOLE) else None


def _deep(node):
    return node.args[0] if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "deep" and len(node.args) == 1 else None


def _concrete(node: ast.AST) -> bool:
    return not any(_is_any(n) or _hole(n) or _deep(n) is not None or str(_label(n)).startswith(_HOLE) for n in ast.walk(node))


def compiled(pattern: str) -> list[Atom]:
    """The atoms of a pattern, parents first; the first ones of a run of statements
    have no parent and follow each other."""
    body = ast.parse(re.sub(r"\$([A-Z][A-Z0-9_]*)", _HOLE + r"\1", pattern)).body
    atoms: list[Atom] = []

    def add(node: ast.AST, parent: int | None, slot: str | None, **place) -> int:
        inner = _deep(node)
        if inner is None and isinstance(node, ast.Expr):
            inner = _deep(node.value)
        if inner is not None:
            return add(inner, parent, None)
        at = len(atoms)
        if _hole(node):
            atoms.append(Atom(parent, slot, hole=_hole(node), **place))
            return at
        if _concrete(node) and not isinstance(node, (ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef)):
            atoms.append(Atom(parent, slot, kind=type(node).__name__, digest=_digest(node), **place))
            return at
        label = _label(node)
        named = label is not None and label.startswith(_HOLE)
        atoms.append(Atom(parent, slot, kind=type(node).__name__, label=None if named else label, **place))
        for name, value in ast.iter_fields(node):
            if name in _IGNORED or (name in _OPEN and not value) or not isinstance(value, (list, ast.AST)):
                continue
            if isinstance(value, ast.AST):
                if not _is_any(value):
                    add(value, at, name)
                continue
            run(value, at, name)
        return at

    def run(items: list, at: int | None, name: str | None) -> None:
        gaps = [i for i, x in enumerate(items) if _is_any(x)]
        free = name in ("keywords", "names")  # in any order
        if at is not None and not gaps and not free:
            atoms[at].sizes[name] = len(items)
        before = None
        for i, x in enumerate(items):
            if _is_any(x):
                continue
            place: dict = {}
            if not free:
                if at is not None and (not gaps or i < gaps[0]):
                    place["pos"] = i
                elif at is not None and i > gaps[-1]:
                    place["from_end"] = len(items) - i
                if before is not None and "pos" not in place:
                    place["after"] = before[0]
                    if at is None and i == before[1] + 1:
                        place["pos"] = -1  # right behind it
            before = (add(x, at, name, **place), i)

    body = body[0].value if len(body) == 1 and isinstance(body[0], ast.Expr) else body
    if isinstance(body, list) and len(body) > 1:
        run(body, None, None)
    else:
        add(body[0] if isinstance(body, list) else body, None, None)
    return atoms


def _wanted(n: DataFrame, atom: Atom) -> DataFrame:
    for name in ("kind", "label", "digest"):
        if getattr(atom, name) is not None:
            n = n.where(F.col(name) == getattr(atom, name))
    for slot, size in atom.sizes.items():
        n = n.where(F.coalesce(F.try_element_at("sizes", F.lit(slot)), F.lit(0)) == size)
    if atom.pos is not None and atom.pos >= 0:
        n = n.where(F.col("pos") == atom.pos)
    return n if atom.slot is None or atom.slot == "" else n.where(F.col("slot") == atom.slot)


_KEPT = ["pre", "last", "parent", "slot", "pos", "digest", "line_no"]


def matches(tree: DataFrame, pattern: str) -> DataFrame:
    """(path, pre, line_no) of each place where the pattern stands: one row for each
    first node, whatever the ways in which its parts can be found.  ``tree``: ``nodes``."""
    atoms = compiled(pattern)
    found, holes = None, {}
    for i, a in enumerate(atoms):
        size = [F.coalesce(F.try_element_at("sizes", F.lit(a2.slot)), F.lit(0)).alias(f"n{i}_{j}") for j, a2 in enumerate(atoms) if a2.parent == i and a2.from_end is not None]
        own = _wanted(tree, a).select(F.col("path").alias(f"path{i}"), *[F.col(c).alias(f"{c}{i}") for c in _KEPT], *size)
        if found is None:
            found = own
        else:
            on: list[Column] = [F.col("path0") == F.col(f"path{i}")]
            if a.parent is not None and a.slot is not None:
                on.append(F.col(f"parent{i}") == F.col(f"pre{a.parent}"))
            elif a.parent is not None:
                on += [F.col(f"pre{i}") >= F.col(f"pre{a.parent}"), F.col(f"pre{i}") <= F.col(f"last{a.parent}")]
            else:  # a later statement of the same block
                on += [F.col(f"parent{i}") == F.col(f"parent{a.after}"), F.col(f"slot{i}") == F.col(f"slot{a.after}")]
            if a.from_end is not None:
                on.append(F.col(f"pos{i}") == F.col(f"n{a.parent}_{i}") - a.from_end)
            if a.after is not None:
                gap = F.col(f"pos{i}") - F.col(f"pos{a.after}")
                on.append(gap == 1 if a.pos == -1 else gap > 0)
            if a.hole in holes:
                on.append(F.col(f"digest{i}") == F.col(f"digest{holes[a.hole]}"))
            found = found.join(own, reduce(lambda x, y: x & y, on)).drop(f"path{i}")
        if a.hole:
            holes.setdefault(a.hole, i)
    return found.select(F.col("path0").alias("path"), F.col("pre0").alias("pre"), F.col("line_no0").alias("line_no")).distinct()


#: Rules of this engine by pack: name, severity, pattern.
PACKS = {
    "correctness": [("self_comparison", "ERROR", "$X == $X"), ("self_assignment", "WARNING", "$X = $X")],
    "security": [("shell_command", "ERROR", "subprocess.run(..., shell=True)"), ("joined_query", "CRITICAL", "$Q = $A + $B\n...\n$C.execute($Q)")],
    "errors": [("swallowed_error", "WARNING", "try:\n    ...\nexcept $E:\n    pass")],
    "performance": [("index_loop", "INFO", "for $I in range(len($S)):\n    deep($S[$I])")],
    "style": [("returned_condition", "INFO", "if $C:\n    return True\nelse:\n    return False")],
}


def structural_findings(files: DataFrame, packs: dict = PACKS) -> DataFrame:
    """(path, line_no, pack, rule, severity) of the places that a rule's pattern fits.
    The node rows are written once for all rules."""
    from ..sources.tables import written

    tree = written(nodes(files), "nodes")
    parts = [matches(tree, p).select("path", "line_no", F.lit(pack).alias("pack"), F.lit(name).alias("rule"), F.lit(severity).alias("severity")) for pack, rules in packs.items() for name, severity, p in rules]
    return reduce(DataFrame.unionByName, parts)
