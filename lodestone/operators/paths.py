"""Paths as rows: language by suffix, exclusion, glob rules, indent."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffix, language, priority (the higher wins a shared suffix).
LANGUAGES = [
    (".py", "python", 10), (".pyi", "python", 10), (".js", "javascript", 10), (".jsx", "javascript", 10), (".ts", "typescript", 10), (".tsx", "typescript", 10), (".java", "java", 10),
    (".go", "go", 10), (".rs", "rust", 10), (".c", "c", 10), (".h", "c", 10), (".h", "cpp", 5), (".cpp", "cpp", 10), (".cs", "csharp", 10), (".rb", "ruby", 10), (".php", "php", 10), (".html", "html", 10),
]


def suffix(path: Column) -> Column:
    """The last suffix with its dot in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def with_language(rows: DataFrame, path: str, languages: list = LANGUAGES) -> DataFrame:
    """``rows`` with ``language`` ('unknown' for other suffixes and null paths):
    a lookup in a constant map, so nothing is joined or shuffled."""
    best: dict[str, tuple[int, str]] = {}
    for s, name, priority in languages:
        best[s] = max(best.get(s, (-1, "")), (priority, name))
    known = F.create_map(*[F.lit(x) for s, (_, name) in best.items() for x in (s, name)])
    return rows.withColumn("language", F.coalesce(F.try_element_at(known, suffix(F.col(path))), F.lit("unknown")))


def excluded(path: Column, parts: list[str], suffixes: list[str]) -> Column:
    """Whether a component is in ``parts`` or the suffix in ``suffixes``."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, parts))) | suffix(path).isin(suffixes)


def glob_regex(glob: str) -> str:
    """A glob (*, ?, [..]) as an anchored regular expression."""
    out = ""
    for piece in re.findall(r"\[!?[^\]]+\]|.", glob, re.S):
        if len(piece) > 1:
            out += "[^" + piece[2:] if piece[1] == "!" else piece
        else:
            out += {"*": ".*", "?": "."}.get(piece, re.escape(piece))
    return f"^{out}$"


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether a glob fits a component of the path, or the whole path."""
    rule = "|".join(map(glob_regex, globs))
    return F.exists(F.split(path, "/"), lambda p: p.rlike(rule)) | path.rlike(rule)


def nesting(line: Column) -> Column:
    """Leading white space in steps of four."""
    return F.floor(F.length(F.regexp_extract(line, r"^[ \t]*", 0)) / 4)
