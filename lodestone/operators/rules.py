"""Rule packs: patterns by line and over whole texts, as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import code

#: Name, severity, pattern, tried on each line without regard to case.
LINE_RULES = [
    ("sql_injection", "HIGH", r"""execute\s*\(\s*["'].*%s"""),
    ("sql_injection", "HIGH", r"cursor\.execute\s*\([^,]+\s*\+"),
    ("sql_injection", "HIGH", r"""raw\s*\(\s*["'].*\{"""),
    ("command_injection", "HIGH", r"os\.system\s*\("),
    ("command_injection", "HIGH", r"subprocess\.(call|run|Popen)\s*\([^)]*\+[^)]*\)"),
    ("command_injection", "HIGH", r"eval\s*\("),
    ("command_injection", "HIGH", r"exec\s*\("),
    ("path_traversal", "HIGH", r"open\s*\([^)]*\+[^)]*\)"),
    ("path_traversal", "HIGH", r"\.\./"),
    ("crypto", "MEDIUM", r"MD5"),
    ("crypto", "MEDIUM", r"SHA1"),
    ("crypto", "MEDIUM", r"DES"),
    ("crypto", "MEDIUM", r"RC4"),
    ("crypto", "MEDIUM", r"""password\s*=\s*["'][^"']+["']"""),
    ("crypto", "MEDIUM", r"""api_key\s*=\s*["'][^"']+["']"""),
    ("crypto", "MEDIUM", r"""secret\s*=\s*["'][^"']+["']"""),
    ("access_control", "HIGH", r"is_admin\s*=\s*request"),
    ("access_control", "HIGH", r"role\s*=\s*request"),
    ("access_control", "HIGH", r"@app\.route.*admin.*without.*decorator"),
    ("authentication", "HIGH", r"""password\s*==\s*["'][^"']+["']"""),
    ("authentication", "HIGH", r"""if\s+user\s*==\s*["']admin["']"""),
    ("request_forgery", "HIGH", r"requests\.get\s*\([^)]*\+[^)]*\)"),
    ("request_forgery", "HIGH", r"urllib\.request\.urlopen\s*\([^)]*\+[^)]*\)"),
    ("request_forgery", "HIGH", r"http://\{"),
]
#: The same, tried over whole texts; a match may run over lines.
TEXT_RULES = [
    ("hardcoded_secrets", "ERROR", r"""(?:password|passwd|pwd|secret|api_key|apikey|token|auth)\s*=\s*['"][^'"]+['"]"""),
    ("hardcoded_secrets", "CRITICAL", r"""(?:AWS_SECRET|PRIVATE_KEY|ENCRYPTION_KEY)\s*=\s*['"][^'"]+['"]"""),
    ("sql_injection", "CRITICAL", r"""(?:execute|query|cursor\.execute)\s*\(\s*f['"]"""),
    ("sql_injection", "ERROR", r"(?:SELECT|INSERT|UPDATE|DELETE|DROP).*\+.*\%"),
    ("command_injection", "CRITICAL", r"os\.system\s*\([^)]*\%"),
    ("command_injection", "ERROR", r"subprocess\.(?:call|run|Popen)\s*\([^)]*shell\s*=\s*True"),
    ("path_traversal", "ERROR", r"open\s*\([^)]*request\."),
    ("unsafe_deserialization", "CRITICAL", r"pickle\.(?:load|loads)\s*\("),
    ("unsafe_deserialization", "CRITICAL", r"eval\s*\([^)]*\)"),
    ("unsafe_deserialization", "CRITICAL", r"exec\s*\([^)]*\)"),
    ("weak_crypto", "WARNING", r"hashlib\.(?:md5|sha1)\s*\("),
    ("weak_crypto", "WARNING", r"(?:DES|RC4|Blowfish)"),
]


def literal(pattern: str) -> str:
    """The longest word that every match of a pattern has, in lower case ('' for none):
    a cheap test before the pattern."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)[?*]?|\[[^\]]*\]|\\.", " ", pattern)
    return max(re.findall(r"[A-Za-z_0-9]{2,}(?![?*])", plain), key=len, default="").lower()


def _fits(text: Column, low: Column, pattern: str) -> Column:
    test = text.rlike("(?i)" + pattern)
    return low.contains(literal(pattern)) & test if literal(pattern) else test


def line_hits(docs: DataFrame, rules: list = LINE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, n_rule, rule, severity): each line with each rule that fits it, in
    one pass over an array of tests.  A crypto rule on a line with "password" is
    critical.  Null texts give none; equal rows give equal hits."""
    line, low = F.col("line"), F.col("low")
    worse = low.contains("password")

    def test(i: int, name: str, severity: str, pattern: str) -> Column:
        level = F.when(worse, "CRITICAL").otherwise(severity) if name == "crypto" else F.lit(severity)
        return F.when(_fits(line, low, pattern), F.struct(F.lit(i).alias("n_rule"), F.lit(name).alias("rule"), level.alias("severity")))

    tests = F.array(*[test(i, *r) for i, r in enumerate(rules)])
    lines = code.lines(docs, id_col, text_col).withColumn("low", F.lower("line"))
    return lines.select(id_col, "line_no", F.inline(F.filter(tests, lambda x: x.isNotNull())))


def line_counts(docs: DataFrame, rules: list = LINE_RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with ``hits``, the number of (line, rule) pairs that fit.  Narrow: a rule
    is tried on the lines that have its literal."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    some = docs.withColumn("__some", F.transform(lines, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low"))))
    fits = lambda p: lambda x: _fits(x["x"], x["low"], p)
    hits = sum((F.size(F.filter("__some", fits(p))) for _, _, p in rules), F.lit(0)).cast("long")
    return some.withColumn("hits", F.when(F.size("__some") > 0, hits).otherwise(F.lit(0).cast("long"))).drop("__some")


def text_hits(docs: DataFrame, rules: list = TEXT_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_rule, rule, severity, line_start, line_end) of every match over whole
    texts.  The text between matches and the matches, counted for line feeds, give
    the lines; narrow.  Null texts give none."""
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def found(i: int, name: str, severity: str, pattern: str) -> Column:
        rule = "(?i)" + pattern
        hits = F.regexp_extract_all(text_col, F.lit(rule), 0)
        gaps = F.transform(F.split(text_col, rule, -1), breaks)
        own = F.transform(hits, breaks)

        def row(k: Column) -> Column:
            before = F.aggregate(F.slice(gaps, 1, k + 1), F.lit(1), lambda a, x: a + x)
            start = before + F.aggregate(F.slice(own, 1, k), F.lit(0), lambda a, x: a + x)
            return F.struct(F.lit(i).alias("n_rule"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), start.alias("line_start"), (start + own[k]).alias("line_end"))

        none = F.array().cast("array<struct<n_rule:int,rule:string,severity:string,line_start:int,line_end:int>>")
        fits = F.col(text_col).rlike(rule)
        if literal(pattern):
            fits = F.col("__low").contains(literal(pattern)) & fits
        return F.when(fits, F.transform(F.sequence(F.lit(0), F.size(hits) - 1), row)).otherwise(none)

    every = F.concat(*[found(i, *r) for i, r in enumerate(rules)])
    return docs.where(F.col(text_col).isNotNull()).withColumn("__low", F.lower(text_col)).select(id_col, F.inline(every))


def user_hits(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, rule, severity) for rules that are rows (rule, severity,
    pattern): user rules are read once into the plan, in the order of their names."""
    rows = [(r["rule"], r["severity"], r["pattern"]) for r in rules.orderBy("rule", "pattern").collect()]  # a rule file
    if not rows:
        return code.lines(docs, id_col, text_col).select(id_col, "line_no", F.lit("").alias("rule"), F.lit("").alias("severity")).limit(0)
    tests = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in rows])
    return code.lines(docs, id_col, text_col).select(id_col, "line_no", F.inline(F.filter(tests, lambda x: x.isNotNull())))
