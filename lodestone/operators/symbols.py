"""Symbols, imports and calls of sources by line patterns, for five languages.

All of it is one narrow pass over the lines of each file; only the class of a
method needs the lines of a file in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import code

#: Patterns of this engine: language, kind, pattern with the name as group 1.
PATTERNS = [
    ("python", "function", r"^(?:async +)?def +(\w+)"),
    ("python", "method", r"^[ \t]+(?:async +)?def +(\w+)"),
    ("python", "class", r"^[ \t]*class +(\w+)"),
    ("javascript", "function", r"^[ \t]*(?:export +)?(?:async +)?function *\*? *(\w+)"),
    ("javascript", "function", r"^[ \t]*(?:export +)?(?:const|let|var) +(\w+) *= *(?:async *)?\([^)]*\) *=>"),
    ("javascript", "class", r"^[ \t]*(?:export +)?(?:default +)?class +(\w+)"),
    ("rust", "function", r"^[ \t]*(?:pub(?:\([a-z]+\))? +)?(?:async +)?fn +(\w+)"),
    ("rust", "struct", r"^[ \t]*(?:pub(?:\([a-z]+\))? +)?struct +(\w+)"),
    ("rust", "enum", r"^[ \t]*(?:pub(?:\([a-z]+\))? +)?enum +(\w+)"),
    ("rust", "trait", r"^[ \t]*(?:pub(?:\([a-z]+\))? +)?trait +(\w+)"),
    ("rust", "import", r"^[ \t]*use +([\w:]+)"),
    ("go", "function", r"^func +(\w+)"),
    ("go", "method", r"^func +\([^)]*\) *(\w+)"),
    ("go", "struct", r"^type +(\w+) +struct"),
    ("go", "interface", r"^type +(\w+) +interface"),
    ("go", "import", r"^(?:import)?[ \t]+\"([^\"]+)\""),
    ("java", "class", r"^[ \t]*(?:public +|final +|abstract +)*(?:class|interface|enum) +(\w+)"),
    ("java", "method", r"^[ \t]+(?:public|private|protected) +(?:static +|final +)*[\w<>\[\], ]+ +(\w+) *\("),
    ("java", "import", r"^import +(?:static +)?([\w.*]+);"),
]

#: Words before a bracket that are no calls.
NO_CALLS = ["if", "for", "while", "with"]


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("path", "language", (F.col("p") + 1).alias("line_no"), "line")


def by_pattern(files: DataFrame, patterns: list = PATTERNS) -> DataFrame:
    """(path, line_no, kind, name) of ``files`` (path, language, text); a line
    gives one row for each pattern of its language that fits, a null text none."""
    tests = [F.when((F.col("language") == lang) & F.col("line").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", p, 1).alias("name"))) for lang, kind, p in patterns]
    found = _lines(files).withColumn("s", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    return found.select("path", "line_no", "s.kind", "s.name")


def _aliases(names: Column) -> Column:
    """Each of the names of a comma list: the alias, where it has one."""
    parts = F.transform(F.split(names, ","), lambda x: F.trim(F.regexp_replace(x, r"[()]", "")))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.regexp_extract(x, r"(\S+)$", 1))


def imports(files: DataFrame) -> DataFrame:
    """(path, line_no, module, name) for Python and JavaScript, a row for each
    imported name; an alias stands for the name."""
    line, lang = F.col("line"), F.col("language")
    forms = [
        ("python", r"^[ \t]*from +([\w.]+) +import +(.+)$", 1, 2),
        ("python", r"^[ \t]*import +([\w.]+)(.*)$", 1, 0),
        ("javascript", r"^[ \t]*import *\{([^}]*)\} *from *['\"]([^'\"]+)", 2, 1),
        ("javascript", r"^[ \t]*import +(\w+) +from *['\"]([^'\"]+)", 2, 1),
    ]
    tests = []
    for language, pattern, module, names in forms:
        listed = F.regexp_extract(line, pattern, names) if names else F.regexp_replace(line, r"^[ \t]*import +", "")
        tests.append(F.when((lang == language) & line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, module).alias("module"), _aliases(listed).alias("names"))))
    found = _lines(files).withColumn("i", F.coalesce(*tests)).where("i is not null")
    return found.select("path", "line_no", "i.module", F.explode("i.names").alias("name"))


def calls(files: DataFrame) -> DataFrame:
    """(path, line_no, receiver, name, args) of the first call of each line, one
    with a receiver before a bare one; ``args`` are joined by commas.  Lines that
    define something have none."""
    bound, bare = r"(\w+)\.(\w+)\(([^()]*)\)", rf"(?<![\w.])(?!(?:{'|'.join(NO_CALLS)}|def|class)\b)(\w+)\(([^()]*)\)"
    line = F.col("line")
    defined = F.lit(False)
    for lang, kind, p in PATTERNS:
        if kind in ("function", "method", "class"):
            defined = defined | ((F.col("language") == lang) & line.rlike(p))
    of = lambda p, r, n, a: F.struct((F.regexp_extract(line, p, r) if r else F.lit("")).alias("receiver"), F.regexp_extract(line, p, n).alias("name"), F.regexp_extract(line, p, a).alias("args"))
    c = F.when(~defined & line.rlike(bound), of(bound, 1, 2, 3)).when(~defined & line.rlike(bare), of(bare, 0, 1, 2))
    args = F.array_join(F.filter(F.transform(F.split("c.args", ","), lambda x: F.trim(x)), lambda x: x != ""), ",")
    return _lines(files).withColumn("c", c).where("c is not null").select("path", "line_no", "c.receiver", "c.name", args.alias("args"))


def classes(files: DataFrame) -> DataFrame:
    """(path, class, bases, methods) of top-level Python classes; an indented
    def belongs to the class last seen (a forward fill over the file's lines)."""
    head = r"^class +(\w+)(?:\(([^)]*)\))?"
    own = _lines(files.where("language = 'python'"))
    top = F.when(F.col("line").rlike(head), F.struct(F.regexp_extract("line", head, 1).alias("class"), F.regexp_extract("line", head, 2).alias("bases")))
    left = F.when(F.col("line").rlike(r"^(?:async +)?def "), F.struct(F.lit("").alias("class"), F.lit("").alias("bases")))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("c", F.last(F.coalesce(top, left), ignorenulls=True).over(w))
    method = F.when(F.col("line").rlike(r"^[ \t]+(?:async +)?def "), F.struct("line_no", F.regexp_extract("line", r"def +(\w+)", 1).alias("m")))
    listed = F.transform(F.array_sort(F.collect_list(method)), lambda x: x["m"])
    return own.where("c.class <> ''").groupBy("path", F.col("c.class").alias("class"), F.col("c.bases").alias("bases")).agg(F.array_join(listed, ",").alias("methods"))


def block_ends(files: DataFrame, reach: int = 100) -> DataFrame:
    """(path, line_no, end_line) of indented blocks: each line that ends in a
    colon, and the last written line before the indent falls back, looking at
    most ``reach`` lines ahead.  Narrow: the lines stay in their file's row."""
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.length(F.regexp_extract(x, r"^[ \t]*", 0)).alias("d"), F.trim(x).alias("t")))
    own = files.select("path", F.filter(rows, lambda r: (r["t"] != "") & ~r["t"].startswith("#")).alias("r"))
    own = own.select("path", "r", F.posexplode("r").alias("i", "h")).where(F.col("h.t").endswith(":"))
    ahead = F.filter(F.slice("r", F.col("i") + 2, F.size("r")), lambda r: r["n"] <= F.col("h.n") + reach)
    out = F.get(F.filter(ahead, lambda r: r["d"] <= F.col("h.d")), F.lit(0))["n"]
    last = F.array_max(F.transform(F.filter(ahead, lambda r: out.isNull() | (r["n"] < out)), lambda r: r["n"]))
    return own.select("path", F.col("h.n").alias("line_no"), F.coalesce(last, F.col("h.n")).alias("end_line"))


def indent_rule(docs: DataFrame, depth: int = 4) -> DataFrame:
    """Lines nested deeper than ``depth`` steps of four, with 100 characters."""
    from . import paths

    return code.lines(docs).where(paths.nesting(F.col("line")) > depth).withColumn("line", F.substring("line", 1, 100))
