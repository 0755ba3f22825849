"""Records of tools' text output: logs, blame, scanners, coverage, fuzzing.

Each takes rows of (path, text), one whole file a row.  A file whose records
span lines is cut by a running count of its record heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCAN = "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string,metadata:struct<category:string>>>>"
#: Words of a rule id that tell its category, the first wins.
CATEGORIES = [("performance", "performance"), ("correctness", "correctness"), ("style", "code_quality"), ("maintainab", "code_quality"), ("security", "security")]
#: Signals and what they mean.
SIGNALS = {6: "abort", 8: "arithmetic", 11: "segmentation", 4: "illegal"}


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))


def records(files: DataFrame, head: Column) -> DataFrame:
    """The lines with ``rec``: how many lines up to here satisfy ``head``; lines
    before the first are left out."""
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return _lines(files).withColumn("rec", F.sum(F.when(head, 1).otherwise(0)).over(w)).where("rec > 0")


def _after(prefix: str) -> Column:
    """What follows the prefix in the record's line that starts with it."""
    return F.max(F.when(F.col("line").startswith(prefix), F.substring("line", len(prefix) + 1, 1 << 30)))


def commits(files: DataFrame) -> DataFrame:
    """(commit, author, day, file, changed) from a log of ``hash|author|date|subject``
    heads and numstat lines; ``-`` of binary files counts 0."""
    head, stat = r"^([0-9a-f]{7,40})\|([^|]*)\|([^|]*)\|(.*)$", r"^(\d+|-)\t(\d+|-)\t(.+)$"
    own = records(files, F.col("line").rlike(head))
    w = Window.partitionBy("path", "rec")
    part = lambda i: F.max(F.when(F.col("line").rlike(head), F.regexp_extract("line", head, i))).over(w)
    number = lambda i: F.coalesce(F.expr(f"try_cast(regexp_extract(line, '{stat.replace(chr(92), chr(92) * 2)}', {i}) as bigint)"), F.lit(0))
    own = own.select("line", part(1).alias("commit"), part(2).alias("author"), F.substring(part(3), 1, 10).alias("day")).where(F.col("line").rlike(stat))
    return own.select("commit", "author", "day", F.regexp_extract("line", stat, 3).alias("file"), (number(1) + number(2)).alias("changed"))


def blame(files: DataFrame) -> DataFrame:
    """(path, line_no, commit, author, time, content) of a porcelain listing."""
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    own = records(files, F.col("line").rlike(head)).groupBy("path", "rec")
    first = lambda i: F.max(F.when(F.col("line").rlike(head), F.regexp_extract("line", head, i)))
    return own.agg(first(2).cast("int").alias("line_no"), first(1).alias("commit"), _after("author ").alias("author"), _after("author-time ").cast("long").alias("time"), _after("\t").alias("content")).drop("rec")


def scan_findings(files: DataFrame) -> DataFrame:
    """(file, line_no, rule, severity, category, message) of scanner JSON; a file
    that is no such JSON gives none.  Severities other than ERROR and INFO are
    WARNING; the category is the given one, else by the rule's name."""
    r = files.select(F.inline(F.from_json("text", SCAN)["results"]))
    severity = F.upper(F.col("extra.severity"))
    category, rule = F.lit("security"), F.lower(F.col("check_id"))
    for word, name in reversed(CATEGORIES):
        category = F.when(rule.contains(word), name).otherwise(category)
    return r.select(
        F.col("path").alias("file"), F.col("start.line").alias("line_no"), F.col("check_id").alias("rule"),
        F.when(severity.isin("ERROR", "INFO"), severity).otherwise("WARNING").alias("severity"), F.coalesce("extra.metadata.category", category).alias("category"), F.col("extra.message").alias("message"),
    )


def lcov(files: DataFrame) -> DataFrame:
    """(file, n_lines, hit, functions, called, percent) per SF record; a record
    without lines has 0 percent."""
    hit = F.regexp_extract("line", r"^DA:\d+,(\d+)", 1).cast("long") > 0
    own = records(files, F.col("line").startswith("SF:")).groupBy("path", "rec")
    is_ = lambda p: F.col("line").startswith(p)
    called = F.expr("try_cast(regexp_extract(line, '^FNDA:([0-9]+),', 1) as bigint)") > 0
    out = own.agg(_after("SF:").alias("file"), F.count_if(is_("DA:")).alias("n_lines"), F.count_if(is_("DA:") & hit).alias("hit"), F.count_if(is_("FN:")).alias("functions"), F.count_if(is_("FNDA:") & called).alias("called"))
    return out.withColumn("percent", F.round(F.coalesce(F.try_divide(F.col("hit") * 100, F.col("n_lines")), F.lit(0.0)), 4)).drop("path", "rec")


def key_values(files: DataFrame, keys: list[str]) -> DataFrame:
    """(path, one double column per key) of ``key : value`` lines; a missing or
    unreadable value is 0."""
    kv = _lines(files).select("path", F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("k"), F.expr("try_cast(rtrim('%', trim(split_part(line, ':', 2))) as double)").alias("v"))
    return kv.groupBy("path").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)).alias(k) for k in keys])


def crash_name(name: Column) -> Column:
    """``id:..,sig:..,op:..`` as a struct (id, signal, kind, op)."""
    m = F.str_to_map(name, F.lit(","), F.lit(":"))
    sig = F.try_element_at(m, F.lit("sig")).cast("int")
    known = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])
    return F.struct(F.try_element_at(m, F.lit("id")).alias("id"), sig.alias("signal"), F.coalesce(F.try_element_at(known, sig), F.lit("unknown")).alias("kind"), F.try_element_at(m, F.lit("op")).alias("op"))


def traces(files: DataFrame) -> DataFrame:
    """(path, kind, frame, depth, crash): the sanitizer's kind of error, the first
    named frame, the number of frames, and a digest of kind and frame.  The
    lines between the error and the summary are taken; narrow."""
    inside = F.split_part(F.regexp_extract("text", r"(?s)(ERROR: \w+Sanitizer: .*)", 1), F.lit("SUMMARY:"), F.lit(1))
    frames = F.filter(F.transform(F.split(inside, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("#"))
    named = F.filter(F.transform(frames, lambda x: F.regexp_extract(x, r" in ([^ (]+)", 1)), lambda x: (x != "") & (x != "??"))
    own = files.select("path", F.regexp_extract(inside, r"Sanitizer: ([\w-]+)", 1).alias("kind"), F.coalesce(F.get(named, F.lit(0)), F.lit("unknown")).alias("frame"), F.size(frames).alias("depth"))
    return own.where("kind <> ''").withColumn("crash", F.substring(F.md5(F.concat_ws(":", "kind", "frame")), 1, 12))


def crash_severity(kind: Column) -> Column:
    """The severity of a sanitizer's kind of error."""
    return F.when(kind.rlike("heap-buffer-overflow|use-after-free|double-free|stack-buffer"), "critical").when(kind.rlike("overflow|SEGV|segmentation"), "high").when(kind.rlike("null|leak|abort"), "medium").otherwise("low")


def unique_crashes(found: DataFrame) -> DataFrame:
    """The first (by path) of each crash and how often it occurs: one shuffle
    of (crash, path), reduced in the task before."""
    first = F.min(F.struct("path", "kind", "frame"))
    out = found.groupBy("crash").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    return out.select("crash", "f.path", "f.kind", "f.frame", "n", crash_severity(F.col("f.kind")).alias("severity"))


def coverage_totals(files: DataFrame) -> DataFrame:
    """(path, covered, statements, percent) of a coverage JSON's totals; absent
    values are 0."""
    t = F.from_json("text", "totals struct<covered_lines:bigint,num_statements:bigint,percent_covered:double>")["totals"]
    return files.select("path", *[F.coalesce(t[k], F.lit(0)).alias(n) for k, n in (("covered_lines", "covered"), ("num_statements", "statements"))], F.round(F.coalesce(t["percent_covered"], F.lit(0.0)), 4).alias("percent"))


def packages(files: DataFrame) -> DataFrame:
    """(path, package) distinct: requirement lists, package JSON, crate manifests,
    by the file's name."""
    name = F.element_at(F.split("path", "/"), -1)
    lines = F.transform(F.split("text", "\r?\n"), lambda x: F.trim(x))
    wanted = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    listed = F.transform(wanted, lambda x: F.trim(F.regexp_extract(x, r"^([A-Za-z0-9._-]+)", 1)))
    deps = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
    js = F.from_json("text", deps)
    none = F.array().cast("array<string>")
    keys = F.concat(*[F.coalesce(F.map_keys(js[k]), none) for k in ("dependencies", "devDependencies", "peerDependencies")])
    crate = F.regexp_extract_all(F.regexp_extract("text", r"(?s)\[dependencies\]([^\[]*)", 1), F.lit(r"(?m)^([\w-]+) *="), 1)
    found = F.when(name.rlike(r"^requirements.*\.txt$"), listed).when(name == "package.json", keys).when(name == "Cargo.toml", crate).otherwise(none)
    return files.select("path", F.explode(F.array_distinct(found)).alias("package"))
