"""Reports: unions of findings, counters, bundles, stores of rules and of vectors."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: The severities of a scan report; any other counts as INFO.
LEVELS = ["CRITICAL", "ERROR", "WARNING", "INFO"]
#: Directories and names that reports leave out.
LEFT_OUT = ["docs", "tests", "test", "sandbox", "examples", "demos"]
#: Names of functions and operations that make a target worth fuzzing.
RISKY_NAMES = ["parse", "read", "write", "exec", "eval", "strcpy", "sprintf", "malloc", "free", "memcpy", "memmove", "open", "close", "socket", "connect", "send", "recv"]
RISKY_CALLS = ["strcpy", "strcat", "sprintf", "gets", "scanf", "malloc", "calloc", "realloc", "free", "memcpy", "memmove", "memset"]


def union(*streams: DataFrame) -> DataFrame:
    """All findings, with nulls for the columns that a stream lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def level(severity: Column) -> Column:
    s = F.upper(F.coalesce(severity, F.lit("INFO")))
    return F.when(s.isin(LEVELS), s).otherwise("INFO")


def by_file(findings: DataFrame, file: str = "file", severity: str = "severity") -> DataFrame:
    """(file, n, one column per level): one shuffle of counts."""
    s = level(F.col(severity))
    return findings.groupBy(file).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s == x).alias(x.lower()) for x in LEVELS])


def left_out(path: Column) -> Column:
    """Paths that a report does not show: by directory, Markdown, tests by name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, LEFT_OUT))) | name.rlike(r"\.md$|_test\.(py|js|ts)$|_spec\.(py|js|ts)$|^(test_|spec_)")


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with 1 .. n in the order, which must be total.  The sort is by ranges and
    each range counts its rows; only one number a range is gathered, so no task holds
    all rows.  The sorted rows are written, so both passes see one order."""
    marked = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))  # a row a range
    out = marked.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__n", "__before")


def mean_in_order(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, mean) of doubles, added one by one in the order: the same to the last bit
    however the rows are dealt over files and tasks.  A key's rows stream through a
    window over sorted rows, none is gathered."""
    running = F.sum(value).over(Window.partitionBy(key).orderBy(order, value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = rows.select(key, value, order, running.alias("__sum"))
    return sums.groupBy(key).agg((F.max_by("__sum", F.struct(order, value)) / F.count(value)).alias("mean"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (insert or replace), whole rows by one aggregate."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def chunks(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, lines, text): texts in blocks of ``size`` lines, inside their row."""
    lines = F.split(text_col, "\n")
    made = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int")), lambda i: F.struct(i.alias("chunk"), F.slice(lines, i * size + 1, F.lit(size)).alias("l")))
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.inline(made))
    return rows.select(id_col, "chunk", F.size("l").alias("lines"), F.array_join("l", "\n").alias("text"))


def fuzz_risk(name: Column, code: Column, pointers: Column, external: Column) -> Column:
    """.2 a risky part of the name, .15 a risky operation, .1 a pointer, .2 for calls
    outside; at most 1."""
    low = F.lower(name)
    parts = [F.when(low.contains(x), 0.2).otherwise(0.0) for x in RISKY_NAMES] + [F.when(code.contains(x), 0.15).otherwise(0.0) for x in RISKY_CALLS]
    return F.least(F.lit(1.0), F.round(reduce(lambda a, b: a + b, parts) + pointers * 0.1 + F.when(external, 0.2).otherwise(0.0), 6))


def interesting(name: Column, gain: Column) -> Column:
    """Inputs that brought new coverage: marked so, or by their number."""
    return name.contains("+cov") | F.coalesce(F.regexp_extract(name, r"cov:([0-9]+)", 1).try_cast("int") >= gain * 100, F.lit(False))


def call_snippets(text: Column, most: int = 100) -> Column:
    """``L{n}: line`` of the first lines with both round brackets."""
    rows = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    hits = F.filter(rows, lambda r: r["x"].contains("(") & r["x"].contains(")"))
    return F.transform(F.slice(hits, 1, most), lambda r: F.concat(F.lit("L"), r["n"].cast("string"), F.lit(": "), F.trim(r["x"])))


def unified(rows: DataFrame, before: str, after: str, name: str = "diff") -> DataFrame:
    """``rows`` with the unified diff of two texts, in Arrow batches."""

    @F.pandas_udf("string")
    def made(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), "a", "b", lineterm="")) for x, y in zip(a, b, strict=True)], dtype=object)

    return rows.withColumn(name, made(F.col(before), F.col(after)))


#: The heads of a model's answer.
HEADS = {"HYPOTHESE": "hypothesis", "URSACHE": "cause", "LÖSUNG": "solution", "BETROFFEN": "affected"}


def sections(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with hypothesis, cause, solution, affected and confidence (.8, .7, .6 or
    .5 by the first three).  A line without a head goes on with the last one."""
    heads = "|".join(HEADS)
    out = rows
    for head, name in HEADS.items():
        body = F.regexp_extract(F.col(text_col), rf"(?ms)^{head}:(.*?)(?=^(?:{heads}):|\z)", 1)
        out = out.withColumn(name, F.array_join(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " "))
    filled = sum(((F.col(c) != "").cast("int") for c in ("hypothesis", "cause", "solution")), F.lit(0))
    return out.withColumn("confidence", F.when(filled == 3, 0.8).when(filled == 2, 0.7).when(filled == 1, 0.6).otherwise(0.5))
