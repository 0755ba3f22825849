"""Source texts: lines, rules, complexity, duplicates, normal forms."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import dealt

#: Words that add a path for each line that has them.
KEYWORDS = ["if", "elif", "for", "while", "and", "or", "except", "with"]
#: Rules of this engine: name, severity, pattern.
RULES = [("secret_assignment", "high", r"(?i)\b(api_key|secret|token|password)\s*=\s*[\"'][^\"']{8,}[\"']"), ("card_number", "critical", r"\b[0-9]{16}\b"), ("email_address", "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"), ("ip_address", "low", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b")]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 1, line): narrow."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("__p", "line")).select(id_col, (F.col("__p") + 1).alias("line_no"), "line")


def rule_hits(docs: DataFrame, rules: list = RULES) -> DataFrame:
    """(doc_id, line_no, rule, severity): every rule against every line, in one
    pass over an array of tests (no join)."""
    tests = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in rules])
    hits = lines(docs).withColumn("h", F.explode(F.filter(tests, lambda x: x.isNotNull())))
    return hits.select("doc_id", "line_no", "h.rule", "h.severity")


def text_lines(text: Column) -> Column:
    """The lines of a text as a reader of files counts them: a line feed at the end
    starts no further line; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def word_pattern(word: str) -> str:
    """A whole word, letters and digits of any language counting as part of words."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])"


def complexity(docs: DataFrame, keywords: list[str] = KEYWORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: loc (all lines), comments, cc (1 + lines per keyword, comment lines
    too), mi, score, priority, is_complex.

    One narrow projection over the array of lines, one row for each input row; a
    null text counts as empty; repeated rows stay; extra columns are dropped.
    """
    own = docs.select(id_col, text_lines(F.col(text_col)).alias("l"))
    has = lambda word: lambda x: x.contains(word) & x.rlike(word_pattern(word))
    cc = F.lit(1) + sum((F.size(F.filter("l", has(k))) for k in keywords), F.lit(0))
    comments = F.size(F.filter("l", lambda x: F.trim(x).startswith("#")))
    per = own.select(id_col, F.size("l").cast("long").alias("loc"), comments.cast("long").alias("comments"), cc.cast("long").alias("cc"))
    mi = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(171.0) - F.lit(5.2) * (F.col("loc") / 100) - F.lit(0.23) * F.col("cc") - 16.2))
    per = per.withColumn("mi", F.round(mi, 4))
    per = per.withColumn("score", F.round(F.col("cc") + F.when(F.col("mi") < 50, (F.lit(50) - F.col("mi")) * 0.5).otherwise(0.0), 4))
    priority = F.when((F.col("score") > 50) | (F.col("cc") > 20), "P1").when((F.col("score") > 25) | (F.col("cc") > 15), "P2").otherwise("P3")
    return per.withColumn("priority", priority).withColumn("is_complex", (F.col("cc") > 10) | (F.col("mi") < 50))


def normal_form(text: Column) -> Column:
    """Trimmed lines without blank and comment lines."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.array_join(kept, "\n")


def generalised(line: Column, calls: Column | bool = True) -> Column:
    """Strings in double, then single quotes, integers, then calls (where ``calls``) by
    placeholders; the order matters."""
    c = F.regexp_replace(F.trim(line), r'"[^"]*"', '"..."')
    c = F.regexp_replace(c, r"'[^']*'", "'...' ")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}_])[0-9]+(?![\p{L}\p{N}_])", "N")
    called = F.regexp_replace(c, r"[\p{L}\p{N}_]+\s*\(", "FUNC(")
    return F.when(calls, called).otherwise(c) if isinstance(calls, Column) else called if calls else c


def duplicate_blocks(docs: DataFrame, sizes: range = range(3, 10), least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, n, first_line) of blocks of lines that occur twice or more in a
    text: windows of each size below the text's own, without blank and comment lines,
    where ``least`` lines are left.  A window and a longer one that adds a blank line
    are equal, so a block can be its own copy.  Repeated rows are texts of their own;
    a null text has none.  Only hashes are shuffled."""
    own = docs.select(F.monotonically_increasing_id().alias("__row"), id_col, F.split(text_col, "\n").alias("l")).where("l is not null")

    def of(size: int) -> Column:
        kept = lambda i: F.filter(F.transform(F.slice("l", i, size), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
        hashed = lambda k: F.when(F.size(k) >= least, F.substring(F.md5(F.array_join(k, "\n")), 1, 8))
        made = F.transform(F.sequence(F.lit(1), F.size("l") - size + 1), lambda i: F.struct((i - 1).alias("at"), hashed(kept(i)).alias("block")))
        none = F.array().cast("array<struct<at:int,block:string>>")
        return F.when(F.size("l") > size, F.filter(made, lambda x: x["block"].isNotNull())).otherwise(none)

    rows = own.select("__row", id_col, F.inline(F.concat(*map(of, sizes))))
    return rows.groupBy("__row", id_col, "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_line")).where("n > 1").drop("__row")


def _duplicated(texts: list[str], sizes: range, least: int) -> int:
    """The distinct lines in blocks that occur twice or more in the texts of a document."""
    seen: dict[str, int] = {}
    spans = []
    for text in texts:
        lines = [x.strip(" ") for x in text.split("\n")]
        kept = [x for x in lines if x and not x.startswith("#")]
        before = [0]
        for x in lines:
            before.append(before[-1] + bool(x and not x.startswith("#")))
        names: dict[tuple[int, int], str] = {}  # many windows keep the same lines
        for size in sizes:
            for i in range(len(lines) - size + 1) if len(lines) > size else ():
                span = before[i], before[i + size]
                if span[1] - span[0] >= least:
                    if span not in names:
                        names[span] = hashlib.md5("\n".join(kept[slice(*span)]).encode()).hexdigest()[:8]
                    seen[names[span]] = seen.get(names[span], 0) + 1
        spans.append((kept, names))
    return len({x for kept, names in spans for span, name in names.items() if seen[name] > 1 for x in kept[slice(*span)]})


def duplicate_share(docs: DataFrame, sizes: range = range(3, 10), least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dup, share): the distinct lines in blocks of ``duplicate_blocks`` that occur
    twice or more in a document, and their share of the lines of its text.

    Only the texts are shuffled, once, so that texts of the same id meet; blocks are made
    and counted inside a document."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL("dup long, share double").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows):
            for key, own in itertools.groupby(rows, key=lambda r: r[0]):
                texts = [text for _, text in own]
                dup = _duplicated(texts, sizes, least)
                if dup:
                    yield from ((key, dup, dup / (text.count("\n") + 1)) for text in texts)

        from pyspark.sql.pandas.types import to_arrow_schema

        rows = (r for b in batches for part in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(part, 256).columns), strict=True))
        out, several = to_arrow_schema(schema), found(rows)
        while some := list(itertools.islice(several, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)

    return dealt(rows, "id").sortWithinPartitions("id").mapInArrow(each, schema).select(F.col("id").alias(id_col), "dup", F.round("share", 4).alias("share"))


def numbers(text: Column) -> Column:
    """The magic numbers (from 3 on, without leading zeros) of the lines that are no
    comments."""
    rest = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).startswith("#"))
    return F.regexp_extract_all(F.array_join(rest, "\n"), F.lit(r"(?<![\p{L}\p{N}_])([3-9][0-9]*)(?![\p{L}\p{N}_])"), 1)
