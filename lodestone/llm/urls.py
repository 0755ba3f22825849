"""URL filters by association rules.

Listed rules (a host and a path prefix, allow or block) label the URLs they
fit.  Frequent-pattern growth mines combinations of URL tokens that imply a
label; rules are pruned by support and confidence, and a rule is dropped where a
shorter one with the same label is as confident.  A URL that no listed rule
fits gets the verdict of the mined rules that it contains, found by an inverted
index from each rule's rarest token; without one it is allowed.

Tokens that stand in exactly the same labelled URLs are one item to the miner: a
template of many words that is often repeated is a single item, not as many sets as
its words have subsets.  A URL has the item if it has any of its tokens, which is
what the rules of each token by itself would say.

At scale: mining groups by token inside Spark's FP-growth; the mined rules are
pruned and ranked as a table.  Judging takes them in blocks of ``BLOCK`` ranks, the
best first: one narrow pass over the URLs for each block.
"""

from __future__ import annotations

import itertools
import math
import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: (host, path, verdict): a path "/" is the whole host.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SUPPORT, CONFIDENCE, BLOCK = 0.005, 0.8, 20_000
_LABEL = "label="
_WORD = re.compile(r"[^\W_]+")


def host(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host_: Column, path_: Column, rules: list = RULES) -> Column:
    """The longest listed rule that fits, as a struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        own = (host_ == h) | host_.endswith("." + h)
        out = F.when(own & path_.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: str | None) -> list[str]:
    """The items of a URL, by where they stand: scheme, host labels and
    suffixes, path words by shape, file ending, query names, fragment."""
    url = url or ""
    scheme, sep, rest = url.partition("://")
    if not sep:
        return []
    head = re.match(r"([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", rest, re.S)
    own = head[1].lower()
    labels = own.split(".")
    out = {f"scheme={scheme.lower()}"}
    out.update(f"label:{w}" for x in labels for w in _WORD.findall(x))
    out.update("suffix=" + ".".join(labels[i:]) for i in range(max(0, len(labels) - 2), len(labels)))
    for k, part in enumerate(head[2].split("/")[1:]):
        for w in _WORD.findall(part.lower()):
            out.add(f"path{min(k, 3)}={w}" if not w.isdigit() else f"path{min(k, 3)}=number")
            if w.isdigit():
                out.add(f"path{min(k, 3)}^{w[0]}")
    out.update(f"query={w.partition('=')[0]}" for w in (head[3] or "?")[1:].split("&") if w)
    if head[4]:
        out.add("fragment")
    return sorted(out)


def _with_tokens(urls: DataFrame, url_col: str) -> DataFrame:
    one = T.StructType([T.StructField("items", T.ArrayType(T.StringType()))])
    return common.append(urls, one, F.col(url_col).cast("string"), lambda: lambda values: {"items": [tokens(v) for v in values]})


_RULE = "items array<string>, verdict string, confidence double, support double"


def _classes(rows: DataFrame, support: float, n: int) -> dict[str, str]:
    """The frequent tokens of ``rows`` (key, items), each with the least token that stands
    in the same rows: found by count and two digests of the rows' keys.  There are at most
    1 / support times as many as a row has tokens."""
    each = rows.select("key", F.explode("items").alias("item"))
    found = each.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "key")).alias("y")).where(F.col("n") >= math.ceil(support * n))
    return {r["item"]: r["first"] for r in found.select("item", F.min("item").over(Window.partitionBy("n", "x", "y")).alias("first")).toLocalIterator()}


def _mined(labelled: DataFrame, url_col: str, support: float, confidence: float) -> tuple[DataFrame, dict[str, str]] | None:
    """The rules on items, best first by rank, and the item of each token."""
    rows = common.written(_with_tokens(labelled, url_col).select(F.monotonically_increasing_id().alias("key"), "items", F.concat(F.lit(_LABEL), "verdict").alias("label")), "items")
    n = rows.count()
    if not n:
        return None
    classes = _classes(rows, support, n)
    firsts = labelled.sparkSession.sparkContext.broadcast(frozenset(classes.values()))
    one = T.StructType([T.StructField("items", T.ArrayType(T.StringType()))])
    few = common.append(rows, one, F.col("items"), lambda: lambda values: {"items": [[x for x in v if x in firsts.value] for v in values]})
    few = few.select(F.concat("items", F.array("label")).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(few).associationRules
    rules = rules.where(F.col("consequent")[0].startswith(_LABEL) & ~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
    rules = common.written(rules.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 100).alias("verdict"), "confidence", "support"), "rules")
    # Rules of one item less, or of one, that are as confident.
    less = F.transform("items", lambda x: F.array_except("items", F.array(x)))
    parts = F.array_union(less, F.transform("items", lambda x: F.array(x)))
    tried = rules.where(F.size("items") > 1).select("items", "verdict", "confidence", F.explode(parts).alias("part"))
    as_sure = rules.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("c"))
    redundant = tried.join(as_sure, ["part", "verdict"]).where("c >= confidence").select("items", "verdict").distinct()
    return _ranked(rules.join(redundant, ["items", "verdict"], "left_anti")), classes


def _ranked(rules: DataFrame) -> DataFrame:
    ranked = rules.select("items", "verdict", "confidence", "support").orderBy(F.desc("confidence"), F.desc("support"), F.size("items"), "items", "verdict").rdd.zipWithIndex().map(lambda r: (r[1], *r[0]))
    return common.written(rules.sparkSession.createDataFrame(ranked, f"rank long, {_RULE}"), "ranked")


def mined(labelled: DataFrame, url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """(rank, items, verdict, confidence, support) from rows (url, verdict): every
    rule of tokens over the bounds but those that a shorter one makes redundant;
    without any row, nothing."""
    found = _mined(labelled, url_col, support, confidence)
    if found is None:
        return None
    members: dict[str, list] = {}
    for token, first in found[1].items():
        members.setdefault(first, []).append(token)

    def expanded(batches):
        import pandas as pd

        for batch in batches:
            rows = [(sorted(own), v, c, s) for items, v, c, s in batch.itertuples(index=False) for own in itertools.product(*(members[x] for x in items))]
            yield pd.DataFrame(rows, columns=["items", "verdict", "confidence", "support"])

    return _ranked(found[0].select("items", "verdict", "confidence", "support").mapInPandas(expanded, _RULE))


class Index:
    """Rules (items, verdict), best first, by their rarest token; a lookup gives
    the first rule that fits, counted from ``first``."""

    def __init__(self, rules: list, first: int = 0):
        uses: dict[str, int] = {}
        for a, *_ in rules:
            for x in a:
                uses[x] = uses.get(x, 0) + 1
        self.by: dict[str, list] = {}
        for rank, (a, v, *_) in enumerate(rules, first):
            self.by.setdefault(min(a, key=lambda x: (uses[x], x)), []).append((rank, a, v))

    def verdict(self, items: list[str]) -> tuple[str, int]:
        own, best = set(items), (-1, "allow")
        for x in items:
            for rank, a, v in self.by.get(x, ()):
                if 0 <= best[0] <= rank:
                    break
                if a <= own:
                    best = (rank, v)
                    break
        return best[1], best[0]


def judged(pages: DataFrame, rules: list = RULES, url_col: str = "url", **how) -> DataFrame:
    """``pages`` with host, path, rule, verdict and mined (the mined rule's
    rank, -1: none fits; null: a listed rule decides).

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed; repeated rows are judged alike; without any labelled url
    nothing is mined; columns of these names in ``pages`` are replaced.
    """
    base = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "mined")])
    base = base.withColumn("host", host(F.col(url_col))).withColumn("path", path(F.col(url_col))).withColumn("__listed", listed(F.col("host"), F.col("path"), rules))
    how = {"support": SUPPORT, "confidence": CONFIDENCE} | how
    got = _mined(base.where("__listed is not null").select(F.col(url_col).alias("url"), F.col("__listed.verdict").alias("verdict")), "url", **how)
    found, classes = got or (None, {})
    count = found.count() if found is not None else 0
    shared = pages.sparkSession.sparkContext.broadcast(classes)
    known = F.col("__listed").isNotNull()
    out = base.withColumn("__verdict", F.when(~known, "allow")).withColumn("mined", F.when(~known, -1).cast("int"))
    schema = T.StructType.fromDDL("__verdict string, mined int")
    for first in range(0, count, BLOCK):
        block = [(frozenset(r["items"]), r["verdict"]) for r in sorted(found.where(F.col("rank").between(first, first + BLOCK - 1)).toLocalIterator(), key=lambda r: r["rank"])]

        def make(block=block, first=first):
            index = Index(block, first)

            def run(values: list) -> dict:
                # Only what no listed rule and no better block decides.
                known = shared.value
                got = [index.verdict([known[x] for x in tokens(v["url"]) if x in known]) if v["mined"] == -1 else (v["verdict"], v["mined"]) for v in values]
                return {"__verdict": [v for v, _ in got], "mined": [r for _, r in got]}

            return run

        out = common.append(out, schema, F.struct(F.col(url_col).cast("string").alias("url"), F.col("__verdict").alias("verdict"), "mined"), make)
        if first + BLOCK < count:
            out = common.written(out, "judged")  # so one block at a time is in memory
    return out.withColumn("rule", F.col("__listed.rule")).withColumn("verdict", F.coalesce("__listed.verdict", "__verdict")).drop("__listed", "__verdict")


def query(spark, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict")
