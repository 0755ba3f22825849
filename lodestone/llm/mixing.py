"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash key.  Per source, tokens are summed by hash
bucket; a running sum over the buckets shows in which bucket the budget ends;
only that bucket is summed again by the next 12 bits, and so on until a single
key holds the boundary.  A document is taken when its key lies below the
threshold of its source: a filter, without sorting documents.

A document that does not fit leaves a gap.  Further passes fill it: the same
search among the documents not yet taken that are no larger than the gap.

At scale: each pass moves at most 4096 sums per source and task; the rows of a
hot source are summed before the shuffle.  One row per source is ranked in a
single task (a mix has as many rows there as it has sources).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS, DIGITS = 5, 3  # five levels of three hexadecimal digits
PASSES = 4
FEW = 100_000  # rows, one a source, that are broadcast: some 20 MB
SALTS = 64  # parts of a source's documents where there are more sources
WEIGHTS = (5, 2, 1)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(common.WORD)), F.lit(0)).cast("long")


def hash_key(doc_id: Column, text: Column) -> Column:
    """60 bits of an md5 over id and text: the same in every run."""
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, LEVELS * DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, get the weights in turn.  ``share`` of
    all words is dealt by weight; a source stops at ``cap`` times its size and
    the excess is dealt again by weight until none is above its cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    dealt = sizes.withColumn("__rank", rank)
    dealt = dealt.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
    dealt = dealt.withColumn("__cap", F.col("source_size") * F.lit(cap)).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    # With sources by cap per weight, the capped ones are a prefix: the level at
    # each row deals what the earlier caps leave among this row and the later.
    up = Window.orderBy("__ratio", "__rank")
    before = F.coalesce(F.sum("__cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(up.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy("__ratio", "__rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(share)
    dealt = dealt.withColumn("__level", (total - before) / rest)
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct("__ratio", "__rank", "__level"))
    level = F.min(fits).over(every)["__level"]
    target = F.when(level.isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), level * F.col("__w")))
    return dealt.select("source", "source_size", target.alias("target"))


def _by_source(rows: DataFrame, source: Column, salt: Column, plan: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the row of ``plan`` (column __source) for their source.  A ``few``
    sources are broadcast; more meet their documents in ``SALTS`` parts a source, so
    that no source's documents stand in one task."""
    if few:
        return rows.join(F.broadcast(plan), source.eqNullSafe(F.col("__source")))
    own = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    every = plan.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.join(every, source.eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__part"))).drop("__salt", "__part")


def _cuts(rows: DataFrame, gaps: DataFrame, few: bool = True) -> DataFrame:
    """(source, cut, got): keys below ``cut`` sum to ``got`` <= the source's gap.

    ``rows``: (source, key, size); ``gaps``: (source, gap).  Null cut: no
    boundary, all rows of the source fit.
    """
    spent = gaps.select("source", "gap", F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("base"))
    finished = []
    for level in range(LEVELS):
        width = 16 ** (DIGITS * (LEVELS - 1 - level))
        span = 16 ** (DIGITS * (LEVELS - level))
        here = _by_source(rows, F.col("source"), F.col("key"), spent.withColumnRenamed("source", "__source"), few)
        here = here.where((F.col("key") >= F.col("base")) & (F.col("key") < F.col("base") + F.lit(span)))
        bucket = F.shiftrightunsigned("key", (width.bit_length() - 1))
        sums = here.groupBy("source", bucket.cast("long").alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("gap").alias("gap"), F.first("got").alias("got")
        )
        w = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("__cum", F.col("got") + F.sum("size").over(w))
        edge = sums.where(F.col("__cum") > F.col("gap")).groupBy("source").agg(F.min_by(F.struct("bucket", "lo", "hi", (F.col("__cum") - F.col("size")).alias("got"), "gap"), "bucket").alias("e"))
        edge = edge.select("source", "e.*")
        # Few rows per source: cut the lineage so that later levels do not
        # compute the earlier ones again.
        edge = common.written(edge, "mix-edge")
        single = (F.col("lo") == F.col("hi")) | F.lit(level == LEVELS - 1)
        finished.append(edge.where(single).select("source", F.col("lo").alias("cut"), "got"))
        spent = edge.where(~single).select("source", "gap", "got", (F.col("bucket") * F.lit(width)).alias("base"))
        if spent.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished)


def decisions(sized: DataFrame, **how) -> DataFrame:
    """One row per source: source, source_size, target, copies, cuts.

    ``sized``: (source, key, size).  A document is taken ``copies`` times, and
    once more if an entry of ``cuts`` has its key below ``key`` and its size at
    most ``max_size``.
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("copies", copies)
    none = F.array().cast("array<struct<key:bigint,max_size:bigint>>")
    now = common.written(goal.withColumn("gap", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("cuts", none), "mix-goal")
    few = now.count() <= FEW
    for turn in range(PASSES):
        left = _by_source(sized, F.col("source"), F.col("key"), now.select(F.col("source").alias("__source"), "gap", "cuts"), few).where("gap >= 1 and size > 0")
        left = left.where(~_hit("cuts", "key", "size"))
        if turn:
            left = left.where("size <= gap")
        left = left.select("source", "key", "size")
        cut = _cuts(left, now.where("gap >= 1").select("source", "gap"), few)
        top = F.lit(16 ** (LEVELS * DIGITS)).cast("long")
        # A source without a boundary has too few small documents: all of them
        # fit, and their sum closes the gap as far as it can be closed.
        whole = left.groupBy("source").agg(F.sum("size").alias("all"))
        joined = now.alias("n").join(cut.alias("c"), F.expr("n.source <=> c.source"), "left").join(whole.alias("w"), F.expr("n.source <=> w.source"), "left")
        got = F.coalesce(F.col("c.got"), F.col("w.all"), F.lit(0))
        limit = F.lit(2**62) if not turn else F.floor(F.col("n.gap"))
        entry = F.struct(F.coalesce(F.col("c.cut"), top).alias("key"), limit.cast("long").alias("max_size"))
        cuts = F.when(F.col("w.all").isNull(), F.col("n.cuts")).otherwise(F.concat("n.cuts", F.array(entry)))
        now = common.written(joined.select("n.source", "n.source_size", "n.target", "n.copies", (F.col("n.gap") - got).alias("gap"), cuts.alias("cuts")), "mix-goal")
    return now.select("source", "source_size", "target", "copies", "cuts")


def _hit(cuts: str, key: str, size: str) -> Column:
    return F.expr(f"exists({cuts}, x -> {key} < x.key and {size} <= x.max_size)")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words, repeats counted).

    Null text has size 0 and is never taken; a null source is a source of its
    own, last in order; rows that repeat id and text share a key and are taken
    together; without rows the result is empty.  Columns of the same names are
    replaced.
    """
    new = ["size", "source_size", "target", "taken"]
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    base = base.withColumn("__size", n_words(F.col(text_col))).withColumn("__key", hash_key(F.col(id_col), F.col(text_col)))
    sized = common.written(base.select(F.col(source_col).alias("source"), F.col("__key").alias("key"), F.col("__size").alias("size")), "mix-sized")
    plan = decisions(sized, **how)
    return _decided(base, plan, source_col)


def _decided(base: DataFrame, plan: DataFrame, source_col: str) -> DataFrame:
    plan = plan.select(*[F.col(c).alias(f"__p_{c}") for c in plan.columns])
    out = _by_source(base, F.col(source_col), F.col("__key"), plan.withColumnRenamed("__p_source", "__source"), plan.count() <= FEW)
    once = F.when(_hit("__p_cuts", "__key", "__size"), 1).otherwise(0)
    taken = F.col("__size") * (F.col("__p_copies") + once)
    drop = ["__size", "__key", "__source", *plan.columns]
    return (
        out.withColumn("size", F.col("__size")).withColumn("source_size", F.col("__p_source_size")).withColumn("target", F.col("__p_target")).withColumn("taken", taken.cast("long")).drop(*drop)
    )


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken.

    Null and empty texts are never taken; every column passes as it is, whatever
    its name; an empty table stays empty.
    """
    columns = {"id_col": "doc_id", "text_col": "text", "source_col": "source"}
    names = {k: common.nested(how.pop(k, v)) for k, v in columns.items()}
    out = mix(common.as_row(docs), **names, **how)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    out = out.withColumn("__times", times).where(F.col("__times") > 0)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("__size"), hash_key(F.col("doc_id"), F.col("text")).alias("__key"))
    base = common.written(base, "mix-sized")
    plan = decisions(base.select("source", F.col("__key").alias("key"), F.col("__size").alias("size")))
    return _decided(base, plan, "source").select("doc_id", "size", "source_size", "target", "taken")


def _sql() -> str:
    parts = [
        r"""d0 as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
 ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as key from documents),
 s0 as (select source, sum(size)::bigint as source_size from d0 group by source),
 s1 as (select *, [5.0, 2.0, 1.0][(row_number() over (order by source is null, source) - 1) % 3 + 1]::double as w, row_number() over (order by source is null, source) as rk from s0),
 s2 as (select *, 3.0::double * source_size as cap, 3.0::double * source_size / w as ratio from s1),
 s3 as (select *, ((select sum(source_size) from s0)::double - coalesce(sum(cap) over (order by ratio, rk rows between unbounded preceding and 1 preceding), 0))
   / sum(w) over (order by ratio, rk rows between current row and unbounded following) as lev from s2),
 lv as (select min_by(lev, ratio) as lev from s3 where lev * w <= cap),
 s4 as (select source, source_size, least(cap, coalesce((select lev from lv), cap) * w)::double as target from s3),
 s5 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as copies from s4),
 g0 as (select *, target - copies * source_size as gap from s5),
 t0 as (select d0.*, false as hit from d0)"""
    ]
    for i in range(PASSES):
        limit = "" if not i else "and t.size <= g.gap"
        parts.append(
            f"""c{i} as (select t.doc_id, t.key, t.source, t.size, sum(t.size) over (partition by t.source order by t.key) as cum, g.gap from t{i} t join g{i} g on t.source is not distinct from g.source where not t.hit and t.size > 0 and g.gap >= 1 {limit}),
 e{i} as (select source, min(key) as cut from c{i} where cum > gap group by source),
 k{i} as (select c.source, c.key, c.size from c{i} c left join e{i} e on c.source is not distinct from e.source where e.cut is null or c.key < e.cut),
 t{i + 1} as (select t.doc_id, t.source, t.size, t.key, t.hit or exists (select 1 from k{i} k where k.key = t.key and k.source is not distinct from t.source and k.size = t.size) as hit from t{i} t),
 g{i + 1} as (select g.source, g.source_size, g.target, g.copies, g.gap - coalesce(x.got, 0) as gap from g{i} g left join (select source, sum(size) as got from k{i} group by source) x on g.source is not distinct from x.source)"""
        )
    return "with " + ",\n ".join(parts) + f"""
 select t.doc_id, t.size, g.source_size, g.target, (t.size * (g.copies + case when t.hit then 1 else 0 end))::bigint as taken from t{PASSES} t join g{PASSES} g on t.source is not distinct from g.source"""


SQL = _sql()
