"""Importance resampling towards a target distribution, in Spark SQL only.

Texts are bags of n-grams, hashed into buckets.  The raw documents and the target
texts each give a count per bucket; a bucket's gain is the scaled logarithm of how
much likelier the target is to use it.  A document's weight is the sum of its gains;
Gumbel noise from a hash of its id turns the highest weights into a draw without
replacement.

At scale: counts meet as one row per bucket and task, the gains (a row per bucket)
are broadcast, a document's sum is made in the task that explodes it, and only
narrow rows (id, weight, score) are sorted.  Ranks come from the place of a row in
its range and the sizes of the ranges before it, so nothing is numbered in one task.
No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SCALE = 1000  # of a logarithm, before it is cut to a whole number
SEED = "2024"
LEAST_WORDS, PERCENT = 20, 10
_AT = 33  # bits of a row's place within its partition in monotonically_increasing_id


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def grams(own: Column, shortest: int = 1, longest: int = 1) -> Column:
    """All runs of ``shortest`` to ``longest`` consecutive words, joined by one space."""
    runs, last = [], own
    for n in range(1, longest + 1):
        if n > 1:  # the runs one word shorter, each with the word after it
            many = F.greatest(F.size(own) - F.lit(n - 1), F.lit(0))
            last = F.zip_with(F.slice(last, F.lit(1), many), F.slice(own, F.lit(n), many), lambda a, w: F.concat(a, F.lit(" "), w))
        if n >= shortest:
            runs.append(last)
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def bucketed(rows: DataFrame, text: Column, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with __words (how many) and __buckets (the bucket of every n-gram)."""
    own = rows.withColumn("__own", words(text)).withColumn("__grams", grams(F.col("__own"), shortest, longest))
    hashed = F.transform("__grams", lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))
    return own.withColumn("__words", F.size("__own").cast("long")).withColumn("__buckets", hashed).drop("__own", "__grams")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) over all n-grams of rows with ``__buckets``."""
    return rows.select(F.explode("__buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) from the counts of both sides, for every bucket."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    both = common.written(both.select("bucket", s.alias("s"), t.alias("t")), "gains")
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1.0) * F.lit(total["s"] + buckets)) / ((F.col("s") + 1.0) * F.lit(total["t"] + buckets))
    return both.select("bucket", F.floor(F.lit(float(SCALE)) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise times ``SCALE``, cut to a whole number, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """``rows`` (score, doc_id, ...) with ``rank``: 1 for the highest score, ties to the
    smaller doc_id (null last), null beyond ``draw``."""
    at = F.monotonically_increasing_id()
    dealt = common.written(rows.orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()).withColumn("__at", at), "ranked")
    part, place = F.shiftrightunsigned("__at", _AT), F.col("__at").bitwiseAND(F.lit((1 << _AT) - 1))
    # A row for each range of the sort.
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = (F.col("__before") + place + 1).cast("long")
    out = dealt.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return out.withColumn("rank", F.when(rank <= F.lit(draw), rank)).drop("__at", "__part", "__before")


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, key: str | None = None) -> DataFrame:
    """__key, doc_id, n_features, weight, score and rank for each row of ``docs``.

    ``percent`` of the documents with at least ``least_words`` words are drawn; the rank
    of all others is null.  A null text has no features (weight 0); a null id is hashed
    as the id '' and comes last among ties; rows that repeat an id each count and share
    their noise; without target texts only the raw counts speak; an empty table
    gives an empty one; further columns of ``docs`` do not pass.  ``key``: a column
    that numbers the rows, where there is one.
    """
    own = docs.select((F.col(key) if key else F.monotonically_increasing_id()).alias("__key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    table = common.written(bucketed(own, F.col("__text"), shortest, longest, buckets).drop("__text"), "buckets")
    wanted = bucketed(target.select(F.col(target_col).alias("__text")), F.col("__text"), shortest, longest, buckets)
    gain = gains(bucket_counts(table), bucket_counts(wanted), buckets)
    each = table.select("__key", "doc_id", "__words", F.size("__buckets").cast("long").alias("n_features"), F.explode_outer("__buckets").alias("bucket"))
    summed = each.join(F.broadcast(gain), "bucket", "left").groupBy("__key", "doc_id", "__words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    rows = common.written(summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    enough = F.col("__words") >= least_words
    draw = rows.where(enough).count() * percent // 100
    out = ranked(rows.where(enough), draw).unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.drop("__words")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The drawn rows of ``docs`` with every column as it is, whatever its name, in no
    order; odd cases as in ``scored``.  The rows are written once under a key, so that
    those drawn are found again by it."""
    kept = common.written(common.as_row(docs, F.monotonically_increasing_id().alias("__key")), "rows")
    own = kept.select("__key", F.col(common.nested(id_col)).alias("id"), F.col(common.nested(text_col)).alias("text"))
    drawn = scored(own, target, "id", key="__key", **how).where("rank is not null").select("__key")
    return kept.join(drawn, "__key").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, common.read(spark, sf_dir, "benchmark").select("text")).drop("__key")


SQL = rf"""
with tab as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t from (select unnest(range(256)) as i)),
dw as (select row_number() over () as k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) as w from documents),
bw as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) as g from benchmark),
dg as (select k, unnest(w) as g from dw),
voc as (select g, hex(encode(g)) as h from (select g from dg union select g from bw)),
crc as (select g, xor(4294967295, list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint)) % {BUCKETS} as b from voc, tab),
s as (select b, count(*) as s from dg join crc using (g) group by b),
t as (select b, count(*) as t from bw join crc using (g) group by b),
tot as (select (select coalesce(sum(s), 0) from s)::double as bs, (select coalesce(sum(t), 0) from t)::double as bt),
gain as (select b, floor({SCALE} * ln((coalesce(t, 0) + 1)::double * (bs + {BUCKETS}) / ((coalesce(s, 0) + 1)::double * (bt + {BUCKETS}))))::bigint as gain from (select distinct b from crc) left join s using (b) left join t using (b), tot),
wt as (select k, sum(gain)::bigint as weight from dg join crc using (g) join gain using (b) group by k),
x as (select dw.doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{SEED}:' || coalesce(dw.doc_id::varchar, '')), 1, 8))::bigint as h from dw left join wt using (k)),
y as (select *, weight + floor(-{SCALE} * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from x),
r as (select *, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id nulls last) as place, count(*) over (partition by n_features >= {LEAST_WORDS}) as n from y)
select doc_id, n_features, weight, score, case when n_features >= {LEAST_WORDS} and place <= {PERCENT} * n // 100 then place end as rank from r"""
