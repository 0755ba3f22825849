"""Findings: keep-first dedup, severity order, merges, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from the worst, with their risk penalties.
SEVERITIES = ["critical", "high", "medium", "low"]
PENALTIES = {"critical": 25, "high": 15, "medium": 8, "low": 3}


def severity_rank(c: Column) -> Column:
    """0 for critical to 3 for low; unknown last."""
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(c == s, i).otherwise(out)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list[Column], confidence: str, agent: str) -> DataFrame:
    """The first row of each key; confidence x 1.2 (at most 1) where others agree;
    ``confirmed`` rows and ``agents`` of the group.  One shuffle by the key."""
    w = Window.partitionBy(*keys)
    first = F.row_number().over(w.orderBy(*order))
    n = F.count(F.lit(1)).over(w)
    out = df.withColumn("__rn", first).withColumn("confirmed", n).withColumn("agents", F.array_join(F.sort_array(F.collect_set(F.col(agent).cast("string")).over(w)), ","))
    boosted = F.when(F.col("confirmed") > 1, F.least(F.lit(1.0), F.col(confidence) * 1.2)).otherwise(F.col(confidence))
    return out.where("__rn = 1").drop("__rn").withColumn(confidence, boosted)


def zero_filled(df: DataFrame, level: Column, levels: list[str] = SEVERITIES) -> DataFrame:
    """(level, n) with a row for every level."""
    dim = df.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    counts = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ladder(score: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step that the score reaches."""
    out = F.lit(last)
    for limit, name in sorted(steps):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def risk(df: DataFrame, severity: str, keys: list[str], attacks: DataFrame | None = None) -> DataFrame:
    """100 minus the penalties and 10 for each attack that succeeds (``attacks``: keys,
    attacks), clamped; the level by the unclamped score and the numbers of findings."""
    per = [F.sum(F.when(F.col(severity) == s, 1).otherwise(0)).cast("long").alias(s) for s in SEVERITIES]
    out = df.groupBy(*keys).agg(*per)
    out = out.join(attacks, keys) if attacks is not None else out.withColumn("attacks", F.lit(0).cast("long"))
    raw = F.lit(100) - sum((F.col(s) * p for s, p in PENALTIES.items()), F.lit(0)) - F.col("attacks") * 10
    found = sum((F.col(s) for s in SEVERITIES), F.lit(0))
    level = F.when((F.col("critical") > 0) | (raw < 30), "CRITICAL").when((F.col("high") > 2) | (raw < 50), "HIGH").when((found > 5) | (raw < 70), "MEDIUM").otherwise("LOW")
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long")).withColumn("level", level)


def band_join(left: DataFrame, right: DataFrame, key: str, pos_left: str, pos_right: str, reach: int) -> DataFrame:
    """Rows of equal key whose positions differ by at most ``reach``: an
    equi-join on (key, band) with each right row in its three bands, so a hot
    key is spread over its bands."""
    a = left.withColumn("__band", F.floor(F.col(pos_left) / (reach + 1)))
    b = right.withColumn("__band", F.explode(F.array(*[F.floor(F.col(pos_right) / (reach + 1)) + d for d in (-1, 0, 1)])))
    return a.join(b, [key, "__band"]).where(F.abs(F.col(pos_left) - F.col(pos_right)) <= reach).drop("__band")


def band_sets(left: DataFrame, right: DataFrame, key: str, pos_left: str, pos_right: str, reach: int, value: str) -> DataFrame:
    """``left`` with ``near``, the distinct values of the right rows that ``band_join`` would
    meet, without a row for each pair: the right side is a set for each (key, band), of
    distinct positions and values in three bands.  Left rows that meet none are dropped."""
    a = left.withColumn("__band", F.floor(F.col(pos_left) / (reach + 1)))
    own = right.select(key, F.col(pos_right).alias("at"), F.col(value).alias("v"))
    b = own.withColumn("__band", F.explode(F.array(*[F.floor(F.col("at") / (reach + 1)) + d for d in (-1, 0, 1)])))
    sets = b.groupBy(key, "__band").agg(F.collect_set(F.struct("at", "v")).alias("__set"))
    met = a.join(sets, [key, "__band"]).withColumn("__set", F.filter("__set", lambda x: F.abs(F.col(pos_left) - x["at"]) <= reach))
    return met.where(F.size("__set") > 0).withColumn("near", F.array_distinct(F.transform("__set", lambda x: x["v"]))).drop("__band", "__set")


def merge_predictions(rows: DataFrame, predictions: DataFrame, key: str, score: str) -> DataFrame:
    """Rows with their prediction (confidence x 1.2 above 0.5), then the
    predictions that match none: one full outer join."""
    a, b = rows.withColumn("__l", F.lit(True)), predictions.withColumn("__r", F.lit(True))
    out = a.join(b, key, "full_outer")
    origin = F.when(F.col("__l").isNull(), "prediction").when(F.col("__r").isNull(), "row").otherwise("both")
    return out.withColumn("origin", origin).withColumn("boost", F.when(F.col(score) > 0.5, F.least(F.lit(1.0), F.col(score) * 1.2)).otherwise(F.col(score))).drop("__l", "__r")


def rank_combine(a: DataFrame, b: DataFrame, key: str, one: str, two: str, w1: float, w2: float) -> DataFrame:
    """w1 * one + w2 * two, an absent side counting 0.5."""
    return a.join(b, key, "full_outer").select(key, (w1 * F.coalesce(one, F.lit(0.5)) + w2 * F.coalesce(two, F.lit(0.5))).alias("combined"))
