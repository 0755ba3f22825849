"""Ensembles and evidence: tallies, agreement, confidence, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tally(votes: DataFrame, context: str, option: str, confidence: str) -> DataFrame:
    """Per context: winner (most votes, then confidence, then name), its votes
    and confidence, all votes, and the level of agreement."""
    per = votes.groupBy(context, option).agg(F.count(F.lit(1)).alias("v"), F.sum(confidence).alias("c"))
    w = Window.partitionBy(context)
    ranked = per.withColumn("n", F.sum("v").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("v"), F.desc(F.round("c", 4)), option)))
    level = F.when(F.col("v") == F.col("n"), "unanimous").when(F.col("v") * 2 > F.col("n"), "majority").when(F.col("v") > 1, "plurality").otherwise("none")
    return ranked.where("rn = 1").select(context, F.col(option).alias("winner"), F.col("v").alias("votes"), F.round("c", 4).alias("confidence"), F.col("n").alias("total"), level.alias("agreement"))


def evidence(items: DataFrame, candidate: str, kind: str, positive: str, weight: str) -> DataFrame:
    """Sums by sign, number of kinds, the strongest item, and the confidence
    pos / (pos + neg) + min(.2, .05 kinds) + .1 if the strongest >= .8, at most 1."""
    out = items.groupBy(candidate).agg(F.sum(F.when(F.col(positive), F.col(weight)).otherwise(0.0)).alias("pos"), F.sum(F.when(~F.col(positive), F.col(weight)).otherwise(0.0)).alias("neg"), F.countDistinct(kind).alias("kinds"), F.max(weight).alias("strongest"), F.min(weight).alias("weakest"))
    total = F.col("pos") + F.col("neg")
    share = F.when(total > 0, F.col("pos") / total).otherwise(0.0)
    conf = F.least(F.lit(1.0), share + F.least(F.lit(0.2), F.lit(0.05) * F.col("kinds")) + F.when(F.col("strongest") >= 0.8, 0.1).otherwise(0.0))
    return out.select(candidate, *[F.round(c, 4).alias(c) for c in ("pos", "neg")], "kinds", F.round("strongest", 4).alias("strongest"), F.round("weakest", 4).alias("weakest"), F.round(conf, 4).alias("confidence"))


def weighted(votes: DataFrame, context: str, option: str, weight: str) -> DataFrame:
    """Per context: the option with the largest single weight (ties by name) and
    the share of votes that agree with it; the votes are summed per option first."""
    per = votes.groupBy(context, option).agg(F.count(F.lit(1)).alias("v"), F.max(weight).alias("w"))
    order = F.struct(F.col("w"), F.col("v"), F.col(option))
    out = per.groupBy(context).agg(F.max(order).alias("best"), F.sum("v").alias("n"))
    return out.select(context, F.col(f"best.{option}").alias("winner"), F.round("best.w", 4).alias("score"), F.round(F.col("best.v") / F.col("n"), 4).alias("agreement"))


def weakest_link(items: DataFrame, chain: str, item: str, strength: str) -> DataFrame:
    """Per chain: the least strength and the first item that has it."""
    return items.groupBy(chain).agg(F.min(strength).alias("strength"), F.min_by(item, F.struct(strength, item)).alias("weakest"))
