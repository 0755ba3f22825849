"""Commits and run history: churn, hotspots, periods, retention, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def churn(changes: DataFrame, file: str, commit: str, changed: str) -> DataFrame:
    """commits * max(1, changed per commit / 10) per file."""
    out = changes.groupBy(file).agg(F.countDistinct(commit).alias("commits"), F.sum(changed).alias("changed"))
    return out.withColumn("churn", F.round(F.col("commits") * F.greatest(F.lit(1.0), F.col("changed") / F.col("commits") / 10), 4))


def recency(days: Column) -> Column:
    """The weight of a last change some days before the anchor; none: 1."""
    steps = F.when(days <= 0, 2.0).when(days <= 7, 1.8).when(days <= 14, 1.5).when(days <= 30, 1.2).when(days <= 60, 1.0).otherwise(0.8)
    return F.when(days.isNull(), 1.0).otherwise(steps)


def size_weight(loc: Column) -> Column:
    """The weight of a file by its lines of code."""
    return F.when(loc < 100, 1.0).when(loc < 300, 2.0).when(loc < 500, 4.0).when(loc < 1000, 6.0).otherwise(8.0)


def period(text: Column) -> Column:
    """Days of a period in words: the first number times 1, 7 or 30; 90 for others."""
    low = F.lower(text)
    unit = F.when(low.contains("day"), 1).when(low.contains("week"), 7).when(low.contains("month"), 30)
    number = F.regexp_extract(low, "^\\s*([0-9]+)", 1).try_cast("int")
    return F.coalesce(number * unit, F.lit(90))


def newest(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def evicted(entries: DataFrame, size: str, order: list[Column], limit: float, most: int = 100) -> DataFrame:
    """Oldest entries first, at most ``most``, until the rest holds 80% of the
    limit.  Only the ``most`` oldest are ranked (a top-k), never all entries."""
    total = entries.agg(F.sum(size).alias("__total"))
    oldest = entries.orderBy(*order).limit(most)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = oldest.withColumn("freed_before", F.coalesce(F.sum(size).over(w), F.lit(0))).crossJoin(total)
    return out.where(F.col("freed_before") < F.col("__total") - F.lit(0.8 * limit)).drop("__total")


def runs(rows: DataFrame, key: str, order: list[Column], flag: Column, least: int) -> DataFrame:
    """(key, start, length) of runs of at least ``least`` flagged rows."""
    w = Window.partitionBy(key).orderBy(*order)
    own = rows.withColumn("__f", flag).withColumn("__n", F.row_number().over(w)).withColumn("__g", F.col("__n") - F.sum(F.col("__f").cast("int")).over(w))
    return own.where("__f").groupBy(key, "__g").agg(F.min("__n").alias("start"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("__g")
