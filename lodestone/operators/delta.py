"""Differences of snapshots and dependencies between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): added, modified, unchanged or deleted, by one full outer
    join; a null digest equals a null digest."""
    a, b = before.select(key, F.col(digest).alias("__a"), F.lit(True).alias("__old")), after.select(key, F.col(digest).alias("__b"), F.lit(True).alias("__new"))
    state = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def last_wins(rows: DataFrame, changes: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with the ``value`` of the last change of each key, or null: the
    changes are reduced before the join."""
    last = changes.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
    return rows.join(last, key, "left")


def ready(items: DataFrame, dependencies: DataFrame, done: str, blocked: str) -> DataFrame:
    """Items (id, status), neither done nor blocked, without an existing
    dependency (id, needs) that is not done; unknown ids hold nothing up."""
    open_ = items.where(F.col("status") != done).select(F.col("id").alias("needs"))
    unmet = dependencies.join(open_, "needs", "left_semi").select("id")
    return items.where(~F.col("status").isin(done, blocked)).join(unmet, "id", "left_anti")
