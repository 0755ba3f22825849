"""Exports: JSON lines, CSV and partitioned Parquet, written by the executors; deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(rows: DataFrame, path: str, form: str = "json", by: tuple[str, ...] = ()) -> None:
    """``rows`` as a folder of part files; columns ``by`` become folders."""
    out = rows.write.partitionBy(*by) if by else rows.write
    if form == "csv":
        out.option("header", True).option("escape", '"').csv(path)
    else:
        out.format(form).save(path)


def imported(like: DataFrame, path: str, form: str = "json") -> DataFrame:
    """What ``export`` wrote, with the schema of ``like``: nothing is inferred."""
    reader = like.sparkSession.read.schema(like.schema)
    return reader.option("header", True).option("escape", '"').csv(path) if form == "csv" else reader.format(form).load(path)


def delete_before(spark: SparkSession, path: str, column: str, days: int, by: str, now: str | None = None) -> DataFrame:
    """Deletes the rows of a partitioned Parquet table whose ``column`` (a date) lies more
    than ``days`` before ``now`` (null: the table's latest date), and returns one row
    (cutoff, deleted, kept, rewritten, dropped): rows and partitions.

    ``by`` is the partition column, a text that grows with the date (as "2024-03").  Partitions
    without an old row are not touched.  Those with both are written anew and take the
    old ones' place when the job commits; those with old rows only are dropped after it.  A
    run that breaks off leaves rows that are too old, never fewer than it should, and a
    second run ends the work.  Rows with a null date stay."""
    rows = spark.read.parquet(path)
    day = F.to_date(column)
    last = F.to_date(F.lit(now)) if now else None
    cutoff = rows.agg(F.date_sub(last if now else F.max(day), days).alias("c")).first()["c"]
    old = F.coalesce(day < F.lit(cutoff), F.lit(False))
    # A row per partition: bounded by the partitions of the table.
    counts = rows.groupBy(by).agg(F.count_if(old).alias("old"), F.count_if(~old).alias("kept")).where("old > 0 or kept > 0").collect()
    mixed = [r[by] for r in counts if r["old"] and r["kept"]]
    gone = [r[by] for r in counts if r["old"] and not r["kept"]]
    if mixed:
        left = rows.where(F.col(by).isin(mixed) & ~old)
        left.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for value in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}"), True)
    spark.catalog.refreshByPath(path)
    done = (cutoff, sum(r["old"] for r in counts), sum(r["kept"] for r in counts), len(mixed), len(gone))
    return spark.createDataFrame([done], "cutoff date, deleted long, kept long, rewritten int, dropped int")
