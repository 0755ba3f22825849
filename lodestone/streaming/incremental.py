"""Incremental counts as a stream: watermark, tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and kind; the same plan for a batch and a stream."""
    own = events.withColumn("__t", F.col(ts).cast("timestamp"))
    if own.isStreaming:
        own = own.withWatermark("__t", late)
    return own.groupBy(F.window("__t", every).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def drained(frame: DataFrame, out: str, state: str) -> DataFrame:
    """Runs a streaming aggregate over all that its source holds now, and
    returns the table it wrote to ``out``.  The state is kept in ``state``, so a
    later call takes only what is new."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    frame.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(out)
