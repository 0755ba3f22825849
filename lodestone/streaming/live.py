"""A circuit breaker per key as a stateful operator, for streams and batches alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: failures in a row that open a breaker.
FAILURES = 3
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Breaker(StatefulProcessor):
    """Calls of a key in order: after ``failures`` failed ones in a row its breaker is open,
    and calls are skipped, until one comes ``reset`` seconds after it opened (None:
    never).  The state is two numbers a key; ``ttl`` milliseconds without a call of the
    key forget it (None: never)."""

    def __init__(self, failures: int = FAILURES, reset: float | None = None, ttl: int | None = None):
        self.failures, self.reset, self.ttl = failures, reset, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failed int, opened double", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")  # one key's calls of a micro-batch
        failed, opened = self.state.get() if self.state.exists() else (0, -1.0)
        outcome = []
        for at, bad in zip(own["at"], own["failed"], strict=True):
            if opened >= 0 and (self.reset is None or at - opened < self.reset):
                outcome.append("skipped")
                continue
            if opened >= 0:
                failed, opened = 0, -1.0
            failed = failed + 1 if bad else 0
            if failed >= self.failures:
                opened = at
            outcome.append("error" if bad else "ok")
        self.state.update((int(failed), float(opened)))
        yield pd.DataFrame({"key": key[0], "id": own["id"], "outcome": outcome})

    def close(self) -> None:
        pass


def outcomes(calls: DataFrame, key: str, id_: str, at: str, failed: str, **how) -> DataFrame:
    """(key, id, outcome) of calls: ``ok``, ``error`` or ``skipped``.  Calls of a key are taken
    in the order of time and id within a batch or micro-batch, and micro-batches as
    they come.  Rows with a null key form one key; a null time comes first."""
    spark = calls.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    own = calls.select(F.col(key).alias("key"), F.col(id_).alias("id"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) / 1e6, F.lit(0.0)).alias("at"), F.coalesce(F.col(failed), F.lit(False)).alias("failed"))
    schema = T.StructType([own.schema["key"], own.schema["id"], T.StructField("outcome", T.StringType())])
    return own.groupBy("key").transformWithStateInPandas(statefulProcessor=Breaker(**how), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if how.get("ttl") else "None")


def appended(frame: DataFrame, out: str, state: str) -> DataFrame:
    """Takes all that the stream's source holds now and appends its rows to ``out``; a later
    call goes on from ``state``.  A batch that is done again writes its own folder anew."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    frame.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(out)
