"""The breaker on a stream replayed in parts against a batch and a plain run."""

import random

from pyspark.sql import functions as F

from lodestone.streaming import live


def plain(rows, reset=None):
    state, out = {}, {}
    for i, key, at, bad in sorted(rows, key=lambda r: (r[2], r[0])):
        failed, opened = state.get(key, (0, None))
        if opened is not None and (reset is None or at - opened < reset):
            out[i] = "skipped"
            continue
        failed = (failed if opened is None else 0) + 1 if bad else 0
        state[key] = (failed, at if failed >= 3 else None)
        out[i] = "error" if bad else "ok"
    return out


def test_stream_in_parts_is_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 2, None]), 1_700_000_000 + i // 2, rng.random() < 0.5) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, k long, at long, bad boolean").withColumn("at", F.timestamp_seconds("at"))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ("id < 50", "id >= 50 and id < 90", "id >= 90"):
        frame.where(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        got = live.appended(live.outcomes(stream, "k", "id", "at", "bad"), out, state)
    assert {r["id"]: r["outcome"] for r in got.collect()} == plain(rows) and got.count() == len(rows)
    assert {r["id"]: r["outcome"] for r in live.outcomes(frame, "k", "id", "at", "bad").collect()} == plain(rows)
    assert {r["id"]: r["outcome"] for r in live.outcomes(frame, "k", "id", "at", "bad", reset=10.0).collect()} == plain(rows, 10)
