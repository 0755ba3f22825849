"""Embedding whitening by the covariance of fixed-point vectors.

Entries become whole numbers (``SCALE`` steps a unit), so that sums, centred rows and
deviations are exact.  Each distinct vector counts once in the fit.  The Gramian of
the exactly centred rows is summed by MLlib's RowMatrix in a tree of dimension x
dimension buffers; its eigenvectors are found on the driver and, with the sums,
broadcast for one narrow pass over all rows.

At scale: the driver and each task hold a few matrices of the dimension squared,
whatever the number of rows; copies of a vector are merged before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = 2.0**40  # an entry from here on has no place among the steps
FLAT = 1e-12  # of the trace: an eigenvalue below it belongs to no component
ROWS = 1024  # rows that a task projects at once


@dataclass
class Model:
    """What is fitted: n distinct vectors, the sums of their steps, the components as
    columns over the roots of their eigenvalues, each one's share of the trace."""

    n: int
    sums: np.ndarray
    weights: np.ndarray
    explained: np.ndarray


def steps(vector: Column) -> Column:
    """A vector's entries as long steps; null for a null vector or one with an entry
    that is null, not finite or not below ``LARGEST``."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return F.when(vector.isNotNull() & ~bad, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def covariance(rows: DataFrame, n: int, dimension: int) -> np.ndarray:
    """The Gramian of the rows (one column, centred array<double>) over n."""
    vectors = rows.select(array_to_vector(rows.columns[0]).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, dimension).computeGramianMatrix().toArray() / n


def fixed(vectors: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """``vectors`` with ``__x`` (steps), without the rows that have none, and the
    dimension: the length that most rows have (the least of these on ties)."""
    own = vectors.withColumn("__x", steps(F.col(f"`{vec_col}`"))).where(F.size("__x") > 0)
    most = own.groupBy(F.size("__x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dimension = most["d"] if most else 0
    return own.where(F.size("__x") == dimension), dimension


def exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, as int64 where that holds it and its squares' sum, else as Python
    whole numbers."""
    far = np.abs(x.astype(float) * n - sums.astype(float)).max(initial=0)
    if n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 2**62 and far * far * x.shape[1] < 2**62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def fit(x: DataFrame, dimension: int, components: int = COMPONENTS) -> Model:
    """The model of a table of distinct vectors (one column ``__x``)."""
    n = x.count()
    # A row per dimension; high and low bits are summed apart, so that no sum overflows.
    found = x.select(F.posexplode("__x").alias("i", "x")).groupBy("i").agg(F.sum(F.shiftright("x", 20)).alias("high"), F.sum(F.col("x").bitwiseAND(F.lit((1 << 20) - 1))).alias("low"), F.max(F.abs("x")).alias("most")).orderBy("i").collect()
    sums = np.array([(r["high"] << 20) + r["low"] for r in found], object)
    # n * x - S in whole numbers, then one division: the rows are centred exactly.
    offsets = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums])
    kind = "long" if 2 * n * max(r["most"] for r in found) < 2**62 else "decimal(38,0)"
    centred = x.select(F.zip_with("__x", offsets.cast(f"array<{kind}>"), lambda v, s: (v.cast(kind) * F.lit(n).cast("long") - s).cast("double") / F.lit(float(n))).alias("c"))
    v = covariance(centred, n, dimension)
    values, columns = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(v))
    order = order[values[order] > FLAT * trace]
    columns = columns[:, order] * np.sign(columns[np.abs(columns[:, order]).argmax(axis=0), order])  # the largest entry is positive
    return Model(n, sums, columns / np.sqrt(values[order]), values[order] / trace)


def _projected(rows: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """``kept`` columns with ``deviation`` and ``whitened`` (an array) by ``__x``."""
    shared = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.weights))
    schema = T.StructType([*(rows.schema[c] for c in kept), *T.StructType.fromDDL("deviation decimal(38,0), whitened array<double>").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import decimal

        n, sums, weights = shared.value
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                own = batch.iloc[i : i + ROWS]
                off = exact(np.stack(own["__x"].to_numpy()).astype(np.int64), n, sums)
                out = own[kept].copy()
                out["deviation"] = [decimal.Decimal(int(d)) for d in (off * off).sum(axis=1)]
                out["whitened"] = list((off / n).astype(float) @ weights)
                yield out

    return rows.select(*kept, "__x").mapInPandas(run, schema)


def identity_error(x: DataFrame, model: Model) -> float:
    """The largest absolute entry of the covariance of the whitened distinct vectors
    minus the identity."""
    k = len(model.explained)
    own = common.written(_projected(x, model, []).select("whitened"), "whitened")
    mean = own.select(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = own.select(F.zip_with("whitened", F.array(*[F.lit(float(m)) for m in mean]), lambda v, m: v - m).alias("c"))
    return float(np.abs(covariance(centred, model.n, k) - np.eye(k)).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened and explained (arrays by component) and
    identity_error for each row that stays.

    Rows go whose vector is null, empty, or has an entry that is null, not finite or
    beyond 2^40, and those of another length than most rows have.  Repeated rows stay
    and count once in the fit; a null id passes.  A component without variance is
    left out, so a table of one distinct vector, or an empty one, has none: its rows have
    empty arrays.  Further columns do not pass.
    """
    spark = vectors.sparkSession
    # An id passes pandas as text: whole numbers beside nulls would lose digits there.
    kind = vectors.schema[id_col].dataType
    rows, dimension = fixed(vectors.select(F.col(id_col).cast("string").alias("__id"), F.col(f"`{vec_col}`").alias("__vector")), "__vector")
    rows = rows.select("__id", "__x")
    schema = T.StructType([T.StructField("vec_id", kind), *T.StructType.fromDDL("n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double").fields])
    if not dimension:
        return spark.createDataFrame([], schema)
    x = common.written(rows.select("__x").distinct(), "vectors")
    model = fit(x, dimension, components)
    error = identity_error(x, model) if len(model.explained) else 0.0
    shares = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    return _projected(rows, model, ["__id"]).select(F.col("__id").cast(kind).alias("vec_id"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    """A row per vector and component; a component without variance has no rows."""
    found = whitened(common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = found.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")
