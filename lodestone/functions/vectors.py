"""Vector functions on array columns, JVM-side."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


BLOCK = 4096  # query vectors that are broadcast at once; rows whose best are found at once
CELLS = 1 << 17  # pairs of row and query that a task holds at once


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot products of rows of ``a`` and columns of ``b``, added in the order of the
    places, as ``dot`` does: the last bits decide ties."""
    out = np.zeros((len(a), b.shape[1]))
    for j in range(a.shape[1]):
        out += a[:, j : j + 1] * b[j]
    return out


def _places(x: np.ndarray) -> np.ndarray:
    """``x`` rounded to 4 places as ``round`` does (halves of the shortest decimal away from
    zero), times 10000."""
    y = np.abs(x) * 1e4
    whole = np.floor(y)
    rest = y - whole
    whole += rest > 0.5
    for at in zip(*np.nonzero(np.abs(rest - 0.5) < 1e-6), strict=True):
        whole[at] = float(Decimal(repr(abs(float(x[at])))).quantize(Decimal("0.0001"), ROUND_HALF_UP).scaleb(4))
    return np.copysign(whole, x) + 0.0


def _by_size(rows: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, norms) of rows (id, vector) of each length, by id; none of length 0."""
    ids, vector = rows.flatten()
    sizes = pc.list_value_length(vector).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = pa.array(np.flatnonzero(sizes == size))
        own = ids.take(at).to_numpy(zero_copy_only=False)
        x = vector.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(own), size)
        with np.errstate(all="ignore"):
            norm = np.zeros(len(own))
            for j in range(size):
                norm += x[:, j] * x[:, j]
            norm = np.sqrt(norm)
        order = np.argsort(own, kind="stable")
        order = order[~(norm[order] <= 0)]
        yield own[order], x[order], norm[order]


def _best(ids: np.ndarray, x: np.ndarray, norm: np.ndarray, asked: tuple, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, row ids, similarities) of the best ``k`` of each query among rows by id;
    no number comes first."""
    names, q, qn = asked
    turned, n = np.ascontiguousarray(x.T), len(ids)
    step = max(1, CELLS // max(1, n))
    for i in range(0, len(names) if n else 0, step):
        part = slice(i, i + step)
        with np.errstate(all="ignore"):
            near = _dots(q[part], turned) / (norm * qn[part][:, None])
            places = _places(near)
        key = np.where(np.isnan(near), 2e4, places) * n - np.arange(n)
        key[names[part][:, None] == ids] = -np.inf
        top = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), key.shape)
        row, at = np.nonzero(np.take_along_axis(key, top, 1) > -np.inf)
        column = top[row, at]
        yield names[part][row], ids[column], places[row, column] / 1e4


def top_k(rows: DataFrame, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, vec_id, similarity, rank): a stated query set against all rows, the
    queries in blocks of at most ``BLOCK``; what is under ``least`` goes after the
    ranking.  Norms are computed once a vector.

    The rows stand in blocks of some ``BLOCK`` that meet a block of queries as matrices,
    ``CELLS`` pairs at a time; of each block only the best k of a query are kept, so what is
    sorted and shuffled for a block of queries is in proportion to the rows.  A vector of
    length 0 or null is similar to nothing.
    """
    spark = rows.sparkSession
    whole = lambda df, name: df.select(F.col("vec_id").alias(name), F.col("embedding").cast("array<double>").alias("e")).where(F.col(name).isNotNull() & F.forall("e", lambda x: x.isNotNull()))
    own, asked = whole(rows, "vec_id"), whole(queries, "query_id")
    many = max(-(-own.count() // BLOCK), 8 * spark.sparkContext.defaultParallelism)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(many))
    own = own.withColumn("__b", block).repartition(many, "__b").groupBy("__b").agg(F.collect_list(F.struct("vec_id", "e")).alias("own")).select("own")  # some BLOCK rows
    n = asked.count()
    blocks = -(-n // BLOCK)
    parts = [asked] if blocks <= 1 else [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)) == b) for b in range(2 * blocks)]
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    schema = T.StructType([T.StructField("query_id", queries.schema["vec_id"].dataType), T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("similarity", T.DoubleType())])

    def meet(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            out = to_arrow_schema(schema)
            asked = {part[1].shape[1]: part for part in sent.value}
            for batch in batches:
                for block in batch.column(0):
                    for ids, x, norm in _by_size(block.values):
                        for found in _best(ids, x, norm, asked[x.shape[1]], k) if x.shape[1] in asked else ():
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, out, strict=True)], schema=out)

        return run

    out = None
    for part in parts:
        t = part.toArrow()  # one block
        sent = spark.sparkContext.broadcast(list(_by_size(t.to_struct_array().combine_chunks() if t.num_rows else pa.array([], pa.struct(t.schema)))))
        scored = own.mapInArrow(meet(sent), schema)
        best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.unionAll(best)
    return out.where(F.col("similarity") >= least)


def hash_embedding(text: Column, size: int = 128) -> Column:
    """The 16 bytes of a text's MD5, repeated to ``size`` places, as byte / 128 - 1."""
    digest = F.md5(text)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(digest, (i % 16) * 2 + 1, F.lit(2)), 16, 10).cast("int") / 128 - 1)
