"""Nearest vectors by an inverted file: lists around centres, coded residuals, exact
re-ranking.

Centres come from k-means on a bounded sample; every row is in the list of its nearest
centre with its residual in one byte a dimension.  A query looks into its nearest
lists, ranks what it finds by the codes, and the best are ranked again by their
vectors.  ``vectors.top_k`` stays the exact way.

At scale: lists are cut into blocks by a hash of the row, so that a list that holds a
third of all rows is many groups; the codes are a quarter of the vectors; a block and
the queries that look into it meet as two matrices in one task, which returns the
``wide`` best of each query, so no pair is a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import dealt, written
from .vectors import dot

SAMPLE = 65_536  # rows that centres are fitted on, at most: those of the smallest hashes
ROWS_A_BLOCK = 16_384
CELLS = 1 << 22  # products of queries and rows that a task holds at once


@dataclass
class Index:
    """centres: (list, c, blocks); codes: (list, block, vec_id, code, scale); units: (vec_id, e)."""

    centres: DataFrame
    codes: DataFrame
    units: DataFrame


def unit(rows: DataFrame) -> DataFrame:
    """(vec_id, e) with e of length 1; rows of null vectors, of null or not finite
    entries or of length 0 have no direction and go."""
    e = F.col("embedding").cast("array<double>")
    own = dealt(rows.select("vec_id", "embedding")).select("vec_id", e.alias("e")).where(F.col("e").isNotNull() & ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    norm = F.sqrt(dot(F.col("e"), F.col("e")))
    return own.withColumn("n", norm).where("n > 0").select("vec_id", F.transform("e", lambda c: c / F.col("n")).alias("e"))


def _nearest(rows: DataFrame, centres: DataFrame, key: str, n: int) -> DataFrame:
    """(key, list) of the ``n`` centres nearest to each row (key, e)."""
    pairs = rows.crossJoin(F.broadcast(centres.select("list", "c")))  # a few thousand centres
    w = Window.partitionBy(key).orderBy(F.desc("near"), "list")
    return pairs.select(key, "list", dot(F.col("e"), F.col("c")).alias("near")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select(key, "list")


def build(rows: DataFrame, lists: int = 64, seed: int = 7) -> Index:
    """The index of all ``rows`` (vec_id, embedding); repeated ids are rows of their own.
    Without a row that has a direction it is empty."""
    spark = rows.sparkSession
    units = written(unit(rows), "units")
    n = units.count()
    if not n:
        none = spark.createDataFrame([], "list int, c array<double>, blocks int")
        return Index(none, spark.createDataFrame([], f"list int, block int, vec_id {rows.schema['vec_id'].dataType.simpleString()}, code array<tinyint>, scale double"), units)
    bound = int((2 * min(1.0, 2.0 * SAMPLE / n) - 1) * 2**63)
    sample = units.where(F.xxhash64("vec_id", F.lit(seed)) <= F.lit(min(bound, 2**63 - 1))).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE)
    model = KMeans(k=min(lists, n), seed=seed, maxIter=10, featuresCol="v").fit(sample.select(array_to_vector("e").alias("v")))
    found = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, c array<double>")
    own = model.transform(units.withColumn("v", array_to_vector("e"))).select("vec_id", "e", F.col("prediction").alias("list"))
    off = own.join(F.broadcast(found), "list").withColumn("r", F.zip_with("e", "c", lambda a, b: a - b))
    scale = F.greatest(F.array_max(F.transform("r", F.abs)), F.lit(1e-9)) / 127.0
    coded = off.withColumn("scale", scale).select("list", "vec_id", F.transform("r", lambda x: F.round(x / F.col("scale")).cast("tinyint")).alias("code"), "scale")
    sizes = own.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS_A_BLOCK).cast("int").alias("blocks"))
    centres = written(found.join(sizes, "list"), "centres")
    codes = coded.join(F.broadcast(centres.select("list", "blocks")), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    return Index(centres, written(codes.select("list", "block", "vec_id", "code", "scale"), "codes"), units)


def _best(rows: DataFrame, by: Column, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _few(wide: int, schema: T.StructType):
    """A function of queries (query_id, q, near) and the rows (vec_id, code, scale) of one
    block: of each query the ``wide`` best rows by code, not its own id, ties in the order
    of ids."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        if not asked.num_rows or not rows.num_rows:
            return out.empty_table()
        rows, asked = rows.sort_by("vec_id"), asked.sort_by("query_id")
        ids, n = rows["vec_id"].combine_chunks(), rows.num_rows
        different = ids.unique()
        number = pc.index_in(ids, different).to_numpy()
        own = pc.fill_null(pc.index_in(asked["query_id"].combine_chunks(), different), -1).to_numpy(zero_copy_only=False)
        first, last = np.searchsorted(number, own), np.where(own < 0, 0, np.searchsorted(number, own, side="right"))
        code, scale = _matrix(rows["code"], np.float64).T, rows["scale"].to_numpy()
        q, near = _matrix(asked["q"], np.float64), asked["near"].to_numpy()
        which, what, how = [], [], []
        many = max(1, CELLS // n)
        for i in range(0, len(q), many):
            # Rounded, so that equal codes are equal wherever they stand in a product.
            about = np.round(near[i : i + many, None] + (q[i : i + many] @ code) * scale, 9) + 0.0
            for k in np.flatnonzero(last[i : i + many] > 0):
                about[k, first[i + k] : last[i + k]] = -np.inf
            kept = about > -np.inf
            if n > wide:
                least = np.partition(about, n - wide, axis=1)[:, n - wide, None]
                more, even = about > least, (about == least) & kept
                kept = more | (even & (np.cumsum(even, axis=1, dtype=np.int32) <= wide - more.sum(axis=1, keepdims=True)))
            at, row = np.nonzero(kept)
            which.append(at + i)
            what.append(row)
            how.append(about[at, row])
        columns = [asked["query_id"].combine_chunks().take(pa.array(np.concatenate(which))), ids.take(pa.array(np.concatenate(what))), pa.array(np.concatenate(how))]
        return pa.Table.from_arrays(columns, schema=out)

    return run


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 16, wide: int = 100) -> DataFrame:
    """(query_id, vec_id, similarity, rank): of the rows in a query's ``probes`` nearest
    lists the ``wide`` best by code, of these the ``k`` most similar by their vectors; a
    query does not find its own id.  A stated query set; one without direction finds
    nothing."""
    asked = written(unit(queries).select(F.col("vec_id").alias("query_id"), "e").where("query_id is not null"), "asked")
    ways = _nearest(asked, index.centres, "query_id", probes).join(F.broadcast(index.centres), "list")
    ways = ways.join(asked, "query_id").select("query_id", F.col("e").alias("q"), dot(F.col("e"), F.col("c")).alias("near"), "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    schema = T.StructType([asked.schema["query_id"], index.codes.schema["vec_id"], T.StructField("about", T.DoubleType())])
    cell = lambda df: dealt(df, "list", "block").groupBy("list", "block")
    met = cell(ways).cogroup(cell(index.codes.where("vec_id is not null"))).applyInArrow(_few(wide, schema), schema)
    few = written(_best(met, F.col("about"), wide).select("query_id", "vec_id").distinct(), "few")
    exact = dealt(few, "vec_id").join(index.units, "vec_id").join(asked.select("query_id", F.col("e").alias("q")), "query_id")
    scored = exact.select("query_id", "vec_id", F.round(dot(F.col("e"), F.col("q")), 4).alias("similarity"))
    return _best(scored, F.col("similarity"), k).withColumnRenamed("k", "rank")
