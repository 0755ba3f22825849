"""The inverted file against the exact search."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lodestone.functions import nearest, vectors


def test_recall_against_the_exact_way(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.where("vec_id % 20 = 0")
    index = nearest.build(rows, 32)
    assert index.codes.count() == rows.count()
    got = {(r["query_id"], r["vec_id"]): r["similarity"] for r in nearest.search(index, asked, 10, probes=24).collect()}
    want = {(r["query_id"], r["vec_id"]): r["similarity"] for r in vectors.top_k(rows, asked, 10).collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-3 for p in got.keys() & want.keys())


def test_hot_lists_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(200)] + [(1000 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(100)]
    odd = [(5000, None), (5001, [0.0, 0.0, 0.0]), (5002, [1.0, None, 2.0]), (5003, [float("nan"), 1.0, 1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    block = nearest.ROWS_A_BLOCK
    try:
        nearest.ROWS_A_BLOCK = 16  # the list of copies is many blocks
        index = nearest.build(frame, 8)
    finally:
        nearest.ROWS_A_BLOCK = block
    assert index.codes.groupBy("list", "block").count().where("count > 60").isEmpty() and index.codes.count() == 300
    got = nearest.search(index, frame.where("vec_id in (0, 1000, 5001)"), 5, probes=8).collect()
    assert {r["query_id"] for r in got} == {0, 1000} and all(r["similarity"] == 1.0 for r in got if r["query_id"] == 0)
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 0) == [1, 2, 3, 4, 5]
    empty = nearest.build(frame.where("vec_id = 5000"))
    assert nearest.search(empty, frame.where("vec_id = 0")).collect() == []


def test_a_query_keeps_few_rows_a_block(spark):
    """What is sorted holds the best of blocks of rows, not all pairs; no number sorts first."""
    from pyspark.sql import functions as F

    from lodestone.functions import vectors

    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("double"), F.when(F.col("id") == 9, float("nan")).otherwise(1.0)).alias("embedding"))
    found = vectors.top_k(rows, rows.where("vec_id = 1"), 3)
    assert [tuple(r) for r in found.orderBy("rank").collect()][1:] == [(1, 8, 1.0, 2), (1, 15, 1.0, 3)]
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cells", [1 << 22, 1, 45])
def test_a_block_meets_its_queries_as_matrices(spark, monkeypatch, cells):
    """of each query the best rows of a block, as a plain sort of all pairs finds them."""
    monkeypatch.setattr(nearest, "CELLS", cells)
    rng = random.Random(5)
    rows = [(i // 2, [rng.randrange(-3, 4) for _ in range(3)], rng.choice([0.5, 0.25])) for i in range(40)]
    asked = [(i, [rng.gauss(0, 1) for _ in range(3)], rng.random()) for i in (3, 7, 500, 9)]
    tables = [pa.table(dict(zip(names, map(list, zip(*own)), strict=True))) for names, own in ((("query_id", "q", "near"), asked), (("vec_id", "code", "scale"), rows))]
    schema = T.StructType.fromDDL("query_id long, vec_id long, about double")
    for wide in (1, 7, 39, 40, 100):
        got = nearest._few(wide, schema)(*tables).to_pylist()
        want = []
        for q, e, near in asked:
            scored = sorted((-round(near + s * sum(a * b for a, b in zip(e, c)), 9), v) for v, c, s in rows if v != q)
            want += [(q, v, -x) for x, v in scored[:wide]]
        assert sorted((r["query_id"], r["vec_id"], round(r["about"], 6)) for r in got) == sorted((q, v, round(x, 6)) for q, v, x in want)
    assert nearest._few(3, schema)(tables[0].slice(0, 0), tables[1]).num_rows == 0


def test_rows_of_a_block_meet_queries_as_matrices(spark, monkeypatch):
    """no row of Spark is made for a pair; ties of the rounding and of ids are those of SQL functions."""
    from pyspark.sql import functions as F

    x = np.array([0.00005, 0.12345, 0.12344999999999999, 0.123450000001, -0.00005, -0.98765, 1.0, -0.00001, 0.5])
    want = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 4)).collect()
    assert (vectors._places(x.reshape(3, 3)).reshape(-1) / 1e4).tolist() == [r[0] for r in want]
    monkeypatch.setattr(vectors, "CELLS", 7)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(2 + (i == 60))]) for i in range(70)] + [(70, [1.0, None]), (None, [1.0, 1.0]), (71, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    a, b = frame.toDF("query_id", "q").where("query_id % 10 = 0"), frame
    near = F.round(vectors.dot(F.col("q"), F.col("embedding")) / (F.sqrt(vectors.dot(F.col("q"), F.col("q"))) * F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding")))), 4)
    lengths = (F.size("q") == F.size("embedding")) & (vectors.dot(F.col("q"), F.col("q")) > 0) & (vectors.dot(F.col("embedding"), F.col("embedding")) > 0)
    pairs = a.crossJoin(b).where(lengths & (F.col("vec_id") != F.col("query_id"))).select("query_id", "vec_id", near.alias("s")).collect()
    best = {}
    for r in sorted(pairs, key=lambda r: (-r["s"], r["vec_id"])):
        best.setdefault(r["query_id"], []).append((r["vec_id"], r["s"]))
    found = vectors.top_k(frame, frame.where("vec_id % 10 = 0"), 4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["similarity"]))
    assert got == {q: v[:4] for q, v in best.items()} and len(got) > 4
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
