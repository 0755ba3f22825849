"""Queries against their SQL on rows that the given tables do not have."""

import datetime

import duckdb

from lodestone.plans import catalogue, gates, reports, symbolgraph  # noqa: F401 (they fill the catalogue)


def both(spark, folder, name):
    """The rows of a query and of its SQL on the tables of a folder, sorted."""
    c = duckdb.connect()
    c.sql("set threads = 1")
    for t in folder.iterdir():
        c.sql(f"create view {t.name.removesuffix('.parquet')} as select * from '{t}/*.parquet' order by all")
    want = c.sql(catalogue.ORACLES[name]).df()
    got = catalogue.QUERIES[name](spark, str(folder)).toPandas()[list(want.columns)]
    return sorted(got.itertuples(index=False, name=None)), sorted(want.itertuples(index=False, name=None))


def events(spark, folder, rows, parts=1):
    e = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    e.repartitionByRange(parts, "event_id").write.parquet(f"{folder}/events.parquet")


def test_seconds_round(spark, tmp_path):
    """Half a second before the hour counts to the next hour (or minute)."""
    at = lambda *x: datetime.datetime(2024, 1, 1, *x)
    rows = [(1, at(0, 59, 59, 600_000), 1, "error", 1.0, ""), (2, at(6, 10), 1, "click", 90.0, ""), (3, at(1, 5, 10), 1, "view", 1.0, ""), (4, at(0, 59, 59, 500_000), 2, "error", 1.0, ""), (5, at(6, 10), 2, "click", 90.0, "")]
    events(spark, tmp_path, rows)
    for name in ("static_scores", "band_join"):
        got, want = both(spark, tmp_path, name)
        assert got == want and got, name


def test_mean_order(spark, tmp_path):
    """Means at a tie of the rounding, with a user's events in several files."""
    ties = [[53.12, 2.51, 32.35, 55.28, 47.17, 26.31, 54.05, 51.68], [54.55, 31.95, 24.25, 41.29, 40.94, 1.4, 26.65, 50.14], [44.99, 20.49, 44.34, 35.99, 44.07, 37.13, 0.89, 32.41], [44.67, 29.24, 40.2, 34.4, 9.97, 17.11, 46.73, 31.39]]
    rows = [(10 * i + u, datetime.datetime(2024, 1, 1), u, "click", v, "") for u, x in enumerate(ties) for i, v in enumerate(x)]
    near = {10: 0.671813, 11: 0.564938, 12: 0.542313, 13: 0.528563}  # these meet, or just miss, the ties rounded up
    rows += [(1000 + u, datetime.datetime(2024, 1, 1), u, "click", 60 * c, "") for u, c in near.items()]
    events(spark, tmp_path, rows, 8)
    for name in ("evidence_ranking", "candidate_rerank"):
        got, want = both(spark, tmp_path, name)
        assert got == want, name
    assert [r[0] for r in sorted(got, key=lambda r: r[2])] == [0, 10, 1, 11, 12, 2, 13, 3]


def test_block_hashes(spark, tmp_path):
    """Blocks are named by 32 bits: unlike blocks of a long text may share a name."""
    text = "a\nb\nx13784\nmiddle\na\nb\nx101030\nend"  # both md5 begin with eb554ae0
    spark.createDataFrame([(1, text), (2, "a\nb\nc\n\na\nb\nc\nd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, tmp_path, "duplicate_share")
    assert got == want and {r[0] for r in got} == {1, 2}


def test_blocks_of_texts_of_one_id(spark, tmp_path):
    """F8: no row is shuffled for a block; texts of one id meet, blank and # lines do not count."""
    rows = [(1, "a\nb\n c \n# x\n\nd"), (1, "q\n" * 4 + "a\nb\nc\r\nd\n"), (1, "c\nb"), (2, "a\nb\nc\nd"), (3, None), (4, ""), (None, "a\nb\nc\nd\n" * 2), (5, "é\nb\nc\n" * 3), (6, "x\n#\n" * 9), (7, "x\n" * 12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, tmp_path, "duplicate_share")
    assert got == want and {r[0] for r in got} == {1, 5, 6, 7}
    plan = catalogue.QUERIES["duplicate_share"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
