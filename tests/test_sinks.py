"""Exports round trip; deltas and symbols on odd input."""

import pytest

from lodestone.operators import delta, graph, paths, syntax
from lodestone.sources import sinks


@pytest.mark.parametrize("form", ["json", "csv", "parquet", "orc"])
def test_round_trip(spark, tmp_path, form):
    rows = spark.createDataFrame([(1, 'a "b", c', "x"), (2, "é\\n", "y"), (3, None, "x")], "id long, text string, kind string")
    out = str(tmp_path / form)
    sinks.export(rows, out, form, ("kind",))
    assert sorted(map(tuple, sinks.imported(rows, out, form).select("id", "text", "kind").collect())) == sorted(map(tuple, rows.collect()))


def test_deletion_rewrites_only_what_holds_old_rows(spark, tmp_path):
    rows = [(i, f"2024-{m:02d}-{day:02d}", f"2024-{m:02d}") for i, (m, day) in enumerate((m, day) for m in range(1, 6) for day in (1, 15, 28))] + [(99, None, "2024-02")]
    frame = spark.createDataFrame(rows, "id long, day string, month string")
    path = str(tmp_path / "t")
    sinks.export(frame.repartition(1), path, "parquet", ("month",))
    files = lambda m: sorted(p.name for p in (tmp_path / "t" / f"month={m}").glob("*.parquet"))
    before = {m: files(m) for m in ("2024-03", "2024-04", "2024-05")}
    got = sinks.delete_before(spark, path, "day", 30, "month", "2024-04-14").first()
    assert (str(got["cutoff"]), got["deleted"], got["kept"], got["rewritten"], got["dropped"]) == ("2024-03-15", 7, 9, 2, 1)
    left = {r["id"] for r in spark.read.parquet(path).collect()}
    assert left == {i for i, day, _ in rows if day is None or day >= "2024-03-15"}
    assert files("2024-04") == before["2024-04"] and files("2024-05") == before["2024-05"] and files("2024-03") != before["2024-03"]
    again = sinks.delete_before(spark, path, "day", 30, "month", "2024-04-14").first()
    assert (again["deleted"], again["kept"], again["rewritten"], again["dropped"]) == (0, 9, 0, 0)


def test_snapshot_takes_null_digests(spark):
    a = spark.createDataFrame([(1, "p"), (2, None), (3, "q")], "k long, h string")
    b = spark.createDataFrame([(1, "r"), (2, None), (4, "q")], "k long, h string")
    assert {r["k"]: r["state"] for r in delta.snapshot(a, b, "k", "h").collect()} == {1: "modified", 2: "unchanged", 3: "deleted", 4: "added"}


def test_symbols_of_empty_and_null_texts(spark):
    files = spark.createDataFrame([("a", ""), ("b", None)], "path string, text string")
    assert syntax.symbols(files).count() == 0


def test_cycles_stand_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (4, 4)], "src long, dst long")
    assert sorted(r["path"] for r in graph.cycles(edges).collect()) == [[1, 2], [1, 2, 3], [4]]


def test_globs():
    assert paths.glob_regex("a[!b]*.p?") == r"^a[^b].*\.p.$"
