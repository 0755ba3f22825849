"""Resampling, packing and whitening against plain computations, and odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import binary, packing, resample, whitening

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "é", "x1", "ÀB", "z"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(15, 40))), "o", 1) for i in range(60)]
    rows += [(100, None, "o", None), (101, "", None, 1), (102, "...", "o", 1), (None, " ".join(words * 5), "o", 1), (rows[0]), (103, "alpha " * 60_000, "o", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, `rank` string, `__key` int"), rows


def plain_scores(rows, target, shortest=1, longest=1):
    def grams(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [" ".join(w[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % resample.BUCKETS
    raw = collections.Counter(bucket(g) for _, t, *_ in rows for g in grams(t)[1])
    want = collections.Counter(bucket(g) for t in target for g in grams(t)[1])
    s, t = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in raw}
    out = []
    for i, text, *_ in rows:
        n, g = grams(text)
        weight = sum(gain[bucket(x)] for x in g)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    order = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(order[: len(order) * 10 // 100], 1):
        x[5] = k
    return [tuple(map(str, (x[0], *x[2:]))) for x in out]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, odd, longest):
    docs, rows = odd
    target = spark.createDataFrame([("alpha beta alpha",), (None,), ("new words",)], "text string")
    got = resample.scored(docs, target, longest=longest, key=None).drop("__key").collect()
    found = [tuple(map(str, (r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]))) for r in got]
    assert sorted(found) == sorted(plain_scores(rows, ["alpha beta alpha", None, "new words"], 1, longest))


def test_drawn_rows_keep_their_columns(spark, odd):
    docs, rows = odd
    target = spark.createDataFrame([("alpha beta alpha",)], "text string")
    got = resample.resampled(docs, target).collect()
    want = [x for x in plain_scores(rows, ["alpha beta alpha"]) if x[4] != "None"]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(x[0] for x in want) and all(r["rank"] == "o" for r in got)
    assert resample.resampled(docs.limit(0), target).collect() == []
    assert len(resample.scored(docs, target.limit(0)).collect()) == len(rows)


def test_resampling_by_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    got = resample.query(spark, FOLDER).toPandas()[columns].astype("float64").fillna(-1)
    want = db.sql(resample.SQL).df()[columns].astype("float64").fillna(-1)
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def fewest(items, capacity):
    """By trying every bin for every piece."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            k = rooms.index(room)
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_bin_completion_is_the_best_of_all():
    rng, better = random.Random(1), 0
    for _ in range(250):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randint(*rng.choice([(1, capacity), (capacity // 5, capacity // 2)])) for _ in range(rng.randint(0, 11))]
        counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int)
        bins, proven = packing.complete(counts, capacity)
        want = fewest(items, capacity)
        assert sorted(x for b in bins for x in b) == sorted(items) and all(sum(b) <= capacity for b in bins)
        assert packing.least_bins(counts, capacity) <= want <= len(bins) and (not proven or len(bins) == want)
        assert len(bins) == want
        better += want < len(packing.best_fit(counts, capacity))
    assert better > 0


def test_bin_completion_beats_best_fit_on_many_pieces():
    rng = random.Random(2)
    counts = np.bincount([rng.randint(300, 700) for _ in range(3000)], minlength=2049)
    bins, _ = packing.complete(counts, 2048)
    assert len(bins) < len(packing.best_fit(counts, 2048)) and sum(map(len, bins)) == 3000


def test_dominated_fillings_are_left_out():
    counts = np.bincount([3, 4, 5, 6], minlength=21)
    assert packing.fillings(counts, 9) == [(5, 4), (6, 3)]
    assert packing.fillings(counts, 6) == [(6,)] and packing.fillings(counts, 2) == [()]


def test_pieces_and_sequences(spark, odd):
    docs, rows = odd
    model = Tokenizer.from_file(binary.public())
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at, k = 0, 0
        while at < len(ids):
            end = at + (len(ids) % 2048 or 2048) if not at else at + 2048
            want[i, k, at, end - at, zlib.crc32(ids[at:end].tobytes())] += 1
            at, k = end, k + 1
    for group, carry in ((packing.GROUP, packing.CARRY), (16, 4)):
        got = packing.packed(packing.pieces(docs, binary.public()), group=group, carry=carry).collect()
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        by = collections.defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in by.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
        total = sum(r["length"] for r in got)
        assert len(by) == -(-total // 2048) or group < packing.GROUP
    assert packing.packed(packing.pieces(docs.limit(0), binary.public())).collect() == []
    whole = packing.sequences(docs, binary.public()).collect()
    assert sum(r["n_ids"] for r in whole) == total
    for r in whole:
        assert len(r["ids"]) == 4 * r["n_ids"]
        for p in r["pieces"]:
            part = bytes(r["ids"][4 * p["offset"] : 4 * (p["offset"] + p["length"])])
            assert want[p["doc_id"], p["piece"], p["start"], p["length"], zlib.crc32(part)]


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 6)) @ rng.normal(size=(6, 6)) + 3
    rows = [(i, v.tolist(), "n") for i, v in enumerate(base)] + [(500 + i, base[0].tolist(), "n") for i in range(20)] + [(None, base[1].tolist(), "n"), (2**60 + 1, base[2].tolist(), None)]
    bad = [(900, None, "n"), (901, [1.0, float("nan"), 2.0, 3.0, 4.0, 5.0], "n"), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0], "n"), (903, [float("-inf")] * 6, "n"), (904, [], "n"), (905, [1.0, 2.0], "n"), (906, [1e30] * 6, "n")]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>, n string")
    got = whitening.whitened(frame(rows + bad), components=4).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i, *_ in rows)
    x = {str(i): [math.floor(64 * c) + 1_000_000 for c in v] for i, v, _ in rows}
    own = sorted({tuple(v) for v in x.values()})
    n, sums = len(own), [sum(c) for c in zip(*own, strict=True)]
    c = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in own])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    for r in got:
        own_x = x[str(r["vec_id"])]
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(own_x, sums, strict=True)) and r["identity_error"] < 1e-9
        want = np.array([(n * a - s) / n for a, s in zip(own_x, sums, strict=True)]) @ v[:, :4] / np.sqrt(e[:4])
        assert np.allclose(np.abs(r["whitened"]), np.abs(want), atol=1e-9) and np.allclose(r["explained"], e[:4] / e.sum())
    assert whitening.whitened(frame([])).collect() == [] and whitening.whitened(frame(bad[:5])).collect() == []
    one = whitening.whitened(frame(rows[:1] * 3)).collect()
    assert len(one) == 3 and one[0]["whitened"] == [] and one[0]["deviation"] == 0
    huge = [(1, [1e11, -1e11, 5.0]), (2, [-1e11, 2e11, 1.0]), (3, [0.0, 1.0, 7.0])]
    for r in whitening.whitened(frame([(*h, "n") for h in huge])).collect():
        at = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in huge]
        s = [sum(c) for c in zip(*at, strict=True)]
        assert r["deviation"] == sum((3 * a - b) ** 2 for a, b in zip(at[r["vec_id"] - 1], s, strict=True))
