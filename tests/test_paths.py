"""Guided simple paths against a search of all."""

import random

from lodestone.operators import walks


def all_paths(edges, a, b, depth):
    after, out = {}, []
    for x, y in edges:
        if x != y:
            after.setdefault(x, set()).add(y)
    todo = [(a,)]
    while todo:
        p = todo.pop()
        if p[-1] == b:
            out.append(p)
        elif len(p) <= depth:
            todo += [(*p, y) for y in after.get(p[-1], ()) if y not in p]
    return sorted(out, key=lambda p: (len(p), p))


def test_guided_paths(spark):
    rng = random.Random(7)
    edges = [(i, rng.randrange(12)) for i in range(12) for _ in range(2)]
    pairs = [(0, 5), (3, 1), (2, 2), (7, 11), (4, 99)]
    frames = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([*pairs, pairs[0]], "source long, target long")
    for depth, most in ((20, 50), (6, 3)):
        got = {}
        for r in walks.guided_paths(*frames, depth, most).collect():
            assert r["length"] == len(r["path"]) - 1
            got.setdefault((r["source"], r["target"]), []).append(tuple(r["path"]))
        for a, b in pairs:
            want = all_paths(edges, a, b, depth)[:most] if a != b else []
            assert sorted(got.get((a, b), []), key=lambda p: (len(p), p)) == want
    assert walks.guided_paths(frames[0], frames[1].limit(0)).collect() == []
