"""MinHash near-duplicates by an inverted join of signature coordinates.

1. Texts become sets of word-shingle hashes; texts with equal sets fall
   together by a 128-bit fingerprint, so copies are one *node* from here on.
2. A node's MinHash signature has ``K`` coordinates.  A pair that agrees in at
   least ``t`` of them shares one of any ``K - t + 1``: each node is posted
   under its rarest ``K - t + 1`` coordinate-value pairs only (the prefix; rarity
   by a count sketch of fixed size).  ``t`` follows from the wanted similarity:
   a pair at the bound agrees in fewer coordinates once in ``1 / MISS`` times.
3. Skip merging of the lists: the members of a list are first held against one
   member, its most typical one.  Their collisions are counted over the whole
   signature; pairs with ``t`` or more are confirmed on the full sets.  Members
   that this links are one component and need no further comparison.
4. What is left of a list (members of different components, without the centre)
   is compared pair by pair inside a task, signatures first.  A rest of more than
   ``REFINE`` members is first dealt by a second common coordinate; a long rest is
   dealt into blocks, each pair of blocks a group of its own.  Only links leave a task.
5. Components of the links, by the smallest label with pointer jumping.

So a group of n copies or near copies costs about n comparisons, no list is
gathered in one task beyond ``BLOCK`` members a side, and no link is lost but by
the stated chance of step 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

K = 64
MISS = 1e-5
BLOCK = 1024
SKETCH = 1 << 18  # cells of the count sketch, at least; 16 times as many at most
REFINE = 16 * BLOCK  # members of a list that is dealt by a second coordinate
MANY = 100_000  # buckets that are broadcast, at most
DENSE = 4  # pairs per member from which a block is settled on full sets in its task
_SEED = np.random.default_rng(20240607)
_A = _SEED.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 2**63, K, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def least_matches(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The most coordinates t such that a pair of this similarity agrees in
    fewer than t with a chance of at most ``miss``."""
    total = 0.0
    for t in range(k + 1):
        total += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if total > miss:
            return max(t, 1)
    return k


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """The powers 0 .. n - 1 of an odd number."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16), _P))])
    return _powers[:n]


def shingle_set(raw: bytes, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles.

    Words by the word rule, A-Z lower-cased; fewer than n words are one
    shingle; no word, no shingle.
    """
    data = np.frombuffer(raw.lower(), np.uint8)
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # Words as numbers to the base _P, from differences of one running sum
        # and a shift to the same power.
        power = _power(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        h = (sums[end] - sums[start]) * _inverse(start)
        h = _mix(h ^ ((end - start).astype(np.uint64) * _Q))
        size = min(n, len(h))
        k = len(h) - size + 1
        s = np.full(k, np.uint64(size))
        for i in range(size):
            s = _mix(s * _P + h[i : i + k])
    return np.unique(s)


_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_inverses = np.ones(1, np.uint64)


def _inverse(at: np.ndarray) -> np.ndarray:
    global _inverses
    if len(_inverses) <= int(at[-1]):
        with np.errstate(over="ignore"):
            _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(int(at[-1]) + 1, 1 << 16), _INVERSE))])
    return _inverses[at]


def signature(s: np.ndarray) -> np.ndarray:
    """K minima of multiply-add hashes."""
    best = np.full(K, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            best = np.minimum(best, (s[None, i : i + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    return best


def _fingerprint(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _sets(docs: DataFrame, text_col: str, n: int, keep: list[str], whole: bool) -> DataFrame:
    """``keep`` columns with fp, n_shingles and the set or the signature."""
    name = "shingles" if whole else "signature"
    schema = T.StructType.fromDDL(f"fp binary, n_shingles long, {name} {'array<long>' if whole else 'binary'}")

    def make():
        def run(values: list) -> dict:
            sets = [shingle_set(v, n) for v in values]
            got = [s.view(np.int64) for s in sets] if whole else [signature(s).tobytes() if len(s) else b"" for s in sets]
            return {"fp": [_fingerprint(s) if len(s) else None for s in sets], "n_shingles": [len(s) for s in sets], name: got}

        return run

    own = docs.select(*keep, common.as_bytes(text_col).alias("__text"))
    return common.append(own, schema, F.col("__text"), make).drop("__text")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal keys (the first three columns) of sorted rows."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        keys = np.stack([t.column(c).to_numpy() for c in range(3)])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(cut, cut[1:], strict=False):
            yield t.slice(a, b - a)
        rest = t.slice(cut[-1])
    if rest is not None and rest.num_rows:
        yield rest


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id of the edges (a, b) reaches."""
    both = common.written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = common.written(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("new"), "label")
        # The label of the label shortens long chains.
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        step = common.written(step.join(jump, "new").select("id", F.least("new", "far").alias("new"), "label"), "labels")
        labels = step.select("id", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels


def _split_join(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` joined to ``sizes`` (bucket, size, ...) without a shuffle of the rows
    of large buckets: these are ``MANY`` at most, by the limit on their size, and
    broadcast; the others meet by bucket."""
    limit = max(BLOCK, rows.count() // MANY)
    large = F.broadcast(sizes.where(F.col("size") > limit))  # MANY rows at most
    few = rows.join(F.broadcast(sizes.where(F.col("size") > limit).select("bucket")), "bucket", "left_anti")
    return rows.join(large, "bucket").unionByName(few.join(sizes.where(F.col("size") <= limit), "bucket"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b")
    common_ = F.size(F.array_intersect("sa", "sb"))
    return joined.where(F.lit(100) * common_ >= F.lit(percent) * (F.size("sa") + F.size("sb") - common_)).select("a", "b")


class Links:
    """The steps over one table of nodes (rid, key, n_shingles, signature)."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, text_col: str, n: int, percent: int):
        self.nodes, self.docs, self.text_col, self.n, self.percent = nodes, docs, text_col, n, percent
        self.t = least_matches(percent / 100)
        self.spark = nodes.sparkSession

    def postings(self) -> DataFrame:
        """(bucket, rid, weight) for the prefix of each node."""
        count = self.nodes.count()
        cells = 1 << min(max((count // 4).bit_length(), SKETCH.bit_length() - 1), SKETCH.bit_length() + 3)
        shift, at = np.uint64(64 - (cells.bit_length() - 1)), np.arange(K, dtype=np.uint64)

        def buckets(raw: list) -> np.ndarray:
            sig = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), K)
            with np.errstate(over="ignore"):
                return _mix(sig + (at * _Q)[None, :])

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells, np.int64)
            for batch in batches:
                if batch.num_rows:
                    total += np.bincount((buckets(batch.column(0).to_pylist()) >> shift).ravel().astype(np.int64), minlength=cells)
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], names=["cell", "n"])

        # At most ``cells`` rows reach the driver, whatever the input.
        seen = self.nodes.select("signature").mapInArrow(sketch, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        freq = np.zeros(cells, np.int64)
        freq[seen["cell"].to_numpy()] = seen["n"].to_numpy()
        shared = self.spark.sparkContext.broadcast(freq)
        prefix = K - self.t + 1
        self.coordinates = buckets, shared, shift

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            freq = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                b = buckets(batch.column(1).to_pylist())
                f = freq[b >> shift]
                order = np.lexsort((b, f), axis=1)[:, :prefix]
                typical = np.minimum(f, 1 << 24).sum(axis=1)
                rid = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(b, order, 1).ravel().view(np.int64)), pa.array(np.repeat(rid, prefix)), pa.array(np.repeat(typical, prefix))], names=["bucket", "rid", "weight"])

        return self.nodes.select("rid", "signature").mapInArrow(post, "bucket long, rid long, weight long")

    def lists(self) -> DataFrame:
        """The postings of lists with two or more members, with their centre."""
        posts = common.written(self.postings(), "postings")
        size = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max_by("rid", F.struct("weight", "rid")).alias("centre")).where("size > 1")
        return common.written(_split_join(posts.select("bucket", "rid"), common.written(size, "sizes")), "lists")

    def matching(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that agree in t coordinates and can be similar."""
        one = self.nodes.select(F.col("rid").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
        two = self.nodes.select(F.col("rid").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
        fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
        joined = pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "sa", "sb")
        t = self.t

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, K) for c in (2, 3)]
                    yield batch.select([0, 1]).filter(pa.array((own[0] == own[1]).sum(axis=1) >= t))

        return joined.mapInArrow(count, "a long, b long")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(rid, shingles) of the nodes in ``ids`` (id), from their texts."""
        wanted = self.nodes.join(ids.distinct().withColumnRenamed("id", "rid"), "rid", "left_semi").select("rid", "key", "fp")
        texts = self.docs.join(wanted.select("key"), "key", "left_semi")
        got = _sets(texts, self.text_col, self.n, ["key"], whole=True)
        # Keys are 64-bit: the fingerprint decides.  Copies come once.
        return got.join(wanted.select("rid", "key", "fp"), ["key", "fp"]).dropDuplicates(["rid"]).select("rid", "shingles")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        pairs = common.written(self.matching(pairs), "pairs")
        sets = common.written(self.sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), "sets")
        return common.written(_confirmed(pairs, sets, self.percent), "edges")

    def refined(self, rows: DataFrame) -> DataFrame:
        """(bucket, rid, label) of long lists, dealt by a second coordinate: a pair that
        agrees in t coordinates, one of them the list's, shares one of any K - t + 1 of
        the others, so each member is posted under its rarest of these."""
        buckets, shared, shift = self.coordinates
        prefix = K - self.t + 1

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            freq = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy().view(np.uint64)[:, None]
                b = buckets(batch.column(3).to_pylist())
                f = np.where(b == own, np.iinfo(np.int64).max, freq[b >> shift])  # the list's own comes last
                order = np.lexsort((b, f), axis=1)[:, :prefix]
                with np.errstate(over="ignore"):
                    second = _mix(np.take_along_axis(b, order, 1) ^ (own * _P))
                yield pa.RecordBatch.from_arrays([pa.array(second.ravel().view(np.int64)), pa.array(np.repeat(batch.column(1).to_numpy(), prefix)), pa.array(np.repeat(batch.column(2).to_numpy(), prefix))], names=["bucket", "rid", "label"])

        signed = rows.join(self.nodes.select("rid", "signature"), "rid").select("bucket", "rid", "label", "signature")
        return signed.mapInArrow(post, "bucket long, rid long, label long")

    def rest(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """What the centres did not settle: (bucket, i, j, rid, label, side)."""
        own = lists.where("size > 2 and rid <> centre").select("bucket", "rid")
        own = own.join(labels.withColumnRenamed("id", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        own = common.written(own, "rest")


        def sizes(rows: DataFrame) -> DataFrame:
            counts = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
            return common.written(counts.where("lo <> hi").select("bucket", "size"), "mixed")

        mixed = sizes(own)
        long = mixed.where(F.col("size") > REFINE)
        if self.t > 1 and not long.isEmpty():
            second = common.written(self.refined(_split_join(own, long).drop("size")), "second")
            own = _split_join(own, mixed.where(F.col("size") <= REFINE)).unionByName(_split_join(second, sizes(second)))
        else:
            own = _split_join(own, mixed)
        own = own.withColumn("q", F.ceil(F.col("size") / BLOCK).cast("int"))
        own = own.withColumn("side", F.pmod(F.xxhash64("rid", F.lit(11)), F.col("q")).cast("int"))
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        return own.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "rid", "label", "side")

    def blocks(self, rest: DataFrame) -> DataFrame:
        """Pairs of the blocks by signature: rows (dense, bucket, i, j, a, b).

        A block with few of them gives pairs (a, b); one with many gives its
        members that have any (a = b) for a comparison on full sets.
        """
        rows = rest.join(self.nodes.select("rid", "signature", "n_shingles"), "rid").select("bucket", "i", "j", "rid", "label", "side", "n_shingles", "signature")
        rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        t, percent = self.t, self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches):
                bucket, i, j = (g.column(c)[0].as_py() for c in range(3))
                rid, label, side, size = (g.column(c).to_numpy() for c in range(3, 7))
                s = np.frombuffer(b"".join(g.column(7).to_pylist()), np.uint64).reshape(len(rid), K)
                found = [np.zeros((0, 2), np.int64)]
                for k in range(0, len(rid), 128):
                    same = np.zeros((min(128, len(rid) - k), len(rid)), np.int16)
                    for c in range(K):
                        same += s[k : k + 128, c, None] == s[None, :, c]
                    ok = (same >= t) & (label[k : k + 128, None] != label[None, :]) & (rid[k : k + 128, None] < rid[None, :])
                    ok &= 100 * np.minimum(size[k : k + 128, None], size[None, :]) >= percent * np.maximum(size[k : k + 128, None], size[None, :])
                    if i != j:  # pairs within a block belong to the block itself
                        ok &= side[k : k + 128, None] != side[None, :]
                    a, b = np.nonzero(ok)
                    found.append(np.stack([a + k, b], axis=1))
                pairs = np.concatenate(found)
                if not len(pairs):
                    continue
                dense = len(pairs) > DENSE * len(rid)
                own = np.unique(pairs) if dense else None
                a, b = (rid[own], rid[own]) if dense else (rid[pairs[:, 0]], rid[pairs[:, 1]])
                yield pa.RecordBatch.from_pydict({"dense": [dense] * len(a), "bucket": pa.array([bucket] * len(a), pa.int64()), "i": pa.array([i] * len(a), pa.int32()), "j": pa.array([j] * len(a), pa.int32()), "a": a, "b": b})

        return rows.mapInArrow(compare, "dense boolean, bucket long, i int, j int, a long, b long")

    def settled(self, dense: DataFrame, labels: DataFrame) -> DataFrame:
        """Links of dense blocks, on full sets in their tasks: those that join
        different components, a spanning forest at most."""
        sets = common.written(self.sets(dense.select(F.col("a").alias("id"))), "sets")
        rows = dense.select("bucket", "i", "j", F.col("a").alias("rid")).join(sets, "rid").join(labels.withColumnRenamed("id", "rid"), "rid", "left")
        rows = rows.select("bucket", "i", "j", "rid", F.coalesce("label", "rid").alias("label"), "shingles").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches):
                rid, label = g.column(3).to_numpy(), g.column(4).to_numpy()
                lists = g.column(5).combine_chunks()
                flat = lists.flatten().to_numpy()
                size = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(rid)), size)
                _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
                often = times[code] > 1  # a shingle of one set is in no intersection
                new = np.cumsum(times > 1) - 1
                both = np.zeros((len(rid), len(rid)), np.float32)
                at, col = doc[often], new[code[often]]
                for c in range(0, int((times > 1).sum()), 8192):  # bounds the matrix
                    part = (col >= c) & (col < c + 8192)
                    m = np.zeros((len(rid), min(8192, int((times > 1).sum()) - c)), np.float32)
                    m[at[part], col[part] - c] = 1
                    both += m @ m.T
                n = np.rint(both).astype(np.int64)
                a, b = np.nonzero(np.triu(100 * n >= percent * (size[:, None] + size[None, :] - n), 1))
                root = {int(x): int(x) for x in label}

                def find(x: int, root=root) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                out = []
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    p, q = find(int(label[x])), find(int(label[y]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((int(rid[x]), int(rid[y])))
                if out:
                    yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]})

        return rows.mapInArrow(compare, "a long, b long")

    def labels(self) -> DataFrame:
        """(id, label) of the nodes that have a link."""
        lists = self.lists()
        stars = lists.where("rid <> centre").select(F.least("rid", "centre").alias("a"), F.greatest("rid", "centre").alias("b")).distinct()
        edges = self.confirmed(stars)
        labels = components(edges)
        found = common.written(self.blocks(self.rest(lists, labels)), "blocks")
        more = self.confirmed(found.where("not dense").select("a", "b").distinct())
        dense = found.where("dense")
        if not dense.isEmpty():
            more = common.written(self.settled(dense, labels), "edges").union(more)
        return labels if more.isEmpty() else components(edges.union(more))


def classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their
    distinct n-word shingles; component_id is the smallest id reachable.  A text
    without words (null, empty) has no shingles and no links.  Null ids come
    after all others: a component of null ids only has a null id.  Of rows that
    repeat the kept id each is kept.  ``key`` is a hash of id and text.  A long
    text is read whole; extra columns are dropped; an empty table gives an empty one.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    table = common.written(_sets(own, "text", n, ["doc_id", "key"], whole=False), "signatures")
    some = table.where("n_shingles > 0")
    nodes = some.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = common.written(nodes.withColumn("rid", F.monotonically_increasing_id()), "nodes")
    labels = Links(nodes, own.select("key", "text"), "text", n, percent).labels()
    linked = nodes.select("rid", "fp", "least").join(labels.withColumnRenamed("id", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    smallest = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    found = linked.join(smallest, "label").select("fp", "component_id")
    out = table.drop("signature").join(found, "fp", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component: the one with its smallest id.

    Null and empty texts are linked with nothing and stay; rows that repeat the
    kept id and text stay all; an empty table stays empty; every column passes as
    it is, whatever its name.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **how).where("kept").select(F.col("key").alias("__key")).distinct()
    rows = common.as_row(docs, F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("__key"))
    return rows.join(found, "__key", "left_semi").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs, n=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') as g from (select doc_id, w, unnest(range(1, (len(w) - least(3, len(w)) + 2)::bigint)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d left join n using (doc_id) join m using (doc_id)"""
