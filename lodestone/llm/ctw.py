"""Scores by context-tree weighting over bytes.

A text is its UTF-8 bytes with A-Z lower-cased, then an end byte (0xFF, which
UTF-8 never has).  A byte is eight binary decisions; each prefix of decisions
(255 nodes) has a context tree of its own over the ``depth`` bytes before, padded
with end bytes at the start.  A node's Krichevsky-Trofimov estimate follows
from its two counts alone, and so does the weighted probability

    Pw = KT                              at full depth
    Pw = (KT + product of children Pw) / 2   above

so the tree is built from counts of (context, byte) by bottom-up sums.  A frozen
tree predicts a decision by mixing the estimates along its path:

    p_d = (beta_d * kt_d + p_{d+1}) / (beta_d + 1),  beta = KT / product of children

where p at the deepest known node is its estimate.  The two decisions at a node
sum to 1, so the scores are log probabilities of a proper distribution.

At scale: counts of distinct (context, byte) pairs and of words are summed in
the task, then shuffled.  The tree is whole: no context is left out.  Pairs with
the same ``TOP`` nearest bytes of context stand in one subtree, which a task
builds (a group's pairs must fit a task); the driver joins the subtrees' roots,
fewer than 2^24, to the levels above, and with these each task gives the distinct
pairs of its subtrees their code lengths.  The lengths form a table that grows
with the text, as the word counts of the base score do.  Of both, the classes of
the most frequent entries (at most ``MOST`` pairs, ``HOT`` words) are broadcast; a
document's other pairs and words meet their entries in a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DEPTH = 5  # bytes of context, at most 6
TOP = 2  # nearest bytes of context that name a subtree
MOST = 1 << 19  # broadcast code lengths: some 50 MB as a hash table
HOT = 200_000  # broadcast word counts
KEEP = 400_000  # words or pairs that a task sums before it sends them on
CHUNK = 1_000_000  # bytes of text worked on at once
SLICE = 500  # documents scored at once
END = 0xFF
EMPTY = np.uint64(2**64 - 1)  # no code: with six bytes of context they have 56 bits


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        series = series - np.log(x + k)
    return series


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the estimate's block probability for a zeros, b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def parts(text: bytes, depth: int) -> list[tuple[bytes, bytes]]:
    """A text as (the bytes before, at most CHUNK bytes) parts, lower-cased and
    with its end byte."""
    body = text.lower() + bytes([END])
    padded = bytes([END]) * depth + body
    return [(padded[i : i + depth], body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]


def codes(own: list[tuple[bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) code of each position of some parts, and the
    positions per part.  The nearest context byte is the most significant, the
    predicted byte the least."""
    data = np.frombuffer(b"".join([x for part in own for x in part]), np.uint8).astype(np.uint64)
    sizes = np.array([len(body) for _, body in own])
    n = len(data) - depth
    out = data[depth:].copy()
    for i in range(1, depth + 1):
        out |= data[depth - i : depth - i + n] << np.uint64(8 * (depth + 1 - i))
    keep = np.ones(n, bool)
    later = np.cumsum(sizes + depth)[:-1] - depth  # where a later part's context begins
    for k in range(depth):
        keep[later + k] = False
    return out[keep], sizes


def chunks(own: list[tuple], size) -> Iterator[list]:
    """Runs with at most CHUNK bytes, or one element."""
    run, total = [], 0
    for x in own:
        n = size(x)
        if run and total + n > CHUNK:
            yield run
            run, total = [], 0
        run.append(x)
        total += n
    if run:
        yield run


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple:
    """Sorted distinct keys with the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[start], *(np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values)


def decisions(code: np.ndarray, count: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context, first ``level`` decisions) of sorted pairs, with counts."""
    key = code >> np.uint64(8 - level)
    one = (code >> np.uint64(7 - level)) & np.uint64(1)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, b = np.add.reduceat(count, start), np.add.reduceat(count * one.astype(np.int64), start)
    return key[start], n - b, b


def shorter(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without the context byte farthest from the predicted one."""
    return summed(((code >> np.uint64(16)) << np.uint64(8)) | (code & np.uint64(255)), n)


def rarer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimate of the rarer decision, negative where that is a zero: in single
    precision a one's own would be 1 after some 2^24 ones, and a zero impossible."""
    return (np.where(b <= a, b + 0.5, -(a + 0.5)) / (a + b + 1.0)).astype(np.float32)


def grown(pairs: dict, nodes: dict) -> tuple[dict, dict]:
    """(depth, level) -> sorted keys, estimate (as of ``rarer``), its share, from
    depth -> (sorted (context, byte) codes, counts); and level -> keys, log Pw, a,
    b of the least depth.  ``nodes`` has these of the depth below, or nothing."""
    out: dict = {}
    for d in sorted(pairs, reverse=True):
        pair, n = pairs[d]
        here: dict = {}
        for level in range(8):
            if not len(pair):
                out[d, level] = (np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.float32))
                continue
            key, a, b = decisions(pair, n, level)
            kt = log_kt(a, b)
            below = nodes.get(level)
            if below is None or not len(below[0]):
                weighted, share = kt, np.zeros(len(key))  # nothing below: the mix is its own estimate
            else:
                up = ((below[0] >> np.uint64(level + 8)) << np.uint64(level)) | (below[0] & np.uint64((1 << level) - 1))
                at = np.searchsorted(key, up)
                product = np.bincount(at, below[1], len(key))
                weighted = np.logaddexp(kt, product) - np.log(2)
                share = 1 / (1 + np.exp(np.clip(product - kt, -60, 60)))  # beta / (beta + 1)
            out[d, level] = (key, rarer(a, b), share.astype(np.float32))
            here[level] = (key, weighted, a, b)
        nodes = here
    return out, nodes


def tree(pairs: dict) -> dict:
    """The nodes of a whole tree, as of ``grown``."""
    return grown(pairs, {})[0]


class Model:
    """Sorted node tables; log2 probabilities of (context, byte) codes."""

    def __init__(self, depth: int, nodes: dict):
        self.depth = depth
        self.nodes = nodes
        self.shift, self.keys, self.values = np.uint64(54), np.full(1 << 10, EMPTY), np.zeros(1 << 10, np.float32)

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of each code, in bits."""
        total = np.zeros(len(code))
        for level in range(8):
            one = ((code >> np.uint64(7 - level)) & np.uint64(1)).astype(bool)
            prefix = (code & np.uint64(255)) >> np.uint64(8 - level)
            # The decision taken, from the root down: the weight left for what is deeper.
            p, left = np.zeros(len(code)), np.ones(len(code))
            last, alive = np.full(len(code), 0.5), np.arange(len(code))
            for d in range(self.depth + 1):
                keys, kt, shares = self.nodes[d, level]
                if not len(keys) or not len(alive):
                    break
                context = code[alive] >> np.uint64(8 * (self.depth - d + 1)) if d else np.zeros(len(alive), np.uint64)
                key = (context << np.uint64(level)) | prefix[alive]
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                found = keys[at] == key
                alive, at = alive[found], at[found]
                rare = kt[at].astype(float)
                last[alive] = np.where((rare > 0) == one[alive], np.abs(rare), 1.0 - np.abs(rare))
                share = shares[at]
                p[alive] += left[alive] * share * last[alive]
                left[alive] *= 1.0 - share
            p += left * last
            total -= np.log2(p)
        return total

    def remember(self, code: np.ndarray) -> None:
        """Keeps the code lengths of these codes (the most frequent first) in a
        hash table."""
        self.fill(code, self.bits(code).astype(np.float32))

    def fill(self, code: np.ndarray, values: np.ndarray) -> None:
        """Keeps these code lengths: each key goes to its place or the next free ones
        after it.  A quarter of the places is filled at most, and every key finds one."""
        self.shift = np.uint64(64 - max(10, (4 * len(code)).bit_length()))
        size = 1 << int(np.uint64(64) - self.shift)
        self.keys, self.values = np.full(size, EMPTY), np.zeros(size, np.float32)
        at = self._places(code)
        while len(code):
            free = np.flatnonzero(self.keys[at] == EMPTY)
            _, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.keys[at[own]], self.values[at[own]] = code[own], values[own]
            rest = np.ones(len(code), bool)
            rest[own] = False
            code, values, at = code[rest], values[rest], (at[rest] + 1) & (size - 1)

    def _places(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((code ^ (code >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def known(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths by table, and the positions that it does not have: a key that
        meets an empty place is not there."""
        at = self._places(code)
        out, missing = self.values[at], []
        rest = np.flatnonzero(self.keys[at] != code)
        at = at[rest]
        while len(rest):
            empty = self.keys[at] == EMPTY
            missing.append(rest[empty])
            rest, at = rest[~empty], (at[~empty] + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == code[rest]
            out[rest[hit]] = self.values[at[hit]]
            rest, at = rest[~hit], at[~hit]
        return out, np.sort(np.concatenate(missing)) if missing else rest

    def lengths(self, code: np.ndarray) -> np.ndarray:
        """As ``bits``, by table where remembered; other equal codes are
        computed once."""
        out, rest = self.known(code)
        own, back = np.unique(code[rest], return_inverse=True)
        out[rest] = self.bits(own)[back]
        return out


# Training.


def held_out(doc_id: Column) -> Column:
    """Rows that the model does not learn from; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def gathered(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    """(word, code, n, m) sums over the texts, n of the training rows and m of
    all: of words of training rows (code null; the end token is the empty word)
    and of (context, byte) pairs (word null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        def rows(word, code, n, m) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(code, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["word", "code", "n", "m"])

        def counted(words) -> pa.RecordBatch:
            return rows(list(words), [None] * len(words), list(words.values()), list(words.values()))

        words: Counter = Counter()
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = none
        for batch in batches:
            every = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for learned in (True, False):
                texts = [t for t, out in every if out != learned]
                if learned:
                    for t in texts:
                        words.update(t.lower().split())
                        if len(words) > KEEP:
                            yield counted(words)
                            words.clear()
                    words[b""] += len(texts)
                for run in chunks([p for t in texts for p in parts(t, depth)], lambda p: len(p[1])):
                    code, _ = codes(run, depth)
                    code, m = np.unique(code, return_counts=True)
                    n = m if learned else np.zeros_like(m)
                    held = summed(*(np.concatenate(x) for x in zip(held, (code, n, m), strict=True)))
                    if len(held[0]) > 4 * KEEP:
                        yield rows([None] * len(held[0]), held[0].view(np.int64), *held[1:])
                        held = none
        if +words:
            yield counted(+words)
        if len(held[0]):
            yield rows([None] * len(held[0]), held[0].view(np.int64), *held[1:])

    return docs.select(common.as_bytes(text_col), "held_out").mapInArrow(run, "word binary, code long, n long, m long")


def groups(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[tuple]:
    """Columns (code, n, m) of whole groups of equal ``code >> shift``, sorted by
    code, from batches that have a group's rows together: KEEP rows or one group."""
    held, size, least = [], 0, KEEP
    for batch in batches:
        held.append([batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy()])
        size += batch.num_rows
        if size < least:
            continue
        code, *rest = map(np.concatenate, zip(*held, strict=True))
        others = np.flatnonzero((code >> np.uint64(shift)) != (code[-1] >> np.uint64(shift)))
        cut = others[-1] + 1 if len(others) else 0
        if cut:
            order = np.argsort(code[:cut])
            yield tuple(x[:cut][order] for x in (code, *rest))
        held, size = [[x[cut:] for x in (code, *rest)]], len(code) - cut
        least = max(KEEP, 2 * size)
    if size:
        code, *rest = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(code)
        yield tuple(x[order] for x in (code, *rest))


def subtrees(code: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[dict, dict]:
    """``grown`` of the depths from ``top`` for pairs of full depth; pairs that
    no training row has (n = 0) make no node."""
    pairs = {depth: (code[n > 0], n[n > 0])}
    for d in range(depth - 1, top - 1, -1):
        pairs[d] = shorter(*pairs[d + 1])
    return grown(pairs, {})


def code_lengths(pairs: DataFrame, depth: int) -> DataFrame:
    """(code, m, bits) of (code, n, m) rows: code lengths by the whole tree."""
    top = min(TOP, depth)
    shift = 8 * (depth - top + 1)
    dealt = pairs.select("code", "n", "m").repartition(F.shiftrightunsigned("code", shift)).sortWithinPartitions("code")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n, _ in groups(batches, shift):
            _, nodes = subtrees(code, n, depth, top)
            for level, (key, weighted, a, b) in nodes.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), pa.array(key.view(np.int64)), pa.array(weighted), pa.array(a), pa.array(b)], names=["level", "key", "weighted", "a", "b"])

    got = dealt.mapInArrow(roots, "level int, key long, weighted double, a long, b long").toArrow()  # 2 ** 24 rows at most
    level, key = got["level"].to_numpy(), got["key"].to_numpy().view(np.uint64)
    weighted, a, b = (got[c].to_numpy() for c in ("weighted", "a", "b"))
    nodes = {k: (key[own], weighted[own], a[own], b[own]) for k in range(8) for own in [np.flatnonzero(level == k)]}
    key, _, a, b = nodes[7]
    code, n = summed(np.concatenate([key << np.uint64(1), (key << np.uint64(1)) | np.uint64(1)]), np.concatenate([a, b]))
    above, pair = {}, (code[n > 0], n[n > 0])
    for d in range(top - 1, -1, -1):
        above[d] = pair = shorter(*pair)
    shared = pairs.sparkSession.sparkContext.broadcast(grown(above, nodes)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n, m in groups(batches, shift):
            bits = Model(depth, shared.value | subtrees(code, n, depth, top)[0]).bits(code)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(m), pa.array(bits)], names=["code", "m", "bits"])

    return common.written(dealt.mapInArrow(run, "code long, m long, bits double"), "lengths")


_models: dict = {}


def _loaded(name: str, shared) -> Model:
    """The broadcast code lengths as a table, made once in each worker process; the
    driver gives each run's table a name of its own."""
    if name not in _models:
        _models.clear()
        model = Model(0, {})
        model.fill(*shared.value)
        _models[name] = model
    return _models[name]


def far_lists(doc: list, code: list, n_docs: int) -> pa.ListArray:
    """Each document's distinct codes with their numbers, from positions."""
    doc, code = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((doc, np.int64), (code, np.uint64)))
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])) if len(doc) else np.zeros(0, int)
    n = np.diff(np.append(start, len(doc)))
    offsets = np.searchsorted(doc[start], np.arange(n_docs + 1)).astype(np.int32)
    both = pa.StructArray.from_arrays([pa.array(code[start].view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), both)


def scored(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte for each row of ``docs``.

    A null text is the empty text (its end is scored); a null id counts as the
    id ''; repeated rows are scored alike, and learned as often as they stand;
    without any training row every estimate is even (score: 8 bits a byte) and
    no token is known.  A long text is scored whole, ``CHUNK`` bytes at once; an empty
    table gives an empty one.  Extra columns are dropped.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    sums = common.written(gathered(own, "text", depth).groupBy("word", "code").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "sums")
    words = sums.where("word is not null").select("word", "n")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    lengths = code_lengths(sums.where("code is not null"), depth)
    eighth = F.floor(F.log2("m") * 8)
    classes = {r["c"]: r["k"] for r in lengths.groupBy(eighth.alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 512 at most
    least, hot = 512, 0
    while least and hot + classes.get(least - 1, 0) <= MOST:
        least -= 1
        hot += classes.get(least, 0)
    got = lengths.where(eighth >= least).toArrow()  # MOST at most
    order = np.argsort(-got["m"].to_numpy(), kind="stable")
    frequent = got["code"].to_numpy().view(np.uint64)[order], got["bits"].to_numpy()[order].astype(np.float32)
    del got
    classes = {r["c"]: r["k"] for r in words.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 64 at most
    low, hot = 64, 0
    while low and hot + classes.get(low - 1, 0) <= HOT:
        low -= 1
        hot += classes.get(low, 0)
    counts = {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= F.lit(float(2**low))).toLocalIterator()}  # HOT at most
    shared, known, name = spark.sparkContext.broadcast(frequent), spark.sparkContext.broadcast(counts), uuid.uuid4().hex
    floor = float(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        from pyspark import TaskContext

        model = _loaded(name, shared)
        logs = {w: (c, float(np.log10((c + 1) / floor))) for w, c in known.value.items()}
        key = TaskContext.get().partitionId() << 40
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            rows, words, times, ends = [], [], [], [0]
            texts = batch.column(2).to_pylist()
            bits, far = np.zeros(len(texts)), ([], [])
            flat = [(i, *p) for i, t in enumerate(texts) for p in parts(t, depth)]
            for run in chunks(flat, lambda p: len(p[2])):
                code, sizes = codes([p[1:] for p in run], depth)
                length, rest = model.known(code)
                length[rest] = 0
                np.add.at(bits, [p[0] for p in run], np.add.reduceat(length.astype(float), np.cumsum([0, *sizes])[:-1]))
                far[0].append(np.repeat([p[0] for p in run], sizes)[rest])
                far[1].append(code[rest])
            for t, b in zip(texts, bits.tolist(), strict=True):
                tokens = t.lower().split()
                tokens.append(b"")
                found = list(map(logs.get, tokens))
                rare = [w for w, f in zip(tokens, found, strict=True) if f is None]
                base = sum(f[1] for f in found if f is not None)
                rows.append({"key": key, "n_tokens": len(tokens), "hot_known": len(tokens) - len(rare), "hot_base": base, "hot_bits": b, "n_bytes": len(t) + 1})
                own = Counter(rare)
                words += own.keys()
                times += own.values()
                ends.append(len(words))
                key += 1
            new = pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("hot_known", pa.int64()), ("hot_base", pa.float64()), ("hot_bits", pa.float64()), ("n_bytes", pa.int64())]))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new.columns, listed, far_lists(*far, len(texts))], names=["doc_id", "held_out", *new.schema.names, "rare", "far"])

    schema = T.StructType([own.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, key long, n_tokens long, hot_known long, hot_base double, hot_bits double, n_bytes long, rare array<struct<word:binary,times:long>>, far array<struct<code:long,n:long>>").fields])
    table = common.written(own.select("doc_id", "held_out", common.as_bytes("text").alias("text")).mapInArrow(run, schema), "scored")
    # The other words, once per document with their number, against the counts.
    rest = table.select("key", F.inline("rare")).join(words, "word", "left").select("key", "times", F.coalesce("n", F.lit(0)).alias("n"))
    rest = rest.groupBy("key").agg(F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(floor))).alias("base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    # The other pairs likewise, against the code lengths.
    far = table.select("key", F.inline("far")).join(lengths.where(eighth < least).select("code", "bits"), "code")
    far = far.groupBy("key").agg(F.sum(F.col("n") * F.col("bits")).alias("far_bits"))
    out = table.drop("rare", "far").join(rest, "key", "left").join(far, "key", "left")
    bits = F.col("hot_bits") + F.coalesce("far_bits", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("hot_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (-bits * float(np.log10(2))).alias("score"), (bits / F.col("n_bytes")).alias("bits_per_byte")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scored(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
