"""Quality rules and an isolation forest on their statistics.

Each text yields rule statistics (counts by fixed definitions, and ratios made
of them).  An isolation forest (random axis-parallel splits on small random
subsamples) scores a row by its mean path length: rows that few splits isolate
are anomalies.  The forest is fitted on a bounded sample of labelled good rows;
the threshold is calibrated over all labelled rows.

At scale: documents are scored in one narrow pass with the forest in the task's
closure (``TREES`` x 2 ``SUBSAMPLE`` nodes, whatever the input).  Calibration
reads the documents once more; their statistics, not their texts, meet the
labels, and one count per score bucket and task is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TREES, SUBSAMPLE, SAMPLE = 128, 256, 8192  # SAMPLE: labelled rows that the forest is fitted on, at most
SEED = 20240501
BUCKETS = 4096
MARGIN = 0.25  # of a statistic's range, by which cuts may lie outside a subsample
KEEP = 0.995  # of the labelled good rows, at least
MIN_WORDS, MAX_REPEAT = 10, 20  # the base rule

#: Fixed definition.
SYMBOLS = "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "dup_lines", "repeats", "word_length", "upper", "punctuation", "digits", "distinct", "line_words", "case_breaks"]
_SYMBOL = bytes(c for c in range(256) if chr(c) in SYMBOLS)
_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_MARK = b"!?;:=_~^\\/@+"
_CASE = re.compile(rb"[A-Z]{3}")


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words inside n-word windows that occur twice or more in the text."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    k = len(words) - n + 1
    size = len(ids)
    if size**n < 2**62:
        key = np.zeros(k, np.int64)
        for i in range(n):
            key = key * size + code[i : i + k]
    else:  # ranks of pairs keep the key exact
        key = code[:k]
        for i in range(1, n):
            _, key = np.unique(key * size + code[i : i + k], return_inverse=True)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    twice = np.zeros(k, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + n] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the features of a text in UTF-8."""
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOL))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else [raw] * bool(n)
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper = len(joined) - len(joined.translate(None, _UPPER))
    digits = len(joined) - len(joined.translate(None, _DIGIT))
    marks = len(joined) - len(joined.translate(None, _MARK))
    some, many = max(n, 1), max(chars, 1)
    features = [
        symbols / some, dup / max(len(lines), 1), repeat / some, chars / some, upper / many, marks / some,
        digits / many, _variety(words), min(n / max(len(lines), 1), 400.0) ** 0.5, len(_CASE.findall(joined)) / some,
    ]
    return [n, chars, symbols, dup, repeat], features


def _variety(words: list[bytes]) -> float:
    """Mean share of distinct words in runs of 100 words: free of the length."""
    runs = [words[i : i + 100] for i in range(0, max(len(words) - 50, 1), 100)]
    return sum(len(set(r)) / max(len(r), 1) for r in runs) / len(runs)


def base_failed(n: int, repeat: int) -> bool:
    return n < MIN_WORDS or 100 * repeat > MAX_REPEAT * n


# The forest: arrays over all trees' nodes.


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def fit(rows: np.ndarray, span: np.ndarray, seed: int = SEED) -> dict:
    """An isolation forest over the rows of a matrix.

    Cuts are drawn from the subsample's range widened by a share of ``span``,
    so that a statistic that is constant among the rows isolates outliers too.
    """
    rng = np.random.default_rng(seed)
    size = min(SUBSAMPLE, len(rows))
    deepest = int(np.ceil(np.log2(max(size, 2)))) + 4
    feature, cut, left, length, roots = [], [], [], [], []
    for _ in range(TREES if size else 0):
        roots.append(len(feature))
        feature.append(-1), cut.append(0.0), left.append(0), length.append(0.0)
        todo = [(len(feature) - 1, rows[rng.choice(len(rows), size, replace=False)], 0)]
        while todo:
            at, own, depth = todo.pop()
            f = int(rng.integers(rows.shape[1]))
            low, high, margin = own[:, f].min(), own[:, f].max(), MARGIN * span[f]
            if depth >= deepest or len(own) < 2 or high - low + margin <= 0:
                length[at] = depth + _path(len(own))
                continue
            c = float(rng.uniform(low - margin, high + margin))
            inside = own[:, f] < c
            feature[at], cut[at], left[at] = f, c, len(feature)
            for part in (own[inside], own[~inside]):
                feature.append(-1), cut.append(0.0), left.append(0), length.append(depth + 1.0)
                if len(part):
                    todo.append((len(feature) - 1, part, depth + 1))
    return {"feature": np.array(feature, np.int32), "cut": np.array(cut), "left": np.array(left, np.int32), "length": np.array(length), "roots": np.array(roots, np.int32), "norm": max(_path(size), 1e-9)}


def score(forest: dict, rows: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / norm): near 1 for rows that few splits isolate."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for root in forest["roots"]:
        at = np.full(len(rows), root, np.int32)
        open_ = every[forest["feature"][at] >= 0]
        while len(open_):
            node = at[open_]
            f = forest["feature"][node]
            at[open_] = forest["left"][node] + (rows[open_, f] >= forest["cut"][node])
            open_ = open_[forest["feature"][at[open_]] >= 0]
        total += forest["length"][at]
    return 2.0 ** (-total / max(len(forest["roots"]), 1) / forest["norm"])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and ``features`` (null text: no words)."""
    schema = T.StructType.fromDDL(", ".join(f"{c} long" for c in BASE) + ", features array<double>")

    def make():
        def run(values: list) -> dict:
            both = [statistics(v) for v in values]
            return {c: [b[0][i] for b in both] for i, c in enumerate(BASE)} | {"features": [b[1] for b in both]}

        return run

    return common.append(docs, schema, common.as_bytes(text_col), make)


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality: str = "quality") -> dict | None:
    """Forest and threshold from the labelled documents; none without any.

    A document that several label rows name counts as good if all call it good;
    null labels count as none.  Without labelled bad rows nothing is rejected.
    """
    by = labels.where(F.col(id_col).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.min(quality) > 0).alias("__good"))
    # The statistics first: what the join shuffles are a few numbers a row, not texts.
    own = with_statistics(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text").drop("__text")
    own = common.written(own.join(by, "__id"), "labelled")
    ok = own.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT} * n_words")
    width = len(FEATURES)
    ends = ok.agg(F.count_if("__good").alias("n"), *[f(F.col("features")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends["n"]:
        return None
    # The sample: the good rows with the smallest hashes, so reruns agree.  A bound on
    # the hash leaves some two samples' rows to sort, however many there are.
    hashed = F.xxhash64("__id", F.lit(SEED))
    share = min(1.0, 2.0 * SAMPLE / ends["n"])
    bound = F.lit(min(int((2 * share - 1) * 2**63), 2**63 - 1))
    sample = ok.where("__good").where(hashed <= bound).orderBy(hashed, "__id", "features").limit(SAMPLE).select("features").toPandas()
    if not len(sample):  # all good rows share a few ids with large hashes: deal their statistics too
        hashed = F.xxhash64("__id", "features", F.lit(SEED))
        sample = ok.where("__good").where(hashed <= bound).orderBy(hashed, "__id", "features").limit(SAMPLE).select("features").toPandas()
    if not len(sample):  # and those are few, so each stands once
        sample = ok.where("__good").select("features").distinct().orderBy("features").limit(SAMPLE).toPandas()
    span = np.array([ends[f"hi{i}"] - ends[f"lo{i}"] for i in range(width)])
    forest = fit(np.array(sample["features"].tolist()), span)

    def make():
        return lambda values: {"bucket": (np.clip(score(forest, np.array(values)), 0, 1) * (BUCKETS - 1)).astype(int).tolist()}

    one = T.StructType([T.StructField("bucket", T.IntegerType())])
    scored = common.append(ok.select("__good", "features"), one, F.col("features"), make)
    counts = scored.groupBy("bucket").agg(F.sum(F.col("__good").cast("long")).alias("good"), F.sum((~F.col("__good")).cast("long")).alias("bad"))
    table = {r["bucket"]: (r["good"], r["bad"]) for r in counts.collect()}  # BUCKETS rows at most
    good, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, (g, x) in table.items():
        good[b], bad[b] = g, x
    kept_good, kept_bad = np.cumsum(good) / max(good.sum(), 1), np.cumsum(bad) / max(bad.sum(), 1)
    if not bad.sum():
        limit = BUCKETS
    else:  # the best balance of the two rates among the cuts that keep enough
        gain = np.where(kept_good >= KEEP, kept_good - kept_bad, -1)
        limit = int(np.argmax(gain)) + 1
        # Between the classes nothing tells where the cut lies: take the middle of the gap.
        after = np.flatnonzero(good + bad > 0)
        after = after[after >= limit]
        limit = (limit + int(after[0]) + 1) // 2 if len(after) else limit
    return {"forest": forest, "limit": limit}


def judged(docs: DataFrame, fitted: dict | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, anomaly and kept.

    Null and empty texts have no words and fail the base rule; without a model
    (no labelled rows) only the base rule decides; repeated rows are judged alike;
    a long text is read whole, in time that grows with its length; extra columns
    pass, columns named like the new ones are replaced.
    """
    schema = T.StructType.fromDDL(", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, anomaly double, kept boolean")

    def make():
        def run(values: list) -> dict:
            both = [statistics(v) for v in values]
            failed = [base_failed(b[0][0], b[0][4]) for b in both]
            marks = score(fitted["forest"], np.array([b[1] for b in both])) if fitted and both else np.zeros(len(both))
            fine = (np.clip(marks, 0, 1) * (BUCKETS - 1)).astype(int) < fitted["limit"] if fitted else np.ones(len(both), bool)
            got = {c: [b[0][i] for b in both] for i, c in enumerate(BASE)}
            return got | {"base_failed": failed, "anomaly": marks.tolist(), "kept": [bool(k) and not f for k, f in zip(fine, failed, strict=True)]}

        return run

    return common.append(docs, schema, common.as_bytes(text_col), make)


def filtered(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the rules and the forest keep.

    Null and empty texts go (no words); repeated rows are judged alike; every
    column passes as it is, whatever its name; without labels only the base rule
    decides; an empty table stays empty.
    """
    out = judged(common.as_row(docs), model(docs, labels, **how), common.nested(how.get("text_col", "text")))
    return out.where("kept").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = model(docs, common.read(spark, sf_dir, "labels"))
    return judged(docs, fitted).drop("text")
