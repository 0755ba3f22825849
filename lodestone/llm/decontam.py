"""Benchmark decontamination by a broadcast hash set of item n-grams.

Items and documents are reduced to lower-case words.  Every window of ``n``
consecutive item words is hashed; a document's windows are hashed by the same
rolling rule (numpy, over the whole text) and looked up in a bitmap, then in
the hash set; each hit is verified word by word.

The windows are broadcast only in blocks of some ``BLOCK`` windows and ids.  Long
items are cut into overlapping runs, equal runs stand once with their items, and
beyond one block the runs are dealt into blocks by their hash; the documents pass
the blocks one after another, each pass a narrow scan written to the shared folder:
no shuffle of documents, and memory that does not grow with the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK = 1_000_000  # windows in a broadcast: about 200 MB as Python objects at most
#: Everything but digits, letters and non-ASCII bytes separates words.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STATE = "array<struct<start:int,end:int>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Index:
    """The windows of some runs (ids, text): hash -> [(words, item ids)]."""

    def __init__(self, items: list[tuple[list[str], bytes]], n: int):
        windows: dict[tuple, set] = {}
        for own, text in items:
            w = words(text)
            size = min(n, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                windows.setdefault(tuple(w[i : i + size]), set()).update(own)
        vocabulary = sorted({x for w in windows for x in w})
        self.ids = {x: i + 1 for i, x in enumerate(vocabulary)}  # 0: any other word
        self.by: dict[int, dict[int, list]] = {}
        for w, found in windows.items():
            code = np.array([self.ids[x] for x in w], np.uint64)
            self.by.setdefault(len(w), {}).setdefault(int(_rolled(code, len(w))[0]), []).append((w, sorted(found)))
        self.bits = {}
        for size, table in self.by.items():
            width = max(16, min(26, (len(table) * 16).bit_length()))
            bitmap = np.zeros(1 << width, bool)
            bitmap[np.fromiter(table, np.uint64, len(table)) >> np.uint64(64 - width)] = True
            self.bits[size] = (np.uint64(64 - width), bitmap)

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans (end exclusive) that windows cover, and the items."""
        code = np.fromiter(map(self.ids.get, w, _zeros()), np.uint64, len(w))
        spans, items = [], set()
        for size, table in self.by.items():
            if len(w) < size:
                continue
            h = _rolled(code, size)
            shift, bitmap = self.bits[size]
            for i in np.flatnonzero(bitmap[h >> shift]).tolist():
                for window, found in table.get(int(h[i]), ()):
                    if tuple(w[i : i + size]) == window:
                        spans.append((i, i + size))
                        items.update(found)
        return merged(spans), items


def _zeros():
    while True:
        yield 0


def _rolled(code: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` codes."""
    n = len(code) - size + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * _MUL + (code[k : k + n] + np.uint64(1))
        h ^= h >> np.uint64(29)
        return h * _MUL


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _runs(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, text, windows): the items as runs of at most ``BLOCK`` / 16 windows; runs
    overlap by n - 1 words, so every window is in one."""
    most = max(BLOCK // 16, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                count = max(len(w) - n, 0) + 1 if w else 0
                for i in range(0, count, most):
                    part = w[i : i + most + n - 1]
                    yield pa.RecordBatch.from_pydict({"id": [own], "text": [b" ".join(part)], "windows": pa.array([min(most, count - i)], pa.int64())})

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), common.as_bytes(text_col).alias("text"))
    return items.mapInArrow(run, "id string, text binary, windows long")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> list[DataFrame]:
    """Tables (ids, text) of distinct runs with their items, each of some ``BLOCK``
    windows and ids.  The ids of a text that many items share are dealt into several
    rows, so that no row grows with the number of copies."""
    runs = common.written(_runs(benchmark, id_col, text_col, n).dropDuplicates(), "runs")
    n_ids = runs.count()
    deal = F.pmod(F.xxhash64("id"), F.lit(n_ids // (BLOCK // 16 or 1) + 1))
    items = common.written(runs.groupBy("text", deal.alias("part")).agg(F.collect_set("id").alias("ids"), F.first("windows").alias("windows")), "items")
    most = items.agg(F.sum(F.col("windows") + F.size("ids"))).first()[0] or 0
    k = int(2 * most // BLOCK) + 1 if most > BLOCK else 1
    if k == 1:
        return [items]
    items = common.written(items.withColumn("block", F.pmod(F.xxhash64("text", "part"), F.lit(k))), "items")
    return [items.where(F.col("block") == b).drop("block") for b in range(k)]


def spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, hits (array of word spans) and items (array of ids).

    A null text has no words; a null item text gives no windows; a null item id
    counts as the id ''; an item longer than nothing but shorter than ``n`` is
    one window; repeated items share windows and each is reported once; an
    empty benchmark or table gives no hits.  Columns of these names in ``docs``
    are replaced.
    """
    schema = T.StructType.fromDDL(f"n_words long, hits {_STATE}, items array<string>")
    out = docs
    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, item_col, item_text, n)
    for k, block in enumerate(blocks):
        rows = [(r["ids"], bytes(r["text"])) for r in block.toLocalIterator()]  # one block: bounded by BLOCK
        shared = context.broadcast(rows)

        def make(shared=shared, first=not k):
            index = Index(shared.value, n)

            def scan(values: list) -> dict:
                got: dict[str, list] = {"n_words": [], "hits": [], "items": []}
                for v in values:
                    w = words(v["text"])
                    hit, items = index.scan(w)
                    if not first:
                        hit = merged([*hit, *((x["start"], x["end"]) for x in v["hits"])])
                        items |= set(v["items"])
                    got["n_words"].append(len(w))
                    got["hits"].append([{"start": a, "end": b} for a, b in hit])
                    got["items"].append(sorted(items))
                return got

            return scan

        state = [] if not k else [F.col("hits"), F.col("items")]
        out = common.append(out, schema, F.struct(common.as_bytes(text_col).alias("text"), *state), make)
        if k < len(blocks) - 1:
            out = common.written(out, "decontam")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **how) -> DataFrame:
    """Drops contaminated documents, or with ``remove="spans"`` cuts the hit
    words (and what lies between them within a span) out of the text.

    Null and empty texts hold no window and stay; repeated rows are treated alike;
    every column passes as it is, whatever its name; empty tables stay empty.
    """
    found = spans(common.as_row(docs), benchmark, text_col=common.nested(text_col), **how)
    if remove == "documents":
        return found.where(F.size("hits") == 0).select("__row.*")

    def make():
        def cut(values: list) -> dict:
            out = []
            for v in values:
                text, hits = v["text"], v["hits"]
                if text is None or not hits:
                    out.append(text)
                    continue
                raw = text.encode()
                at = [m.span() for m in _WORD.finditer(raw)]
                parts, last = [], 0
                for h in hits:
                    parts.append(raw[last : at[h["start"]][0]])
                    last = at[h["end"] - 1][1]
                out.append(b"".join([*parts, raw[last:]]).decode())
            return {"__text": out}

        return cut

    one = T.StructType([T.StructField("__text", T.StringType())])
    left = common.append(found, one, F.struct(F.col(common.nested(text_col)).cast("string").alias("text"), "hits"), make)
    return left.select(*[F.col("__text").alias(c) if c == text_col else F.col(common.nested(c)) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans(docs, common.read(spark, sf_dir, "benchmark"))
    return digest(found.drop("text"))


SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, (len(w) - least(10, len(w)) + 2)::bigint)) as i from iw where len(w) > 0)),
sizes as (select distinct n from win),
pos as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, (len(w) - n + 2)::bigint)) as i from dw, sizes where len(w) >= n)),
hit as (select p.doc_id, p.i, p.n, w.item_id from pos p join win w on p.n = w.n and p.g = w.g),
words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from (select distinct doc_id, i, n from hit)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, coalesce(len(d.w), 0)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items, sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from dw d left join words h using (doc_id) left join items i using (doc_id)"""
