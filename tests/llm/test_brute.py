"""Results of the corpus queries and the pipeline against plain computations."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import binary, counts, mixing, pii, quality, urls

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def test_base_spans_of_personal_data(spark):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    rng, rows = random.Random(8), []
    good = "4532015112830366"
    for i in range(400):
        rows.append((i, " ".join(rng.choice([good, "4532 0151 1283 0366", "4532-0151-1283-0367", "+1 (338) 555-7198", "+12345", "1.2.3.4", "999.1.1.1", "a.b@c.de", "x", "12", "² 3", "+49.30.1234567"]) + rng.choice(["", ",", "1", "-"]) for _ in range(rng.randint(0, 5)))))
    docs = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.with_spans(docs).collect()}
    for i, t in [*rows, (900, "")]:
        spans = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        spans += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        spans += [(m.start(), 2, m.end()) for m in card.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        spans += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_spans"] == want, t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_personal_data_digests(spark):
    found = pii.query(spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    w = pii.trained()
    assert len(found) == len(texts)
    for r in found:
        base, every = pii.find(texts[r["doc_id"]] or "", w)
        assert r["base_sha256"] == hashlib.sha256(pii._joined(base).encode()).hexdigest() and r["spans"] == pii._joined(every)


def test_quality_counts():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choices(["a ", "b ", "é ", "#", "*", "<", "\n", "\t", "a b c d e f ", "\x0b"], k=rng.randint(0, 30)))
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n, chars, symbols, dup, _ = quality.statistics(t.encode())[0]
        assert (n, chars, symbols, dup) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))


def test_token_counts_without_a_trie(spark):
    pieces = counts.vocabulary(binary.public("piece_bpe_32k.model"))
    longest = max(map(len, pieces))

    def tokens(s):
        best = [(0.0, 0)]
        for end in range(1, len(s) + 1):
            n = len(s[end - 1].encode())
            top = (best[-1][0] + counts.BYTE * n, -best[-1][1] - n)
            for start in range(max(0, end - longest), end):
                p = pieces.get(s[start:end])
                if p is not None:
                    top = max(top, (best[start][0] + p, -best[start][1] - 1))
            best.append((top[0], -top[1]))
        return best[-1][1]

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    got = {r["doc_id"]: r for r in counts.query(spark, FOLDER).collect()}
    for r in rows:
        words = (r["text"] or "").split()
        assert (got[r["doc_id"]]["n_words"], got[r["doc_id"]]["n_tokens"]) == (len(words), sum(tokens(counts.MARK + w) for w in words))


def test_mined_rules_against_all_itemsets(spark):
    rng = random.Random(6)
    rows = [(f"http://{rng.choice('ab')}.net/{rng.choice('pq')}/{rng.choice('xyz')}", rng.choice(["allow", "block", "block"])) for _ in range(60)]
    got = {(tuple(r["items"]), r["verdict"]): (round(r["confidence"], 6), round(r["support"], 6)) for r in urls.mined(spark.createDataFrame(rows, "url string, verdict string"), support=0.1, confidence=0.7).collect()}
    own = [(frozenset(urls.tokens(u)), v) for u, v in rows]
    items = sorted(set().union(*(s for s, _ in own)))
    rules = {}
    for k in range(1, 9):
        for a in itertools.combinations(items, k):
            have = [v for s, v in own if set(a) <= s]
            for verdict in ("allow", "block"):
                hits = have.count(verdict)
                if hits >= 0.1 * len(own) and hits / len(have) >= 0.7:
                    rules[a, verdict] = (round(hits / len(have), 6), round(hits / len(own), 6))
    kept = {}
    for (a, v), (c, s) in rules.items():
        parts = [tuple(x for x in a if x != y) for y in a] + [(y,) for y in a]
        if len(a) == 1 or not any((p, v) in rules and rules[p, v][0] >= c for p in parts):
            kept[a, v] = (c, s)
    assert got == kept and kept
    order = sorted(kept, key=lambda r: (-kept[r][0], -kept[r][1], len(r[0]), r[0], r[1]))
    index = urls.Index([(frozenset(a), v) for a, v in order])
    for s, _ in own:
        plain = next(((v, i) for i, (a, v) in enumerate(order) if set(a) <= s), ("allow", -1))
        assert index.verdict(sorted(s)) == plain


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = {r["doc_id"] for r in quality.judged(docs.select("doc_id", "text"), quality.model(docs, labels)).where("kept").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in kept}

    def shingles(t, n=5):
        w = WORD.findall(low(t))
        return {tuple(w[i : i + min(n, len(w))]) for i in range(max(len(w) - n + 1, 1))} if w else set()

    sets, root = {i: shingles(r["text"]) for i, r in rows.items()}, {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    rows = {i: r for i, r in rows.items() if find(i) == i}
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = rule.findall(low(r["text"]))
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[min(10, len(w))].add(tuple(w[i : i + 10]))

    def hit(t):
        w = rule.findall(low(t))
        return any(tuple(w[i : i + n]) in own for n, own in windows.items() for i in range(len(w) - n + 1))

    rows = {i: r for i, r in rows.items() if not hit(r["text"])}
    db = duckdb.connect()
    db.register("documents", docs.sparkSession.createDataFrame(list(rows.values()), docs.schema).toPandas())
    taken = {i: t // s if s else 0 for i, s, t in db.sql(f"select doc_id, size, taken from ({mixing.SQL})").fetchall()}
    model, at, want = Tokenizer.from_file(binary.public()), 0, []
    for i in sorted(rows):
        ids = [*model.encode(rows[i]["text"] or "", add_special_tokens=False).ids, 2]
        for _ in range(taken[i]):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == want and len(want) > 50


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fillings_keep_no_sets_that_are_not_looked_at():
    """A room beside very many sizes: a set's further pieces are no sets of their own yet."""
    import tracemalloc

    import numpy as np

    from lodestone.llm import packing

    counts = np.ones(2049, np.int64)
    counts[1900:] = 0
    tracemalloc.start()
    found = packing.fillings(counts, 1950, width=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(1899, 51)] and peak < 60_000
