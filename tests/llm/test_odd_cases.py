"""Clashing columns, digits beyond ASCII, huge words and broken tags."""

import collections
import math
import random

import numpy as np
import pytest

from lodestone.llm import binary, common, counts, ctw, decontam, html, mixing, neardup, pii, quality, urls

CLASH = ["n_words", "hits", "items", "size", "source_size", "target", "taken", "kept", "features", "spans", "__size", "__key", "component_id", "__text", "held_out"]
HUGE = "x" * 5_000_000


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(i, f"w{i} and some more {i} words that make {i * 7} a text of its own {i * i} end of it", f"s{i % 3}", *["ORIG"] * len(CLASH)) for i in range(30)]
    rows += [(100, None, None, *[None] * len(CLASH)), (None, "mail a@b.org now", None, *["ORIG"] * len(CLASH)), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def originals(docs):
    return {r["doc_id"]: tuple(r) for r in docs.collect()}


def test_stages_keep_the_values_of_clashing_columns(spark, clash):
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    items = spark.createDataFrame([("i", clash.where("doc_id = 3").first()["text"])], "item_id string, text string")
    want = originals(clash)
    clash = clash.drop("__key")
    at = clash.columns
    for got in (quality.filtered(clash, labels), neardup.deduplicated(clash), decontam.decontaminate(clash, items), mixing.mixed_rows(clash)):
        assert got.columns == at
        rows = got.collect()
        assert rows and all(r["kept"] in ("ORIG", None) and r["size"] in ("ORIG", None) and r["text"] == want[r["doc_id"]][1] for r in rows)
    masked = {r["doc_id"]: r for r in pii.redacted(clash).collect()}
    assert masked[None]["text"] == "mail [email] now" and masked[None]["spans"] == "ORIG" and masked[100]["text"] is None
    cut = {r["doc_id"]: r for r in decontam.decontaminate(clash, items, remove="spans").collect()}
    assert cut[3]["text"].strip() == "" and cut[3]["items"] == "ORIG" and cut[4]["text"] == want[4][1]


def test_digits_beyond_ascii():
    w = pii.trained()
    for text in ("12 ² 3 4 5", "①②③④ 12.3.4.5", "１２３４５６７８９ 99", "12 ½ Ⅷ 7 7", "٣٤٥ 12 34 56"):
        base, every = pii.find(text, w)
        assert set(base) <= set(every)
    assert pii._joined(pii.find("①②③④ 12.3.4.5", w)[0]) == "ip:5:13"


def test_written_out_address_of_many_parts():
    text = "write to first.last_name [at] mail.example [dot] co [dot] uk today"
    assert pii.LONGEST >= 19 and pii.find(text, pii.trained())[0] == []


def test_segmentation_is_the_best_of_all():
    """The dynamic program against every segmentation of short texts."""
    w, rng = pii.trained(), random.Random(4)
    for _ in range(40):
        text = "".join(rng.choices(["12", "345", ".", "-", "@", "ab", " ", "(", ")"], k=rng.randint(2, 7)))
        spans = [m.span() for m in pii._TOKEN.finditer(text)]
        n = len(spans)

        def best(j):
            if j < 0:
                return 0.0
            out = [best(j - 1)]
            for i in range(j + 1):
                if pii._possible(text, spans, i, j):
                    out.append(best(i - 1) + float((w @ pii._features(text, spans, i, j)).max()))
            return max(out)

        got = 0.0
        first, last = {a: i for i, (a, _) in enumerate(spans)}, {b: i for i, (_, b) in enumerate(spans)}
        for a, b, k in pii.field_spans(text, w):
            got += float(w[k] @ pii._features(text, spans, first[a], last[b]))
        assert math.isclose(got, best(n - 1), abs_tol=1e-9)


def test_a_huge_word(spark):
    docs = spark.createDataFrame([(1, HUGE, "s"), (2, "a few words", "s")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "a few")], "item_id long, text string")
    assert {r["n_tokens"] > 0 for r in counts.counted(docs, binary.public("piece_bpe_32k.model")).select("n_tokens").collect()} == {True}
    assert sorted(r["n_words"] for r in decontam.spans(docs, items).select("n_words").collect()) == [1, 3]
    assert sorted(r["size"] for r in mixing.mix(docs).select("size").collect()) == [1, 3]
    assert sorted(r["n_spans"] for r in pii.with_spans(docs).select("n_spans").collect()) == [0, 0]
    assert sorted(r["word_chars"] for r in quality.with_statistics(docs).select("word_chars").collect()) == [9, len(HUGE)]
    assert sorted(r["n_shingles"] for r in neardup.classes(docs, n=3).collect()) == [1, 1]
    scores = {r["doc_id"]: r for r in ctw.scored(docs).collect()}
    assert scores[1]["n_tokens"] == 2 and scores[1]["score"] < 0  # crosses CHUNK twice
    tokens = binary.read(binary.write(docs, binary.public(), binary.VOCABULARY)).collect()
    assert len(tokens) == 2 and all(r["n_tokens"] > 1 for r in tokens)
    pages = spark.createDataFrame([(1, "http://a/" + HUGE[:1000000], f"<p>{HUGE}</p>")], "page_id long, url string, html string")
    assert html.extracted(pages).first()["n_chars"] == len(HUGE)
    assert urls.judged(pages.select("page_id", "url")).first()["verdict"] == "allow"


def test_long_words_are_counted_by_the_same_rule():
    pieces = {"▁a": -1.0, "ab": -1.2, "b": -2.0, "▁": -1.5, "a": -1.1, "aab": -1.3}
    rng, whole, cut = random.Random(1), counts.Trie(pieces), counts.Trie(pieces)
    for _ in range(50):
        s = "▁" + "".join(rng.choices("abc", k=rng.randint(1, 40)))
        want = whole.tokens(s)
        long = counts.LONG
        try:
            counts.LONG = 5
            assert cut.tokens(s) == want
        finally:
            counts.LONG = long


def test_broken_tags():
    def text(page):
        return " ".join(b.text for b in html.parse(page).blocks if not b.outside)

    assert text("<p title=it's>hello</p>") == "hello"
    assert text("<p>a <span class='advert'>buy <span>now</span></span> b</p>") == "a b"
    assert text("<article>x</article><article class='comment'>c</article>") == "x"
    assert text("<article><div class='entry-header'><h1>T</h1></div><div class=related-work>w</div></article>") == "T w"
    assert text("<p>a <span class=ad>x</p><p>y</p>") == "a y"
    assert text("<pre><span class=comment># c</span></pre>") == "# c"
    for page in ("<a " * 100_000 + '">', '<a x="' * 100_000, "</a " * 100_000, "<div>" * 20_000 + "</p>" * 20_000):
        html.parse(page)  # in time that grows with the page


def test_entropies_of_the_style_tree(spark):
    """Against a count by hand on a small host."""
    rng = random.Random(7)
    sources = [f"<body><div id=q><p>{rng.choice('ab')}</p>{'<h2>x</h2>' * rng.randint(0, 1)}</div><section>{i}</section></body>" for i in range(12)]
    pages = spark.createDataFrame([(i, "http://h/", s) for i, s in enumerate(sources)], "page_id long, url string, html string")
    tree = {(r["presentation"], r["content"], r["pages"]) for r in html.style_tree(pages).collect()}
    distinct = sorted(set(sources))

    def entropy(values):
        n = len(values)
        return -sum(k / n * math.log(k / n) for k in collections.Counter(values).values()) / math.log(n)

    q = entropy(["<h2>" in s for s in distinct]), entropy([s.split("<section>")[0] for s in distinct])
    assert any(n == len(distinct) and math.isclose(a, q[0], abs_tol=1e-9) and math.isclose(b, q[1], abs_tol=1e-9) for a, b, n in tree)
    assert any(n == len(distinct) and a == 0 and math.isclose(b, 1) for a, b, n in tree)  # the section


def test_long_lists_are_dealt_by_a_second_coordinate(spark):
    """Many unlike texts with a common passage, and some near copies among them."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(90)]
    rows = []
    for i in range(120):
        w = shared + [f"w{i // 2}_{k}" for k in range(14)]
        if i % 2:
            w[rng.randrange(92, 102)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: i // 2 * 2 for i in range(120)}
    refine, calls = neardup.REFINE, []
    before = neardup.Links.refined
    try:
        neardup.REFINE = 8
        neardup.Links.refined = lambda self, rows: calls.append(1) or before(self, rows)
        got = {r["doc_id"]: r["component_id"] for r in neardup.classes(docs, n=3, percent=85).collect()}
    finally:
        neardup.REFINE, neardup.Links.refined = refine, before
    assert got == want and calls


def test_large_trees_meet_their_pages_alike(spark):
    rows = [(i, f"http://h{i % 7 if i % 2 else 0}/", f"<body><div>same {i % 7 if i % 2 else 0}</div><p>text {i}</p></body>") for i in range(140)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((r["page_id"], r["text"]) for r in html.extracted(pages).collect())
    nodes, hosts = html.NODES, html.HOSTS
    try:
        html.NODES, html.HOSTS = 0, 4
        assert sorted((r["page_id"], r["text"]) for r in html.extracted(pages).collect()) == want
    finally:
        html.NODES, html.HOSTS = nodes, hosts
    assert any(t == "text 2" for _, t in want)


def test_items_of_many_copies_and_runs(spark):
    """Copies of an item and a long item, in many small blocks."""
    long = " ".join(f"w{i}" for i in range(400))
    items = spark.createDataFrame([(i, "same words in every copy of this item that is ten") for i in range(60)] + [(99, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + long + " y"), (2, "same words in every copy of this item that is ten !"), (3, "none")], "doc_id long, text string")
    block = decontam.BLOCK
    try:
        for decontam.BLOCK in (block, 64):
            got = {r["doc_id"]: r for r in decontam.digest(decontam.spans(docs, items)).collect()}
            assert (got[1]["n_hit"], got[1]["n_items"]) == (400, 1) and (got[2]["n_hit"], got[2]["n_items"]) == (11, 60) and not got[3]["contaminated"]
    finally:
        decontam.BLOCK = block


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_forest_against_paths_by_hand():
    rows = np.random.default_rng(0).normal(size=(300, 3))
    forest = quality.fit(rows, np.ones(3))
    marks = quality.score(forest, rows)

    def path(root, x):
        at = root
        while forest["feature"][at] >= 0:
            at = forest["left"][at] + int(x[forest["feature"][at]] >= forest["cut"][at])
        return forest["length"][at]

    for i in range(20):
        mean = np.mean([path(r, rows[i]) for r in forest["roots"]])
        assert math.isclose(marks[i], 2 ** (-mean / forest["norm"]))
    assert quality.score(forest, np.array([[9.0, 9.0, 9.0]]))[0] > marks.mean()


def test_a_decision_against_many_others_is_possible():
    """A byte that 2^27 others stand against, once seen and never seen, in large tables."""
    code, n = np.array([0x6161, 0x6162], np.uint64), np.array([1 << 27, 1])
    for k in (1, 2):
        model = ctw.Model(1, ctw.tree({1: (code[:k], n[:k]), 0: ctw.shorter(code[:k], n[:k])}))
        got = model.bits(np.array([0x6161, 0x6162, 0x6180, 0x6120, 0x6160], np.uint64))
        assert np.isfinite(got).all() and 0 <= got[0] < 1e-6 and (20 < got[1:]).all()
        every = (np.uint64(0x61) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((2.0 ** -model.bits(every)).sum() - 1) < 1e-5
