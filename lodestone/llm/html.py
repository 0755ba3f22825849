"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree: an element node is its path
of tags and classes from the body; its presentation styles are the different
sequences of its children over the host's pages; its contents are the different
texts below it.  The importance of a node is

    role * max(presentation entropy, content entropy)

both entropies to the base of the number of pages that have the node (a node
that looks and reads the same on every page has 0, one that always differs 1).
``role`` is 0 for what HTML itself declares as outside the main text (menus,
headers, footers, sidebars, forms, scripts, and classes of adverts, notices and
comments) and 1 otherwise.  Branches under a node of low importance are removed
from each page, in articles too.  An article mark is a prior: it multiplies the
odds of what it holds by ``PRIOR``, and divides those of the text beside it.

At scale: one narrow pass emits a row per distinct page and node (hash of the full
path, style hash, content hash), counted by host before the shuffle; the nodes
that the entropies decide on are joined back by host.  A host with few pages has
no statistics to go by: then the roles and the article mark decide.
"""

from __future__ import annotations

import functools
import html as _html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_PAGES = 5  # pages of a host with the node, from which entropies count
LIMIT = 0.3
NODES = 2_000_000  # nodes of a tree that is broadcast: 16 MB
HOSTS = 1000  # hosts of a larger one that are broadcast, at most
PRIOR = 4  # odds of an article mark
ARTICLE_LIMIT = LIMIT / (LIMIT + PRIOR * (1 - LIMIT))  # in an article: 0.1
BESIDE_LIMIT = PRIOR * LIMIT / (PRIOR * LIMIT + 1 - LIMIT)  # beside one: 0.63

#: What HTML declares or sites name as outside the main text.
OUTSIDE = set("head script style noscript template svg iframe object nav header footer aside form button select textarea dialog menu".split())
OUTSIDE_NAMES = set("ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu header masthead footer sidebar aside breadcrumb breadcrumbs cookie cookies consent notice gdpr popup modal overlay newsletter subscribe share sharing social related recommended comment comments disqus respond reply login signup search pagination pager toolbar widget copyright legal".split())
UNSURE = set("related legal notice social search share copyright comment comments login menu overlay reply signup widget".split())
NEUTRAL = set("area articles bar block body box button buttons container content form inner item items link links list main page post posts section site stories story text top bottom title wrap wrapper".split())
ARTICLES_OUTSIDE = set("ad ads advert advertisement sponsored promo comment comments comment-body reply".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
#: A tag that closes an open one of the kind when it starts.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Each alternative ends at its mark or at the end of the page, and takes no step
#: back: a quote opens a value after an equals sign only, and only if it is closed.
_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<([A-Za-z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[^>=]++)*+)(?:>|\Z)|</([A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_BARRIERS = ("ul", "ol", "dl", "table", "div", "article", "section", "main", "body")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_TOKENS = re.compile(r"[A-Za-z]+")
_SPACES = re.compile(r"\s+")


class Block:
    """A run of text between block borders, with the node it hangs from."""

    __slots__ = ("article", "node", "outside", "text")

    def __init__(self, node: int, text: str, outside: bool, article: bool):
        self.node, self.text, self.outside, self.article = node, text, outside, article


class Page:
    """The blocks of a page in order and its element nodes: parent's number, hash
    of the full path, outside, article; by path the children's names and the texts
    below (a polynomial hash with its power: texts in the page's order)."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parents, self.paths, self.outside, self.article = [0], [0], [False], [False]
        self.children: dict[int, list[str]] = {}
        self.texts: dict[int, tuple[int, int]] = {}


def _named_outside(names: list[str], in_article: bool) -> bool:
    """Whether a name says that an element is outside the main text.  A header in an
    article is its own; the words of ``UNSURE`` count only beside neutral ones
    ("related-posts", not "related-work")."""
    for n in names:
        words = set(_TOKENS.findall(n.lower()))
        found = words & OUTSIDE_NAMES
        if in_article:
            found -= {"header", "masthead"}
        if found and (found - UNSURE or words <= OUTSIDE_NAMES | NEUTRAL):
            return True
    return False


def _outside(tag: str, names: list[str], in_article: bool) -> bool:
    if tag in OUTSIDE and not (tag == "header" and in_article):
        return True
    if tag in ("article", "main"):  # a reader's comment or an advert marked up as an article
        return any(n.lower() in ARTICLES_OUTSIDE for n in names)
    return tag not in ("body", "html") and _named_outside(names, in_article)


_BASE, _PRIME = 0x1F123BB5159A55E5, 2**61 - 1


def _joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return (a[0] * b[1] + b[0]) % _PRIME, a[1] * b[1] % _PRIME


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?:[\s/][^>]*+)?(?:>|\Z)", re.I)


def parse(page: str) -> Page:
    """The blocks and nodes of a page, in time that grows with its length: every tag,
    comment and raw element is read once, and open elements are found by tag."""
    import xxhash

    out = Page()
    stack: list[list] = [["", 0, (0, 1), None]]  # tag, node, texts, the text outside an inline element
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    own: list[str] = []

    def flush() -> None:
        if own:
            text = _SPACES.sub(" ", _html.unescape("".join(own))).strip()
            own.clear()
            if text:
                _, node, texts, _ = stack[-1]
                out.blocks.append(Block(node, text, out.outside[node], out.article[node]))
                stack[-1][2] = _joined(texts, (xxhash.xxh64_intdigest(text) % _PRIME, _BASE))

    def enter(tag: str, name: str, outside: bool, around: list[str] | None) -> None:
        up = stack[-1][1]
        out.children.setdefault(out.paths[up], []).append(name)
        opened.setdefault(tag, []).append(len(stack))
        stack.append([tag, len(out.paths), (0, 1), around])
        out.parents.append(up)
        out.paths.append(xxhash.xxh64_intdigest(name, out.paths[up]))
        out.outside.append(out.outside[up] or outside)
        out.article.append(out.article[up] or tag in ("article", "main"))

    def leave(k: int) -> None:
        while len(stack) > k:
            if stack[-1][3] is not None or stack[-1][0] in BLOCKS or stack[-1][0] in OUTSIDE:
                flush()
            tag, node, texts, around = stack.pop()
            opened[tag].pop()
            if around is not None:  # the text goes on as before the inline element
                own[:] = around
            if texts[1] != 1:
                path = out.paths[node]
                out.texts[path] = _joined(out.texts.get(path, (0, 1)), texts)
                stack[-1][2] = _joined(stack[-1][2], texts)

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    at, end = 0, len(page)
    while at < end:
        m = _PARTS.search(page, at)
        if m is None:
            own.append(page[at:])
            break
        if m.start() > at:
            own.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCKS:
                flush()
                if tag in CLOSES:  # an omitted end tag
                    k = last(CLOSES[tag])
                    if k > last(_BARRIERS):
                        leave(k)
            elif tag in RAW or tag in OUTSIDE:
                flush()
            if tag in VOID or m[2].endswith("/"):
                continue
            if tag in RAW and tag != "title":
                close = _raw_end(tag).search(page, at)
                at = close.end() if close else end
                continue
            up = stack[-1][1]
            node = tag in BLOCKS or tag in OUTSIDE
            if node or "=" in m[2]:
                names = " ".join(next(filter(None, x), "") for x in _NAMES.findall(m[2])).split()
                if node:
                    outside = tag == "title" or _outside(tag, names, out.article[up])
                    enter(tag, ".".join([tag, *sorted(set(names))]), outside, None)
                elif not (opened.get("pre") or opened.get("code")) and _named_outside(names, out.article[up]):
                    around = [*own, " "]  # its text is no part of the block around it
                    own.clear()
                    enter(tag, ".".join([tag, *sorted(set(names))]), True, around)
                elif opened.get(tag) or tag == "code":
                    enter(tag, tag, False, None)
            elif opened.get(tag) or tag == "code":  # so that end tags meet their own
                enter(tag, tag, False, None)
        elif m[3]:
            tag = m[3].lower()
            if tag in BLOCKS or tag in OUTSIDE:
                flush()
            if opened.get(tag):
                leave(opened[tag][-1])
    flush()
    leave(1)
    return out


def host(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - 2**63


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, article, beside, pages, presentation, content) of each node of
    the hosts, over their different pages, without what is outside by its role.
    ``beside``: the node has text of its own and is in no article."""
    schema = T.StructType.fromDDL("nodes array<struct<path:long,style:long,content:long,article:boolean,beside:boolean>>")

    def make():
        def run(values: list) -> dict:
            out = []
            for v in values:
                page = parse(v or "")
                beside = {page.paths[b.node] for b in page.blocks if not b.article}
                # Repeated siblings are one step of a style: a list of four
                # items looks like one of five.
                style = {p: ",".join(x for x, y in zip(c, [None, *c], strict=False) if x != y) for p, c in page.children.items()}
                kinds = {p: a for p, a, o in zip(page.paths, page.article, page.outside, strict=True) if not o and p in page.texts}
                out.append([{"path": p - 2**63, "style": _hash(style.get(p, "")), "content": page.texts[p][0], "article": a, "beside": p in beside} for p, a in kinds.items()])
            return {"nodes": out}

        return run

    text = F.col(html_col).cast("string")
    own = common.append(pages.select(host(F.col(url_col)).alias("host"), F.xxhash64(text).alias("digest"), text.alias("__html")), schema, F.col("__html"), make)
    # Copies of a page say nothing about what the host's pages share.
    rows = own.select("host", "digest", "nodes").dropDuplicates(["host", "digest"]).select("host", F.inline("nodes"))
    # Counts per value first: they are summed before the shuffle.
    parts = []
    for kind in ("style", "content"):
        n = rows.groupBy("host", "path", F.col(kind).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("article").alias("article"), F.bool_or("beside").alias("beside"))
        parts.append(n.withColumn("kind", F.lit(kind)))
    counts = parts[0].unionByName(parts[1])
    total = F.sum("n")
    entropy = (F.log(total) - F.sum(F.col("n") * F.log("n")) / total) / F.log(total)
    by = counts.groupBy("host", "path", "kind").agg(total.alias("pages"), F.bool_or("article").alias("article"), F.bool_or("beside").alias("beside"), F.when(total > 1, entropy).otherwise(1.0).alias("h"))
    return by.groupBy("host", "path").agg(F.bool_or("article").alias("article"), F.bool_or("beside").alias("beside"), F.max("pages").alias("pages"), F.max(F.when(F.col("kind") == "style", F.col("h"))).alias("presentation"), F.max(F.when(F.col("kind") == "content", F.col("h"))).alias("content"))


def _with_tree(base: DataFrame, tree: DataFrame) -> DataFrame:
    """Pages with their host's nodes.  A tree of at most ``NODES`` nodes is broadcast.
    Of a larger one the hosts with many pages are (fewer than ``HOSTS`` by their bound),
    so that the html of a large host is not shuffled; other pages meet theirs by host."""
    nodes = tree.agg(F.sum(F.size("__low") + F.size("__high") + 8)).first()[0] or 0
    if nodes <= NODES:
        return base.join(F.broadcast(tree), "__host", "left")
    large = tree.where(F.col("__n") > base.count() // HOSTS)
    few = base.join(F.broadcast(large.select("__host")), "__host", "left_anti").join(tree, "__host", "left")
    return base.join(F.broadcast(large), "__host").unionByName(few)


def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars.

    Null and empty html give the empty text; pages of a null url or one without
    a host form the tree of the host ''; copies of a page count once in the
    entropies; a page of any length, broken tags too, takes time that grows with its
    length; an empty table gives an empty one; columns of these names in ``pages``
    are replaced.
    """
    importance = F.greatest("presentation", "content")
    low = importance < F.when(F.col("article"), ARTICLE_LIMIT).otherwise(LIMIT)
    high = F.col("beside") & (importance >= BESIDE_LIMIT)
    tree = style_tree(pages, url_col, html_col).where(F.col("pages") >= MIN_PAGES).where(low | high)
    tree = common.written(tree.groupBy(F.col("host").alias("__host")).agg(F.max("pages").alias("__n"), F.sort_array(F.collect_set(F.when(low, F.col("path")))).alias("__low"), F.sort_array(F.collect_set(F.when(high, F.col("path")))).alias("__high")), "styles")
    base = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")])
    base = _with_tree(base.withColumn("__host", host(F.col(url_col))), tree).drop("__host", "__n")
    schema = T.StructType.fromDDL("text string, n_chars long")

    def make():
        def run(values: list) -> dict:
            out = []
            for v in values:
                page = parse(v["html"] or "")
                drop, keep = set(v["low"] or ()), set(v["high"] or ())
                gone = [False]  # by node: it or a node above is of low importance
                for up, path in zip(page.parents[1:], page.paths[1:], strict=True):
                    gone.append(gone[up] or path - 2**63 in drop)
                # Text beside a page's article needs the entropies' word.
                marked = any(b.article and not b.outside for b in page.blocks)
                kept = []
                for b in page.blocks:
                    if b.outside or gone[b.node] or (marked and not b.article and page.paths[b.node] - 2**63 not in keep):
                        continue
                    kept.append(b.text)
                out.append(" ".join(kept))
            return {"text": out, "n_chars": list(map(len, out))}

        return run

    value = F.struct(F.col(html_col).cast("string").alias("html"), F.col("__low").alias("low"), F.col("__high").alias("high"))
    return common.append(base, schema, value, make).drop("__low", "__high")


def query(spark, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", "n_chars")
