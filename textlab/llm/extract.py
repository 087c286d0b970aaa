"""Main text of HTML pages by wrapper induction over pages of one host.

Pages of a host with the same containers share a layout. Each layout has a pivot page, and
every page is aligned by simple tree matching with the pivot of its layout, or of the host's
most frequent one if its own is too rare; for each pivot node the pages that have a partner, and those whose
partner has the same text, are counted over all pages with distinct text. Nodes that are almost always the
same become template, the others are slots that vary with the page. A page's text is what
stands in its slots, less the elements whose role is known from their name: menus, headers,
footers, adverts, forms, comments and the like; if the page marks its article, only that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textlab.llm.common import bounded_batches
from textlab.llm.html_tree import (
    Page, Tree, pack_tree, parse, tree_match, tree_of, unpack_tree, without_digits,
)
from textlab.llm.urls import host_and_path
from textlab.sources.storage import materialize

# A node is template if at least this share of at least so many pages has its text.
SAME_SHARE = 0.8
MIN_PAGES = 3
# Wrappers are broadcast up to this many bytes in total, else joined by host.
BROADCAST_BYTES = 16 << 20
_COUNTED_NODES = 200_000
# Elements that make up a layout, and how deep.
CONTAINERS = frozenset("article aside body div footer form header html main nav section".split())
LAYOUT_DEPTH = 4

# Elements that are never part of an article.
DROP_TAGS = frozenset(
    "aside audio button canvas dialog footer form head iframe menu nav noscript object search "
    "select svg template textarea title video".split())
# Whole classes, ids or roles that name such parts.
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs "
    "comment comments commentlist complementary consent contentinfo cookie cookies disqus footer "
    "login masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted recommended related replies reply search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ATTRIBUTE = re.compile(r"^(?:class|id|role)=")


def _named_drop(tag: str, names: str) -> bool:
    """A whole class, id or role names such a part; parts of slugs and headings do not."""
    return tag not in HEADINGS and any(_ATTRIBUTE.sub("", w) in DROP_NAMES for w in names.split())


def main_text(page: Page, template: list[bool] | None = None) -> str:
    """Text blocks of the article, joined by an empty line. ``template`` marks nodes whose
    text belongs to the wrapper."""
    n = len(page.tags)
    regions = _regions(page)
    around = set()
    for r in regions:
        while r >= 0:
            around.add(r)
            r = page.parents[r]
    drop, inside = [False] * n, [False] * n
    for i in range(n):
        p = page.parents[i]
        inside[i] = i in regions or (p >= 0 and inside[p])
        drop[i] = (p >= 0 and drop[p]) or page.tags[i] in DROP_TAGS
        if not drop[i] and i not in around and page.tags[i] not in ("html", "body"):
            drop[i] = _named_drop(page.tags[i], page.names[i]) or (page.tags[i] == "header" and not inside[i])
    blocks = [(i, text) for i, text in page.blocks
              if not drop[i] and (inside[i] or not regions)]
    if template:
        # What stands in a marked article belongs to it, however often it recurs.
        left = [(i, t) for i, t in blocks if inside[i] or not template[i]]
        blocks = left or blocks  # a page must not be all template
    return "\n\n".join(t for _, t in blocks)


def _regions(page: Page) -> set[int]:
    """Nodes marked as the article: the outermost ``article`` elements, else ``main``."""
    found: dict[str, list[int]] = {"article": [], "main": []}
    held = [False] * len(page.tags)
    within: dict[str, list[bool]] = {k: [False] * len(page.tags) for k in found}
    for i, tag in enumerate(page.tags):
        p = page.parents[i]
        held[i] = (p >= 0 and held[p]) or tag in DROP_TAGS or (
            tag == "article" and _named_drop(tag, page.names[i]))
        for k in found:
            within[k][i] = tag == k or (p >= 0 and within[k][p])
            if tag == k and not held[i] and not (p >= 0 and within[k][p]):
                found[k].append(i)
    return set(found["article"] or found["main"])


def compare(tree: Tree, pivot: Tree) -> tuple[list[int], list[bool]]:
    """Partners of the nodes of a page in the pivot and whether their texts are equal."""
    partner = tree_match(tree, pivot)
    return partner, [j >= 0 and tree.text[i] == pivot.text[j] for i, j in enumerate(partner)]


def layout(page: Page) -> int:
    """Digest of the distinct paths of containers, whatever their number: pages of one kind
    agree in it. Digits in names do not count."""
    paths: list[tuple[str, ...]] = []
    for tag, names, p in zip(page.tags, page.names, page.parents):
        above = paths[p] if p >= 0 else ()
        inner = tag in CONTAINERS and len(above) <= LAYOUT_DEPTH and (p < 0 or above)
        paths.append((*above, f"{tag} {without_digits(names)}") if inner else ())
    lines = sorted({"/".join(path) for path in paths})
    return xxhash.xxh64_intdigest("\n".join(lines).encode("utf-8", "surrogatepass")) - (1 << 63)


@F.pandas_udf(LongType())
def _layouts(sources: pd.Series) -> pd.Series:
    return sources.map(lambda x: layout(parse(x))).astype("int64")


@lru_cache(256)
def _tree(data: bytes) -> Tree:
    return unpack_tree(data)


def _trees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed trees of the pages that have text, and a digest of all text of the page."""
    for frame in frames:
        rows = []
        for host, source in zip(frame["host"], frame["html"]):
            page = parse(source)
            if page.blocks:
                text = "\n".join(t for _, t in page.blocks).encode("utf-8", "surrogatepass")
                rows.append((host, layout(page), xxhash.xxh3_128_digest(text), pack_tree(tree_of(page))))
        yield pd.DataFrame(rows, columns=["host", "layout", "text", "tree"])


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per pivot and its nodes: pages with a partner for it, and with the same text."""
    counts: dict[tuple[str, int, int], list[int]] = {}

    def out() -> pd.DataFrame:
        rows = [(*key, *c) for key, c in counts.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["host", "layout", "node", "seen", "same"])

    for frame in frames:
        for host, kind, tree, pivot in zip(frame["host"], frame["wrapper"], frame["tree"], frame["pivot"]):
            pivot = _tree(pivot)
            for j, same in zip(*compare(unpack_tree(tree), pivot)):
                if j >= 0 and pivot.text[j]:
                    c = counts.setdefault((host, kind, j), [0, 0])
                    c[0] += 1
                    c[1] += same
        if len(counts) > _COUNTED_NODES:
            yield out()
    yield out()


def _attach(pages: DataFrame, wrappers: DataFrame, n_bytes: int) -> DataFrame:
    """``pages`` with ``wrapper`` (its layout), ``pivot`` and ``template`` of the wrapper of
    their layout, else of their host's main one, else null."""
    all_of = F.struct(F.col("layout").alias("wrapper"), "pivot", "template")
    own = wrappers.select("host", "layout", all_of.alias("_own"))
    main = wrappers.where("main").select("host", all_of.alias("_main"))
    if n_bytes <= BROADCAST_BYTES:
        own, main = F.broadcast(own), F.broadcast(main)
    return pages.join(own, ["host", "layout"], "left").join(main, "host", "left").select(
        *pages.columns, F.coalesce("_own", "_main").alias("_w")).select(*pages.columns, "_w.*")


def induce(pages: DataFrame) -> tuple[DataFrame, int]:
    """``host, layout, main, pivot, template``: the packed tree of each pivot and its
    template nodes; and the size of all of it in bytes. A host has one main layout, that of
    most texts. Pages come with ``host`` and ``html``."""
    some = pages.where("host <> '' AND html IS NOT NULL").select("host", "html")
    # Pages with the same text have one vote together.
    trees = materialize(
        some.mapInPandas(_trees, "host string, layout long, text binary, tree binary")
        .groupBy("host", "layout", "text").agg(F.min("tree").alias("tree")), "wrapper_trees")
    layouts = materialize(trees.groupBy("host", "layout").agg(
        F.count(F.lit(1)).alias("pages"), F.min(F.struct("text", "tree")).alias("first")
    ).select("host", "layout", "pages", F.col("first.tree").alias("pivot")), "wrapper_layouts")
    top = layouts.groupBy("host").agg(F.max(F.struct("pages", "layout")).alias("top"))
    pivots = layouts.join(top.select("host", "top.layout", F.lit(True).alias("main")), ["host", "layout"], "left")
    pivots = materialize(
        pivots.where(F.col("main") | (F.col("pages") >= MIN_PAGES))
        .select("host", "layout", F.coalesce("main", F.lit(False)).alias("main"), "pivot"), "wrapper_pivots")
    n_bytes = pivots.agg(F.sum(F.length("pivot") + F.length("host"))).first()[0] or 0
    untaught = pivots.withColumn("template", F.lit(None).cast("array<int>"))
    counts = _attach(trees.select("host", "layout", "tree"), untaught, n_bytes).select(
        "host", "wrapper", "tree", "pivot").mapInPandas(
        _count, "host string, layout long, node int, seen long, same long")
    total = counts.groupBy("host", "layout", "node").agg(
        F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    constant = total.where((F.col("seen") >= MIN_PAGES) & (F.col("same") >= SAME_SHARE * F.col("seen")))
    template = constant.groupBy("host", "layout").agg(F.array_sort(F.collect_list("node")).alias("template"))
    return materialize(pivots.join(template, ["host", "layout"], "left"), "wrappers"), n_bytes


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = [_text(s, p, t) for s, p, t in zip(frame["html"], frame["pivot"], frame["template"])]
        out = frame.drop(columns=["html", "pivot", "template"])
        yield out.assign(text=texts, n_chars=[len(t) for t in texts])


def _text(source: str | None, pivot: bytes | None, template) -> str:
    page = parse(source)
    if pivot is None or template is None or not len(template):
        return main_text(page)
    constant = set(template)
    return main_text(page, [
        j in constant and same for j, same in zip(*compare(tree_of(page), _tree(pivot)))])


def extract_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page.

    ``text`` holds the blocks of the article in page order, joined by two line feeds, with
    character references decoded and white space runs inside a block as one space. It is
    empty for null or empty html. Pages without a host have no wrapper and are judged by
    element names alone. Repeated rows give equal rows;
    further columns are left out.
    """
    bounded_batches(pages.sparkSession)
    host = host_and_path(F.col(url))[0]
    named = pages.select(host.alias("host"), F.col(page_id).alias("page_id"),
                         F.col(url).alias("url"), F.col(html).alias("html"))
    wrappers, n_bytes = induce(named)
    id_type = named.schema["page_id"].dataType.simpleString()
    named = named.withColumn("layout", _layouts("html"))
    return _attach(named, wrappers, n_bytes).drop("host", "layout", "wrapper").mapInPandas(
        _extract, f"page_id {id_type}, url string, text string, n_chars long")
