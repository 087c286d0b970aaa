"""A small DOM of block elements for pages, and simple tree matching between two of them.

Only block elements are nodes; inline markup belongs to the text around it. Text between
two block tags is one text block of the node it stands in.
"""

from __future__ import annotations

import html
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import xxhash

# Element names by their role in a page.
BLOCKS = frozenset(
    "address article aside audio blockquote body button canvas caption center dd details "
    "dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre "
    "search section select summary svg table tbody td template textarea tfoot th thead title "
    "tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
# An opening tag ends these open elements before it.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
NOT_IN_P = BLOCKS - set("audio button canvas iframe object select svg textarea video option optgroup".split())
# Elements that the search for an element to close does not leave.
SCOPE = frozenset("table td th html body article section main aside nav div ul ol dl button object".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
# Entries of the table that aligns two child lists up to which it is kept; see `tree_match`.
MATCH_CELLS = 40_000
_SHORT = 32  # up to so many columns a table is made without numpy
_TOGETHER = 64  # lists of shapes that are held before they are made one
_DIGITS = re.compile(r"[0-9]+")


@dataclass
class Page:
    """Nodes by number, parents before children; text blocks in page order."""

    tags: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)  # class, id and role of the element
    parents: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node, text


def clean(text: str) -> str:
    """Character references decoded, white space runs one space, trimmed."""
    if "&" in text:
        if text.count("&") == text.count("&amp;"):
            text = text.replace("&amp;", "&")
        else:
            text = html.unescape(text)
    return " ".join(text.split())


def parse(source: str | None) -> Page:
    """The page of an HTML text; unclosed, stray and wrongly nested tags are tolerated."""
    page = Page()
    source = source or ""
    stack: list[int] = []
    pieces: list[str] = []

    def add(tag: str, attributes: str) -> None:
        names = ""
        if attributes:
            names = " ".join(m[1].lower() + "=" + m[2].strip("\"'").lower()
                             for m in _ATTRIBUTE.finditer(attributes))
        page.tags.append(tag)
        page.names.append(names)
        page.parents.append(stack[-1] if stack else -1)
        page.children.append([])
        node = len(page.tags) - 1
        if stack:
            page.children[stack[-1]].append(node)
        stack.append(node)

    def flush() -> None:
        if pieces:
            text = clean("".join(pieces))
            pieces.clear()
            if text:
                page.blocks.append((stack[-1], text))

    def close(names: set[str] | frozenset[str], limits: frozenset[str]) -> bool:
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.tags[stack[depth]]
            if tag in names:
                del stack[depth:]
                return True
            if tag in limits:
                return False
        return False

    add("html", "")
    at, size = 0, len(source)
    # Behind the last > no tag ends, so none is looked for: each of them would be followed
    # to the end of the text. A comment that is never closed takes the rest.
    last = source.rfind(">") + 1
    while at < size:
        m = _TAG.search(source, at, last)
        if m and m[0].startswith("<!--") and not m[0].endswith("-->"):
            size = m.start()
            m = None
        elif not m and (open_end := source.find("<!--", max(at, last))) >= 0:
            size = open_end
        text = source[at : m.start() if m else size]
        if text:
            pieces.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if tag == "br":
            pieces.append(" ")
        if not ending and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if tag in BLOCKS:
                flush()
                add(tag, attributes)
                pieces.append(source[at : end.start() if end else size])
                flush()
                stack.pop()
            at = end.end() if end else size
        elif tag in BLOCKS:
            flush()
            if ending:
                close({tag}, frozenset() if tag in SCOPE else SCOPE - {tag})
            else:
                if tag in NOT_IN_P:
                    close({"p"}, SCOPE)
                if tag in CLOSES:
                    while close(CLOSES[tag], frozenset({"table", "ul", "ol", "dl", "select", "div"})):
                        pass
                if tag == "html":
                    continue
                add(tag, attributes)
                if tag in VOID or attributes.endswith("/") and tag == "svg":
                    stack.pop()
    flush()
    return page


# -- trees for matching -----------------------------------------------------

@dataclass
class Tree:
    """Signatures (element and names), children and text hashes of a page's nodes."""

    sign: list[int]
    children: list[list[int]]
    text: list[int]  # 0: no text
    size: list[int]  # characters


def without_digits(names: str) -> str:
    """Names that number their elements are alike on all pages."""
    return _DIGITS.sub("", names)


def tree_of(page: Page) -> Tree:
    sign = [xxhash.xxh32_intdigest(f"{t} {without_digits(n)}") for t, n in zip(page.tags, page.names)]
    texts: dict[int, list[str]] = {}
    for node, text in page.blocks:
        texts.setdefault(node, []).append(text)
    text, size = [0] * len(sign), [0] * len(sign)
    for node, parts in texts.items():
        text[node] = xxhash.xxh32_intdigest("\n".join(parts)) or 1
        size[node] = sum(map(len, parts))
    return Tree(sign, page.children, text, size)


def pack_tree(tree: Tree) -> bytes:
    parents = [-1] * len(tree.sign)
    for node, own in enumerate(tree.children):
        for c in own:
            parents[c] = node
    return np.array([tree.sign, parents, tree.text, tree.size], np.int64).tobytes()


def unpack_tree(data: bytes) -> Tree:
    sign, parents, text, size = np.frombuffer(data, np.int64).reshape(4, -1).tolist()
    children: list[list[int]] = [[] for _ in sign]
    for node, p in enumerate(parents):
        if p >= 0:
            children[p].append(node)
    return Tree(sign, children, text, size)


def _shapes(tree: Tree, known: dict[tuple[int, ...], int]) -> list[int]:
    """Shape of every subtree: a number in ``known`` for its signature and the shapes of its
    children, which have smaller numbers."""
    out = [0] * len(tree.sign)
    for node in range(len(tree.sign) - 1, -1, -1):
        out[node] = known.setdefault((tree.sign[node], *(out[c] for c in tree.children[node])), len(known))
    return out


def tree_match(a: Tree, b: Tree, cells: int = MATCH_CELLS) -> list[int]:
    """Simple tree matching: for every node of ``a`` its partner in ``b`` or -1.

    Roots match if their signatures are equal; the children of matched nodes are aligned
    in order so that the matched subtrees hold as many nodes as possible. Subtrees of equal
    shape at either end of two child lists are paired at once, which loses nothing, so long
    lists of like items take linear time. What is left of two lists is aligned whole, however
    long: a table of more than ``cells`` entries is not kept but made again in blocks of rows.
    Pairs of subtrees are weighed once per pair of shapes. There is no recursion, so any depth
    will do.
    """
    if not a.sign or not b.sign or a.sign[0] != b.sign[0]:
        return [-1] * len(a.sign)
    known: dict[tuple[int, ...], int] = {}
    shape_a, shape_b = _shapes(a, known), _shapes(b, known)
    kinds, sizes = list(known), []
    for kind in kinds:
        sizes.append(1 + sum(sizes[k] for k in kind[1:]))
    flat = [sizes[u] == len(kind) for u, kind in enumerate(kinds)]  # no grandchildren

    def ends(x: Sequence[int], y: Sequence[int]) -> tuple[int, int]:
        """How many shapes are equal at the beginning and at the end of two lists."""
        n, head, tail = min(len(x), len(y)), 0, 0
        while head < n and x[head] == y[head]:
            head += 1
        while tail < n - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return head, tail

    # By shape: the shapes it is weighed against in ascending order, and the weights.
    against: dict[int, array] = {}
    weights: dict[int, array] = {}

    def weight(u: int, v: int) -> int:
        if u == v:
            return sizes[u]
        return weights[u][bisect_left(against[u], v)] if kinds[u][0] == kinds[v][0] else 0

    def rows(x: Sequence[int], y: Sequence[int], row: Sequence[int]) -> Iterator[Sequence[int]]:
        """The rows of the table of two lists of shapes that follow on a given one."""
        distinct = list(set(y))
        place = {v: k for k, v in enumerate(distinct)}
        at: Sequence[int] = [place[v] for v in y]
        wide = len(y) > _SHORT
        if wide:
            at = np.array(at)
        for u in x:
            gains, last = [weight(u, v) for v in distinct], row
            if wide:
                row = np.zeros(len(y) + 1, np.int64)
                np.maximum(last[1:], last[:-1] + np.array(gains)[at], out=row[1:])
                np.maximum.accumulate(row, out=row)
            else:
                row = [0]
                for k, g in enumerate(at):
                    row.append(max(last[k + 1], row[k], last[k] + gains[g]))
            yield row

    def before(y: Sequence[int]) -> Sequence[int]:
        return np.zeros(len(y) + 1, np.int64) if len(y) > _SHORT else [0] * (len(y) + 1)

    def aligned(x: Sequence[int], y: Sequence[int]) -> Iterator[tuple[int, int]]:
        """Places that stand together in two lists of shapes, the last first."""
        whole = len(x) * len(y) <= cells
        step = max(1, len(x) if whole else math.isqrt(len(x)))
        starts = [before(y)]
        if step < len(x):
            starts += [row for p, row in enumerate(rows(x, y, starts[0]), 1) if p % step == 0]
        q = len(y)
        for low in range((len(x) - 1) // step * step, -1, -step):
            first = starts[low // step]
            best = [first, *rows(x[low : low + step], y, first)]
            p = len(best) - 1
            while p and q:
                if best[p][q] == best[p - 1][q]:
                    p -= 1
                elif best[p][q] == best[p][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    yield low + p, q

    # Pairs of shapes are found from the roots on and weighed back. Those below a shape have
    # smaller numbers, so all that a shape meets is known when its turn comes.
    met: dict[int, list[Sequence[int]]] = {shape_a[0]: [(shape_b[0],)]}
    for u in range(shape_a[0], -1, -1):
        if u not in met:
            continue
        others = sorted(set().union(*met.pop(u)) - {u})
        against[u] = array("q", others)
        for v in others:
            if flat[u] and flat[v]:
                continue  # children of one signature have one shape
            x, y = kinds[u][1:], kinds[v][1:]
            head, tail = ends(x, y)
            by_sign: dict[int, list[int]] = {}
            for w in set(y[head : len(y) - tail]):
                by_sign.setdefault(kinds[w][0], []).append(w)
            for w in set(x[head : len(x) - tail]) if by_sign else ():
                if kinds[w][0] in by_sign:
                    lists = met.setdefault(w, [])
                    lists.append(by_sign[kinds[w][0]])
                    if len(lists) > _TOGETHER:
                        lists[:] = [array("q", set().union(*lists))]
    for u in sorted(against):
        if u == shape_a[0]:
            break  # the roots are not weighed against anything
        weights[u] = array("q")
        for v in against[u]:
            x, y = kinds[u][1:], kinds[v][1:]
            head, tail = ends(x, y)
            n = 1 + sum(sizes[k] for k in x[:head]) + sum(sizes[k] for k in x[len(x) - tail :])
            x, y = x[head : len(x) - tail], y[head : len(y) - tail]
            if x and y:
                last = before(y)
                for last in rows(x, y, last):
                    pass
                n += int(last[-1])
            weights[u].append(n)

    partner = [-1] * len(a.sign)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        partner[i] = j
        x, y = a.children[i], b.children[j]
        if shape_a[i] == shape_b[j]:
            todo += zip(x, y)
            continue
        u, v = kinds[shape_a[i]][1:], kinds[shape_b[j]][1:]
        head, tail = ends(u, v)
        todo += [*zip(x[:head], y[:head]), *zip(x[len(x) - tail :], y[len(y) - tail :])]
        left = aligned(u[head : len(u) - tail], v[head : len(v) - tail])
        todo += [(x[head + p], y[head + q]) for p, q in left]
    return partner
