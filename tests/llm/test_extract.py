import html
import random
import re

import pytest

from textlab.llm import extract, html_tree
from textlab.llm.queries import op3_extract


def text(source, template=None):
    return extract.main_text(html_tree.parse(source), template)


@pytest.mark.parametrize("source, want", [
    ("", ""), (None, ""), ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b", "a\n\nb"), ("<p>a  <b>b\n c</b><br>d</p>", "a b c d"),
    ("<p><b>x<br><p>y", "x\n\ny"), ("<p>a &lt;b&gt; &amp;lt; &eacute;&#x41;</p>", "a <b> &lt; éA"),
    ("<nav>menu</nav><p>a</p><footer>f</footer><aside>s</aside><form>q</form>", "a"),
    ("<script>var t='</p>';</script><style>p{}</style><p>a</p><!-- <p>no</p> -->", "a"),
    ('<div class="ad top">buy</div><div class="story">a</div><div id="comments"><p>c</div>', "a"),
    ("<header>site</header><article><header><h1>t</h1></header><p>a</p><footer>x</footer></article><p>out", "t\n\na"),
    ('<div class="with-sidebar"><article><p>a</article></div>', "a"),
    ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", "x\n\ny\n\n1\n\n2\n\n3"),
    ('<p title="a>b">c</p><p class=\'x"y\'>d</p>', "c\n\nd"), ("<p>a < b > c</p>", "a < b > c"),
    ("<article><p>a</p>", "a"), ("</p></div>a</article>b", "a\n\nb"),
    ("<article>a<div class=comment>no</div></article><article class='comment'>no</article>", "a"),
    ("<main><p>m</p></main><p>out</p>", "m"),
])
def test_pages(source, want):
    assert text(source) == want


@pytest.mark.parametrize("source, want", [
    ('<article><h2 id="related-work">r</h2><section id="social-impact"><p>a</section>'
     '<div class="search-methods">b</div></article>', "r\n\na\n\nb"),
    ('<h2 id="related">r</h2><p>a', "r\n\na"), ('<div class="with-sidebar"><p>a</div>', "a"),
    ('<div class="has-menu wide"><p>a</p><div class="wide menu">no</div></div>', "a"),
    ('<ul><li><a href="/x">First source</a></ul><p><a href="/y">A linked paragraph</a></p>',
     "First source\n\nA linked paragraph"),
])
def test_names_and_links_keep_text(source, want):
    assert text(source) == want


def test_long_page():
    n = 20_000
    assert text("<article>" + "<p>word</p>" * n + "</article>").count("word") == n


def slow_match(a, i, b, j):
    """Nodes in the largest simple match of two subtrees."""
    if a.sign[i] != b.sign[j]:
        return 0
    x, y = a.children[i], b.children[j]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x)):
        for q in range(len(y)):
            best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + slow_match(a, x[p], b, y[q]))
    return best[-1][-1] + 1


def test_matching_is_largest():
    import random
    rng = random.Random(8)

    def source(depth=0):
        if depth == 3 or rng.random() < 0.3:
            return rng.choice(["<p>x</p>", "<h2>y</h2>", "<li>z</li>"])
        tag = rng.choice(["div", "section", "ul"])
        return f"<{tag}>" + "".join(source(depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(150):
        a, b = (html_tree.tree_of(html_tree.parse("".join(source() for _ in range(3)))) for _ in "ab")
        partner = html_tree.tree_match(a, b)
        assert sum(j >= 0 for j in partner) == slow_match(a, 0, b, 0)
        assert len({j for j in partner if j >= 0}) == sum(j >= 0 for j in partner)
        assert html_tree.unpack_tree(html_tree.pack_tree(a)) == a


def page(i, extra=""):
    return (f"<html><body><div class='top'>Our site</div><div class='body'><h1>T{i}</h1><p>{'text %d ' % i * 20}</p>"
            f"<p>{extra}</p></div><p>Printed on recycled paper</p></body></html>")


def test_template_of_a_host(spark):
    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(6)]
    rows += [(20, "http://b.com/", page(20)), (21, None, page(21)), (None, "http://a.com/n", page(22)),
             (23, "http://a.com/e", None), (24, "http://a.com/e", ""), (1, "http://a.com/1", page(1)),
             (25, "no url", page(25))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 AS host", "2 AS text", "3 AS pivot")
    got = extract.extract_pages(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in (23, 24):
            assert (r.text, r.n_chars) == ("", 0)
            continue
        i = 22 if r.page_id is None else r.page_id
        own = f"T{i}\n\n" + " ".join(["text %d" % i] * 20)
        outside = r.url is None or "a.com" not in r.url
        assert r.text == ("Our site\n\n" + own + "\n\nPrinted on recycled paper" if outside else own)
        assert r.n_chars == len(r.text)
    assert extract.extract_pages(df.limit(0)).count() == 0


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, f"http://a.com/{i}", page(7, "x" * (i % 2))) for i in range(8)]
    got = extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert all("T7" in r.text for r in got.collect())


def test_template_of_pages_that_are_mostly_boilerplate(spark):
    notice = "All of this stands on every page of the site. " * 20
    rows = [(i, f"http://a.com/{i}", f"<div class='top'>{notice}</div><p>Short text {i}</p><p>Imprint</p>")
            for i in range(4)]
    rows += [(9 + i, f"http://a.com/c{i}", rows[0][2]) for i in range(30)]  # copies have one vote
    got = extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in got.collect():
        assert r.text == f"Short text {r.page_id if r.page_id < 9 else 0}"


def test_each_layout_of_a_host_has_a_pivot(spark):
    def story(i):
        return f"<div class='old'><div class='hint'>Old hint</div><p>Story {i}</p></div><div class='by'>Old imprint</div>"

    def item(i):
        return f"<section><div class='lead'>New lead</div><p>Item {i}</p></section><p>New imprint</p>"

    rows = [(0, "", ""), (1, "Error 500", "<h1>Error 500</h1>")]
    rows += [(i, f"Story {i}", story(i)) for i in range(2, 8)] + [(i, f"Item {i}", item(i)) for i in range(8, 12)]
    # Two pages of a rare layout go by the main one.
    rows += [(i, f"Story {i}", "<div class='more'></div>" + story(i)) for i in (12, 13)]
    got = extract.extract_pages(spark.createDataFrame(
        [(i, f"http://a.com/{i}", source) for i, _, source in rows], "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {i: text for i, text, _ in rows}


def test_query_by_brute_force(spark, tables):
    """On pages with one article element: its blocks, cut out with regular expressions."""
    rows = {r.page_id: r.text for r in op3_extract(spark, tables).collect()}
    pages = spark.read.parquet(f"{tables}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", inner))
        assert rows[p.page_id] == "\n\n".join(b for b in blocks if b)


def quickly(seconds, run):
    import time
    start = time.perf_counter()
    out = run()
    assert time.perf_counter() - start < seconds
    return out


def tree(source):
    return html_tree.tree_of(html_tree.parse(source))


def test_deep_pages():
    source = "<div>" * 5000 + "<p>deep" + "</div>" * 5000
    other = "<div>" * 4990 + "<ul><li>x</ul><p>deep" + "</div>" * 4990
    page = html_tree.parse(source)
    assert extract.main_text(page) == "deep" and isinstance(extract.layout(page), int)
    a, b = tree(source), tree(other)
    assert quickly(10, lambda: html_tree.tree_match(a, a)) == list(range(len(a.sign)))
    partner = quickly(10, lambda: html_tree.tree_match(a, b))
    assert sum(j >= 0 for j in partner) >= 4990


def test_long_lists():
    def page(rng, n):
        items = ["<li><p>{}</p>{}</li>".format(i, "<ul><li>a</ul>" * rng.choice([0, 0, 1, 2])) for i in range(n)]
        return tree(f"<ul class=menu>{''.join(items)}</ul><div id=x><p>end</div>")

    same = tree("<ul>" + "".join(f"<li><p>{i}" for i in range(20_000)) + "</ul>")
    less = tree("<ul>" + "".join(f"<li><p>other {i}" for i in range(19_000)) + "</ul>")
    assert sum(j >= 0 for j in quickly(20, lambda: html_tree.tree_match(same, less))) == len(less.sign)
    a, b = page(random.Random(1), 4000), page(random.Random(2), 4000)
    partner = quickly(20, lambda: html_tree.tree_match(a, b))
    assert sum(j >= 0 for j in partner) > 0.8 * len(a.sign)
    for i, j in enumerate(partner):  # order and parents are kept
        if i and j >= 0:
            assert a.sign[i] == b.sign[j]
    used = [j for j in partner if j >= 0]
    assert len(set(used)) == len(used)


def test_matching_is_the_best_one():
    """Against the plain recursion on small trees."""
    def best(a, b, i=0, j=0):
        if a.sign[i] != b.sign[j]:
            return 0
        x, y = a.children[i], b.children[j]
        row = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(len(x)):
            for q in range(len(y)):
                row[p + 1][q + 1] = max(row[p][q + 1], row[p + 1][q], row[p][q] + best(a, b, x[p], y[q]))
        return 1 + row[-1][-1]

    def grow(rng, depth):
        tag = rng.choice(["div", "p", "section"])
        inner = "".join(grow(rng, depth - 1) for _ in range(rng.randint(0, 3))) if depth and tag != "p" else "t"
        return f"<{tag}>{inner}</{tag}>"

    for seed in range(120):
        rng = random.Random(seed)
        a, b = tree(grow(rng, 4)), tree(grow(rng, 4))
        partner = html_tree.tree_match(a, b)
        assert sum(j >= 0 for j in partner) == best(a, b)
        few = html_tree.tree_match(a, b, cells=0)
        assert sum(j >= 0 for j in few) <= best(a, b) and few[0] == 0


def test_long_lists_lose_no_partner():
    """Lists whose like items stand far apart, which a cut in proportion does not bring together."""
    def items(inner):
        return tree("<ul>" + "".join(f"<li>{x}</li>" for x in inner) + "</ul>")

    rng = random.Random(5)
    like = ["".join(rng.choice(["<p>x</p>", "<dl>x</dl>", "<h2>x</h2>"]) for _ in range(12)) for _ in range(60)]
    a = items(["<pre>x</pre>", *like, *["<hr>"] * 300, "<table></table>"])
    b = items(["<table></table>", *["<form></form>"] * 300, *like, "<pre>x</pre>"])
    partner = quickly(20, lambda: html_tree.tree_match(a, b))
    assert sum(j >= 0 for j in partner) >= 2 + 60 * 13
    assert partner == html_tree.tree_match(a, b, cells=10**9) == html_tree.tree_match(a, b, cells=0)


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<p class='", "<!x ", "</", "<"])
def test_broken_markup_takes_linear_time(piece):
    quickly(10, lambda: html_tree.parse(piece * 200_000))
    page = quickly(10, lambda: html_tree.parse("<p>kept</p>" + piece * 100_000))
    assert extract.main_text(page).startswith("kept")


def test_unclosed_comments():
    for source in ("<p>a</p><!-- b", "<p>a</p><!-- b > c", "<p>a</p><!-- b > <p>c"):
        assert extract.main_text(html_tree.parse(source)) == "a"
    assert extract.main_text(html_tree.parse("<p>a<!-- x --> b > <!-- y")) == "a b >"


def test_constant_headings_of_an_article_stay(spark):
    rows = [(i, f"http://h.example/{i}",
             f"<div class=top><p>Our menu</p></div><article><h1>Title {i}</h1><p>Text number {i} is here.</p>"
             f"<h2>Conclusion</h2><p>All of {i} was said.</p></article>") for i in range(5)]
    out = extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in out.collect():
        i = r["page_id"]
        assert r["text"].split("\n\n") == [
            f"Title {i}", f"Text number {i} is here.", "Conclusion", f"All of {i} was said."]


def test_given_pages_without_their_marks(spark, tables):
    """With the article element and its names gone the wrapper decides: boilerplate goes,
    most of the articles stays."""
    import re

    pages = spark.read.parquet(f"{tables}/pages.parquet").where("html IS NOT NULL")
    marked = {r["page_id"]: r["text"] for r in extract.extract_pages(pages).collect()}
    bare = pages.rdd.map(lambda r: (r["page_id"], r["url"], re.sub(
        r"(</?)(article|main)\b[^>]*", r"\1div", r["html"]))).toDF(["page_id", "url", "html"])
    found = {r["page_id"]: r["text"] for r in extract.extract_pages(bare).collect()}
    kept = total = more = 0
    for i, text in marked.items():
        want, got = text.split("\n\n"), found[i].split("\n\n")
        total += len(want)
        kept += len(set(want) & set(got))
        more += len(set(got) - set(want))
    assert kept > 0.85 * total and more < 0.35 * total
