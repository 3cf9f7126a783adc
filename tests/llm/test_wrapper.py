"""Main-text extraction: parsing, tree matching, and wrappers learned over a host's pages."""

import random

from pagemill.llm import wrapper
from tests.llm.data import prose

PAGE = "page_id long, url string, html string"


def _extract(spark, rows):
    return {r.page_id: r for r in wrapper.extract_text(spark.createDataFrame(rows, PAGE).selectExpr("*", "'x' as text", "1 as n_chars", "2 as _id")).collect()}


def _kept(html):
    return [b["text"] for b in wrapper.blocks(wrapper.parse(html), {})]


def test_boilerplate_and_markup():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body class="has-sidebar">
    <header class=site><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie notice">We use cookies</div><!-- <p>no</p> -->
    <article id='a > b'><header><h1>The &lt;Title&gt; &amp;amp; more</h1><span>By me</span></header><p>One <b>bold
      <i>text</i>,</b>&nbsp;&eacute;<br>next<p>Two<div class="ad">Buy</div><aside>Side</aside><ul><li>a<li>b &#x41;&#66;</ul>
      <form><p>Mail</p></form><div class="share-links">Share</div><section id="comments"><article class="comment"><p>First!</p></article></section>
      <table><tr><td>c1<td>c2</table>tail</article><footer>&copy; 2020</footer></body></html>"""
    assert _kept(html) == ["The <Title> &amp; more", "One bold text, é next", "Two", "a", "b AB", "c1", "c2", "tail"]


def test_truncated_and_broken_markup():
    assert _kept("<article><p>a <b>b") == ["a b"]
    assert _kept("<article><p>a</p><p title='x") == ["a"]
    assert _kept("<article><p>a</p><script>var x = 1;") == ["a"]
    assert _kept("a < b </p> c <!-- open") == ["a < b", "c"]
    assert _kept("") == [] and _kept("plain") == ["plain"]
    assert _kept("<div>" * 5000 + "deep") == ["deep"]
    assert _kept('<p class="x>y">in</p><p a="b>c</p>d') == ["in", "c", "d"]  # an open quote ends with its tag


def test_marked_article_overrules_names():
    assert _kept('<div class="promo wrap"><article><p>text</p></article></div>') == ["text"]
    assert _kept('<div class="menu">m</div><p>text</p><div><a href=x>only link</a></div>') == ["text"]


def test_pages_without_an_article_element():
    html = ("<body><div class='site-header'><h1>Shop</h1><p>slogan</p></div><div class='top-menu'><a href=1>a</a></div>"
            "<div id=content><div class='entry-header'><h1>Title</h1></div><p>First <a href=x>link</a> text here.</p><div class='cookie_notice'>ok?</div>"
            "<p>Second.</p><div class='post-comments'><p>me too</p></div></div><div class='sidebar'>x</div><div class=copyright>c</div>"
            "<div style='display: none'>h</div><p hidden>h</p><div role=search>find</div></body>")
    assert _kept(html) == ["Title", "First link text here.", "Second."]


def _brute_match(a, b):
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + _brute_match(x, y))
    return 1 + best[-1][-1]


def test_tree_matching_matches_plain_recursion():
    rng = random.Random(2)

    def grow(depth):
        n = wrapper.Node(rng.choice("ab"), "x")
        n.children = [grow(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return n

    for _ in range(200):
        a, b = grow(3), grow(3)
        b.label = a.label
        pairs = wrapper.align(a, b)
        nodes, work = {}, [a]
        while work:
            n = work.pop()
            nodes[id(n)] = n
            work += n.children
        assert len(pairs) == _brute_match(a, b)
        assert all(nodes[k].label == v.label for k, v in pairs.items()) and len({id(v) for v in pairs.values()}) == len(pairs)


def test_long_sibling_lists_align_in_bounded_time(monkeypatch):
    monkeypatch.setattr(wrapper, "CELLS", 100)
    rng = random.Random(3)
    a, b = (wrapper.parse("<article>" + "".join(rng.choice(["<p>x</p>", "<h2>y</h2>", "<ul><li>z</li></ul>"]) for _ in range(300)) + "</article>") for _ in range(2))
    pairs = wrapper.align(a, b)
    assert len(pairs) > 150 and len({id(v) for v in pairs.values()}) == len(pairs)
    assert len(wrapper.blocks(a, {})) == 300  # alignment never loses content


def test_constant_slots_are_template(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(30):
        body = [prose(rng, 12) for _ in range(rng.randint(1, 5))]
        html = "<html><body><div><p>Read our guide to everything</p></div><div class='c'>" + "".join(f"<p>{p}</p>" for p in body) + "</div><div><p>All rights kept</p></div></body></html>"
        rows.append((i, f"http://One.test/{i}", html))
        want[i] = "\n".join(body)
    copies = "<html><body><article><p>the very same text</p></article></body></html>"
    rows += [(100 + i, "https://two.test/x", copies) for i in range(40)]  # copies alone prove no template
    rows += [(200, None, copies), (201, "http://three.test", None), (202, "http://three.test", "")]
    for bound in (1 << 26, 0):
        pages = spark.createDataFrame(rows, PAGE)
        got = {r.page_id: r for r in wrapper.extract_text(pages, broadcast_bytes=bound).collect()}
        assert {i: got[i].text for i in want} == want
        assert all(got[100 + i].text == "the very same text" for i in range(40)) and got[200].text == "the very same text"
        assert (got[201].text, got[201].n_chars, got[202].text) == ("", 0, "")
        assert got[0].url == "http://One.test/0" and got[0].n_chars == len(want[0])


def test_repeats_clashing_columns_and_empty(spark):
    rows = [(1, "http://a.test/1", "<p>x</p>"), (1, "http://a.test/1", "<p>x</p>"), (None, "http://a.test/2", "<p>y</p>")]
    pages = spark.createDataFrame(rows, PAGE).selectExpr("*", "'x' as text", "1 as n_chars", "2 as _host")
    assert sorted(r.text for r in wrapper.extract_text(pages).collect()) == ["x", "x", "y"]
    assert wrapper.extract_text(pages.limit(0)).count() == 0


def test_references_by_layout(spark):
    rng, rows, want = random.Random(6), [(900, "http://h.test/e", "<html><body></body></html>"), (901, "http://h.test/f", "<html><body><p>Error</p></body></html>")], {901: "Error"}
    for i in range(40):  # two layouts, and a stub and an error page that are shorter than all of them
        body = [prose(rng, 12) for _ in range(rng.randint(1, 5))]
        text = "".join(f"<p>{p}</p>" for p in body)
        shop = f"<div class='top'><p>Welcome to the shop</p></div><div class='item'>{text}</div><div class='end'><p>Free delivery</p></div>"
        blog = f"<section class='intro'><p>A blog of ours</p></section><section class='post'>{text}</section>"
        rows.append((i, "http://h.test/", f"<html><body>{shop if i % 2 else blog}</body></html>"))
        want[i] = "\n".join(body)
    late = "<div class='top'><p>Welcome to the shop</p></div><div class='item'><p>one of a kind</p></div><div class='extra'><p>Sale</p></div>"
    rows.append((950, "http://h.test/", f"<html><body>{late}</body></html>"))  # of a rare layout
    want[950] = "one of a kind\nSale"
    got = _extract(spark, rows)
    assert got[900].text == ""
    common = {i: t for i, t in want.items() if i != 950}
    assert {i: got[i].text for i in common} == common
    assert got[950].text in (want[950], "Welcome to the shop\n" + want[950])  # with the wrapper of one layout or the other


def test_deep_elements_end_where_they_end():
    deep = "<div>" * 200 + "x" + "</div>" * 200
    assert _kept(f"<div><article>{deep}<p>rest</p></article></div><p>outside</p>") == ["x", "rest"]
    assert _kept("<div>" * 300 + "<nav>menu</nav><div class=ad>Buy</div><p>text</p>" + "</div>" * 300) == ["text"]
    a, b = (wrapper.parse("<div>" * n + "<p>x</p>" + "</div>" * n + "<p>end</p>") for n in (3000, 2990))
    ref = wrapper.decode(wrapper.encode(b))
    assert wrapper.encode(ref) == wrapper.encode(b)
    assert len(wrapper.align(a, ref)) == 2 + 1 + 2990  # the root, the last paragraph and its text, and all of b's elements


def test_comment_names_and_links_in_text():
    for names in ("post comments-open", "no-comments", "comments", "reply"):
        assert _kept(f"<article class='{names}'><p>text</p></article><p>out</p>") == ["text"]
        assert _kept(f"<article><p>text</p><article class='comment {names}'><p>me too</p></article></article>") == ["text"]
    assert _kept("<div class='no-comments'><p>text</p></div><div class='comments'><p>me too</p></div>") == ["text"]
    assert _kept("<div class='post-comments'><article><p>text</p></article></div>") == ["text"]
    assert _kept("<h2><a href=x>A headline</a></h2><p>See <a href=y>this very long description</a></p><div>a <a href=z>longer link</a></div>"
                 "<ul><li><a href=1>menu</a> 1</ul><div><a href=2>Home</a> | <a href=3>About</a></div>") == ["A headline", "See this very long description", "a longer link"]


def test_class_names_speak_as_a_whole():
    for names in ("related-work", "alert-system", "share-price", "menu-items", "social-policy", "comment-on-law"):
        assert _kept(f"<div class='{names}'><p>text</p></div><p>more</p>") == ["text", "more"], names
        assert _kept(f"<div class='x'><p class='{names}'>text</p></div>") == ["text"], names
    for names in ("ad", "ad-box", "site-footer", "cookie_notice", "top-menu", "widget-area", "related posts-wide", "newsletter-signup"):
        assert _kept(f"<div class='{names}'><p>text</p></div><p>more</p>") == ["more"], names


def test_texts_of_a_marked_article_stay():
    html = "<article><ul class='menu-items'><li>a</li></ul><p class='social'>b</p><p class='notice-text'>c</p><h2 class='banner'>d</h2><div class='ad'>e</div><nav>f</nav></article>"
    assert _kept(html) == ["a", "b", "c", "d"]
    assert _kept("<p class='social'>b</p><p>c</p>") == ["c"]


def test_hidden_is_an_attribute_not_a_word():
    assert _kept("<div data-note='is hidden here'>a</div><div title=\"hidden\">b</div><div hidden>c</div><div HIDDEN=''>d</div><div class=x hidden>e</div>") == ["a", "b"]


def test_references_and_teasers():
    assert _kept("<ul><li><a href=1>Reference one, long title</a> 1999</li><li><a href=2>Home</a> | </li></ul><p>x</p>") == ["Reference one, long title 1999", "x"]
    assert _kept("<article class='teaser'>t</article><main><article>text</article></main>") == ["text"]
    assert _kept("<div role=main><p>text</p></div><article>t</article>") == ["text"]


def test_long_lists_keep_their_anchors(monkeypatch):
    monkeypatch.setattr(wrapper, "CELLS", 100)
    texts = "".join(f"<p>{i}</p>" for i in range(300))
    a = wrapper.parse(f"<div class=top1>x</div>{texts}<div class=end1>y</div>")
    b = wrapper.parse(f"<div class=top1>x</div><h2>h</h2><div class=end1>y</div>{texts[:900]}<h3>z</h3>")
    pairs = wrapper.align(a, b)
    nodes = {id(n): n for n in a.children}
    assert {"div.top1", "div.end1"} <= {nodes[k].label for k in pairs if k in nodes}
    assert wrapper._rising([3, 1, 2, 5, 4, 6]) in ([1, 2, 4, 5], [1, 2, 3, 5]) and wrapper._rising([]) == []
