"""E0-E10, T1-T3 on catalogue page fixtures."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagemill.operators import extract as X
from pagemill.operators import items as I
from pagemill.plans.traverse import chain_page_count, follow_next
from pagemill.sources import driver as D

from .fixtures import BASE, PAGES_SCHEMA, catalogue_pages


def pages_df(spark, rows):
    return spark.createDataFrame(rows, PAGES_SCHEMA)


def test_catalogue_three_pages_sixty_items(spark):
    pages = pages_df(spark, catalogue_pages(3))
    items = X.extract_items(pages)
    assert items.count() == 60
    b1 = items.filter(F.col("url") == f"{BASE}catalogue/book-1/index.html").first()
    assert (b1["title"], b1["rating"], b1["availability"]) == ("Book 1", "Two", "In stock")
    assert b1["price"] == "£1.00" and b1["image_url"] == f"{BASE}media/cache/book-1.jpg"
    prepared = I.prepare_items(X.extracted_raw_items(pages))
    p1 = prepared.filter(F.col("title") == "Book 1").first()
    assert (p1["price"], p1["price_numeric"], p1["rating_numeric"]) == ("1.00", 1.0, 2)
    # document order inside a page
    firsts = [r["title"] for r in items.filter("page_id = 2").orderBy("item_pos").limit(3).collect()]
    assert firsts == ["Book 21", "Book 22", "Book 23"]


ODD = """<html><body>
<article class="product_pod"><h3><a href="a.html" title="  ">x</a></h3></article>
<article class="product_pod"><h3><a title="No link">x</a></h3></article>
<article class="extra product_pod"><h3><a href="../media/b.html" title="Swapped &amp; Co"></a></h3>
  <p class="Three star-rating">x</p><p class="availability">  Only basic </p>
  <p class="price_color">&pound;2<b>.50</b></p><img src="//cdn.test/i.png"></article>
<article class="product_pod"><h3><a href='http://abs.test/x' title='Abs'></a></h3>
  <p class="star-rating">x</p><p class="availability instock">In</p><p class="availability">Out</p><br>
</article>
</body></html>"""


def test_extraction_edge_cases(spark):
    pages = pages_df(spark, [(1, "http://example.test/cat/index.html", ODD, None)])
    got = {r["title"]: r for r in X.extract_items(pages).collect()}
    assert set(got) == {"Swapped & Co", "Abs"}  # blank title and missing link dropped (F4)
    s = got["Swapped & Co"]
    assert s["url"] == "http://example.test/media/b.html"
    assert s["rating"] == "star-rating"  # second token of the class attribute, as written
    assert s["availability"] == "Only basic" and s["price"] == "£2.50"
    assert s["image_url"] == "http://cdn.test/i.png"
    a = got["Abs"]
    assert a["url"] == "http://abs.test/x" and a["rating"] == "" and a["availability"] == "In"
    assert a["image_url"] == ""


def test_next_links_and_follow(spark):
    pages = pages_df(spark, catalogue_pages(3))
    nl = X.next_links(pages)
    assert sorted(r["next_url"] for r in nl.collect()) == [f"{BASE}page-2.html", f"{BASE}page-3.html"]
    links = nl.select("url", "next_url")
    seeds = spark.createDataFrame([(BASE,)], "url string")
    chain = follow_next(links, seeds, 3).orderBy("hop").collect()
    assert [(r["hop"], r["url"]) for r in chain] == [(1, BASE), (2, f"{BASE}page-2.html"), (3, f"{BASE}page-3.html")]
    counts = chain_page_count(nl, follow_next(links, seeds, 3)).first()
    assert (counts["page_count"], counts["pages_visited"]) == (2, 3)
    # the cap: at most max_pages pages per chain
    assert follow_next(links, seeds, 2).count() == 2


def test_follow_cycle_ends(spark):
    """Every page links to page-2: the chain visits 2 pages and stops."""
    links = spark.createDataFrame([(BASE, f"{BASE}page-2.html"), (f"{BASE}page-2.html", f"{BASE}page-2.html")],
                                  "url string, next_url string")
    seeds = spark.createDataFrame([(BASE,)], "url string")
    assert follow_next(links, seeds, 50).count() == 2


def test_links_descendant(spark):
    html = '<ul><li><a href="/a">A</a><a href="b">B</a></li><li class="next"><a href="c.html">n</a></li></ul><a href="/no">'
    pages = pages_df(spark, [(1, "http://h.test/x/y.html", html, None)])
    got = [r["abs_url"] for r in X.links(pages, "li a").orderBy("link_pos").collect()]
    assert got == ["http://h.test/a", "http://h.test/x/b", "http://h.test/x/c.html"]


def test_descendant_first_match_in_document_order(spark):
    html = ('<article class="product_pod"><h3>no link here</h3><h3><a href="x.html" title="Second h3">t</a></h3>'
            '<p class="price_color">1</p><p class="star-rating One"></p></article>')
    pages = pages_df(spark, [(1, "http://h.test/", html, None)])
    got = [(r["title"], r["url"]) for r in X.extract_items(pages).collect()]
    assert got == [("Second h3", "http://h.test/x.html")]


def item_rows(spark, html):
    pages = pages_df(spark, [(1, "http://h.test/d/", html, None)])
    return sorted((r["title"], r["url"], r["price"]) for r in X.extract_items(pages).collect())


def test_angle_bracket_in_attribute_bare_attributes_and_comments(spark):
    html = ('<article class="product_pod"><h3><a title="5 > 3" href="b/1.html">x</a></h3><p class="price_color">1</p></article>'
            "<article class=product_pod><h3><a href=b/2.html title=Bare>x</a></h3></article>"
            '<!-- <article class="product_pod"><h3><a title="no" href="n">x</a></h3></article> -->'
            '<script>"<article class=product_pod><h3><a title=s href=s>"</script>'
            '<article data-x="class=product_pod"><h3><a title="other" href="o">x</a></h3></article>'
            '<article class="product_pod"><h3><a data-t=" title=wrong" title="right" href="b/3.html">x</a></h3></article>')
    assert item_rows(spark, html) == [("5 > 3", "http://h.test/d/b/1.html", "1"), ("Bare", "http://h.test/d/b/2.html", ""),
                                      ("right", "http://h.test/d/b/3.html", "")]


def test_nested_and_open_elements(spark):
    html = ('<article class="product_pod"><article class="note">n</article><h3><a title="A" href="a">x</a></h3></article>'
            '<article><article class="product_pod"><h3><a title="B" href="b">x</a></h3></article></article>'
            '<article class="product_pod"><h3><a title="Open" href="c">x</a></h3>')
    assert [r[0] for r in item_rows(spark, html)] == ["A", "B", "Open"]
    lists = ('<ul><li><a href="1">x</a><ul><li><a href="2">y</a></li></ul><a href="3">z</a></li></ul>'
             '<ol><li><a href="4">w</a></li></ol><ul><li class="next"><b><a href="5">n</a></b></li></ul>')
    pages = pages_df(spark, [(1, "http://h.test/", lists, None)])
    assert [r["href"] for r in X.links(pages, "li a").orderBy("link_pos").collect()] == ["1", "2", "3", "4", "5"]
    assert [r["href"] for r in X.links(pages, "ul li a").orderBy("link_pos").collect()] == ["1", "2", "3", "5"]
    assert [r["href"] for r in X.links(pages, "ul li.next a").orderBy("link_pos").collect()] == ["5"]


def test_huge_page_ids_keep_document_order(spark):
    html = '<article class="product_pod"><h3><a title="{}" href="same">x</a></h3><p class="price_color">1</p><p class="star-rating One"></p></article>'
    big = 9_200_000_000_000_000_000
    pages = pages_df(spark, [(big, "http://h.test/", html.format("first") + html.format("second"), None),
                             (big + 1, "http://h.test/x", html.format("third"), None)])
    assert [r["title"] for r in I.prepare_items(X.extracted_raw_items(pages)).collect()] == ["first"]


def _outer(spark, html, css="li"):
    from pyspark.sql import functions as F

    from pagemill.operators import extract as X
    df = spark.createDataFrame([(html,)], "html string")
    return df.select(X.elements(X.markup_of("html"), X.Selector.parse(css)).alias("e")).first()["e"]


def test_elements_match_like_brackets(spark):
    assert _outer(spark, "<article class=a>1</article            ><article class=a>2</article\n>", "article.a") == ["<article class=a>1", "<article class=a>2"]
    assert _outer(spark, "<li class=x>a<li>b</li>c</li>d<li class=x>e", "li.x") == ["<li class=x>a<li>b</li>c", "<li class=x>e"]
    assert _outer(spark, "</li><li>a</li></li><LI>b</LI >tail") == ["<li>a", "<LI>b"]
    assert _outer(spark, "<ul><li><ul><li class=x>in</li></ul></li><li class=x>out</li></ul>", "li.x") == ["<li class=x>in", "<li class=x>out"]
    assert _outer(spark, "<link><listing><li/>a</li>") == ["<li/>a"] and _outer(spark, "") == [] and _outer(spark, "<li") == []


def test_long_and_nested_lists_are_linear(spark):
    """Many elements, and many inside one: no part of the work grows with their square."""
    import time
    flat = "".join(f"<li>{i}</li>" for i in range(40_000))
    got = _outer(spark, flat)
    assert len(got) == 40_000 and got[0] == "<li>0" and got[-1] == "<li>39999"
    pages = ["<li class=x>" + "<li>" * n + "deep" + "</li>" * n + "</li>" for n in (4_000, 32_000)]
    _outer(spark, pages[0], "li.x")
    spent = []
    for p in pages:
        began = time.time()
        assert _outer(spark, p, "li.x") == [p[:-len("</li>")]]
        spent.append(time.time() - began)
    assert spent[1] < 30 * max(spent[0], 0.2)  # eight times as long; a square would be 64 times


def test_malformed_references_resolve_to_nothing(spark):
    from pagemill.functions.urls import absolute_url
    base = "http://h.test/a/b"
    cases = {"%zz": "", "a%2": "", "http://[::1/x": "", "http://h]x/": "", "http://h:8a/": "", "http://a b/": "", "1:2": "", ":x": "", "a\x7fb": "", "x\ny": "",
             "#%zz": "", "p#%zz": "", "http://u:p@h:80/": "http://u:p@h:80/", "http://[fe80::1%25en0]:80/x": "http://[fe80::1%25en0]:80/x",
             "?q=%zz": "http://h.test/a/b?q=%zz", "./1:2": "http://h.test/a/1:2", "/x:y": "http://h.test/x:y", "%41": "http://h.test/a/%41",
             "http://é.test/ü": "http://é.test/ü", "javascript:void(0)": "javascript:void(0)", "a b": "http://h.test/a/a b"}
    df = spark.createDataFrame([(base, r) for r in cases], "b string, r string")
    assert {r.r: r.u for r in df.select("r", absolute_url("b", "r").alias("u")).collect()} == cases


def test_flat_elements_are_cut_where_pieces_are(spark):
    """Elements that do not nest, found by one expression, are those of the pieces between their tags, in odd markup too."""
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<P class='c'>", '<p class="b c">', "<p\nclass=c >", '<p title="<p >" class="c">', "<p title='a > b' class=c>", "<p class=\"c",
            "<pre class='c'>", "<p/", "< p>", "text", '"', "'", ">", "<b>x</b>", "&amp;", "<a class='c' href=x>", "</a>", ""]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(12))),) for _ in range(400)] + [(None,)]
    df = spark.createDataFrame(rows, "m string")
    for css in ("p.c", "p", "a.c"):
        sel = X.Selector.parse(css)
        pieces = F.transform(X.elements(F.col("m"), sel), lambda e: X._inner(e, sel))
        assert df.filter(~X.inner_elements(F.col("m"), sel).eqNullSafe(pieces)).collect() == []


def test_catalogue_gathers_lines_not_markup(spark, tmp_dir):
    """The exchange of the catalogue's lines carries no markup."""
    spark.sql("select 7L l_orderkey, 2 l_linenumber, 6L l_partkey, 3L l_suppkey, 1.5d l_extendedprice, 'R' l_returnflag, date'1997-01-01' l_shipdate "
              "union all select 7L, 1, 37L, 3L, 2d, null, date'1996-01-01'").write.parquet(f"{tmp_dir}/lineitem.parquet")
    pages = D.catalogue_pages(spark, tmp_dir)
    row = pages.first()
    assert row.html.index("37") < row.html.index("7-2") and row.html.count("product_pod") == 2 and str(row.fetched_at)[:10] == "1996-01-01"
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "product_pod" not in plan[plan.index("Exchange"):]


def test_page_url_is_taken_apart_once_a_page(spark):
    """What a URL is resolved against is computed below the explode, and the tag of title and link is looked for once."""
    pages = pages_df(spark, catalogue_pages(1))
    plan = X.extract_items(pages)._jdf.queryExecution().executedPlan().toString()
    above, below = plan[:plan.index("posexplode")], plan[plan.index("posexplode"):]
    parts = "^((?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?)"  # scheme and authority of the base
    assert parts not in above and parts in below
    assert above.count("(?is)(<(?:a)(?=") == 1


def test_nested_elements_by_one_expression_are_those_of_brackets(spark):
    rng = random.Random(5)
    bits = ["<li>", "</li>", "<LI class='x'>", '<li class="y x">', "</li >", "<li title='<li >' class=x>", "<li class=\"x", "<link>", "<li/", "text", '"', "'", ">", "<b>x</b>"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(16))),) for _ in range(600)] + [(None,), ("<li class=x>" * 4 + "</li>" * 4,)]
    df = spark.createDataFrame(rows, "m string")
    for css in ("li.x", "li"):
        sel = X.Selector.parse(css)
        pieces = F.transform(X.elements(F.col("m"), sel), lambda e: X._inner(e, sel))
        assert df.filter(~X.inner_elements(F.col("m"), sel).eqNullSafe(pieces)).collect() == []


def test_attribute_values_keep_their_order_of_preference(spark):
    tags = {"<a t='s' t=\"d\">": "d", "<a t=\"\" t='s'>": "s", "<a t='' t=b>": "b", "<a t=\"\" t=\"d\">": "", "<a x=\" t=no\" t=b>": "b", "<a T = 'q\"q'>": "q\"q", "<a>": "", "": ""}
    df = spark.createDataFrame([(t,) for t in tags], "m string")
    assert {r.m: r.v for r in df.select("m", X.child_attr(F.col("m"), "a", "t").alias("v")).collect()} == tags


def test_references_of_every_kind_in_one_pass(spark):
    from pagemill.functions import text as T
    cases = {"&amp;lt;&#38;lt;": "&lt;&lt;", "&#x000A3;1": "£1", "&#0;": "�", "&#xD800;": "�", "&#x80;": "€", "&#255;&#127;": "ÿ\x7f", "&#12A;": "&#12A;",
             "&#x;&;&": "&#x;&;&", "a&b;c": "a&b;c", "&lt": "&lt", "&#x1F600;é&Eacute;": "😀éÉ", "&#99999999;": "�"}
    df = spark.createDataFrame([(t,) for t in cases], "m string")
    assert {r.m: r.v for r in df.select("m", T.decode_entities("m").alias("v")).collect()} == cases


def test_one_step_back_resolves_like_the_fold(spark):
    from pagemill.functions.urls import absolute_url, base_parts, resolve
    cases = {"../x": "http://h.test/x", "../../x": "http://h.test/x", "a/../x": "http://h.test/d/x", "/a//../x": "http://h.test/a/x", "/../x": "http://h.test/x",
             "/a/./../x": "http://h.test/x", "a/..": "http://h.test/d/", "../.x/..y": "http://h.test/.x/..y", "/a/b/../../c/../x": "http://h.test/x"}
    df = spark.createDataFrame([("http://h.test/d/p", r) for r in cases], "b string, r string")
    got = df.select("r", absolute_url("b", "r").alias("u"), resolve(base_parts("b"), "r").alias("v")).collect()
    assert {r.r: r.u for r in got} == {r.r: r.v for r in got} == cases
