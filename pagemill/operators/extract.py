"""HTML extraction (E0-E10) as native column expressions.

Spark's ``xpath*`` functions need well-formed XML and fail a whole job on
real HTML, so the selectors of an :class:`ExtractSpec` are compiled into Java
regular expressions and array functions: ``elements`` + ``posexplode`` finds
the item elements of every page (page-parallel, no shuffle), and each field is
found in the item's markup.  Supported selectors are the ones catalogue rules
use: steps ``tag``, ``tag.class``, ``tag.c1.c2`` with descendant steps between
them (``ul li a``).  Class matching is a set test: order and extra classes do
not matter.  Attributes may be quoted either way or bare, quoted values may
hold ``>``, elements of one tag may nest, and comments are no markup.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import absolute_url, base_parts, resolve


@dataclass(frozen=True)
class Selector:
    """``tag.class1.class2`` optionally inside an ancestor selector."""
    tag: str
    classes: tuple[str, ...] = ()
    within: "Selector | None" = None

    @staticmethod
    def parse(css: str) -> "Selector":
        sel = None
        for step in css.split():
            parts = step.split(".")
            if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", parts[0] or "x"):
                raise ValueError(f"unsupported selector step: {step!r}")
            sel = Selector(parts[0] or "*", tuple(p for p in parts[1:] if p), sel)
        if sel is None:
            raise ValueError("empty selector")
        return sel

    def open_tag(self, body: str = T.TAG_BODY) -> str:
        """Regex of this element's start tag, classes tested by look-ahead."""
        tag = r"[A-Za-z][A-Za-z0-9]*" if self.tag == "*" else re.escape(self.tag)
        checks = "".join(f"(?={_attribute('class', _has_class(c))})" for c in self.classes)
        return rf"<(?:{tag})(?=[\s/>]){checks}{body}>"  # grouped: a match begins with one plain character

    def start(self) -> str:
        return rf"(?is)({self.open_tag()})"


def _attribute(name: str, value: str) -> str:
    """Regex from the end of a tag's name through an attribute; quoted values
    before it are skipped whole, so their text is never taken for one."""
    found = rf"{re.escape(name)}\s*=\s*"
    ahead = re.sub(r"(?<!\\)\((?!\?)", "(?:", value).split("(?<!")[0]
    return rf"""(?:[^>"'\s]+|"[^"]*"|'[^']*'|\s(?!{found}(?:{ahead})))*+\s{found}(?:{value})"""


def _has_class(c: str) -> str:
    c = re.escape(c)
    return rf""""(?:[^"]*\s)?{c}(?:\s[^"]*)?"|'(?:[^']*\s)?{c}(?:\s[^']*)?'|{c}(?=[\s>])"""


# Comments, scripts and styles are no markup.
_HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z))"
# An open element of these kinds ends where the next one starts.
_FLAT = {"p", "dt", "dd", "option", "tr", "td", "th", "a", "h1", "h2", "h3", "h4", "h5", "h6"}


def markup_of(html) -> Column:
    """A page's markup without comments, scripts and styles."""
    return T.let(T.text(html), lambda s: F.when(s.rlike("(?i)<(?:!--|script|style)"), F.regexp_replace(s, _HIDDEN, "")).otherwise(s))


# How deep elements of one kind nest where one expression finds them.
_NESTED = 2

# Elements found per block: appending to a block copies it, so that blocks bound the copies.
_BLOCK = 256


def _outer_spans(kinds: Column) -> Column:
    """Spans (s, e) of the outermost matches among pieces of the kinds 2 (a match opens), 1 (another opens), -1 (closes), 0.

    Depth is the sum of the kinds' signs so far.  A match spans from its own
    piece to the piece that closes it, at which the depth is back; ``e`` is
    null if none does.
    """
    span = "struct<s:int,e:int>"
    none = F.expr(f"cast(array() as array<{span}>)")

    def step(acc: Column, kind: Column) -> Column:
        depth = F.greatest(acc["depth"] + F.signum(kind).cast("int"), F.lit(0))
        begins = acc["at"].isNull() & (kind == 2)
        ended = (kind == -1) & (depth <= acc["at"])
        full = ended & (F.size(acc["block"]) >= _BLOCK)
        found = F.struct(acc["start"].alias("s"), acc["i"].alias("e"))
        return F.struct(
            (acc["i"] + 1).alias("i"), depth.alias("depth"),
            F.when(begins, acc["depth"]).when(~F.coalesce(ended, F.lit(False)), acc["at"]).alias("at"),
            F.when(begins, acc["i"]).otherwise(acc["start"]).alias("start"),
            F.when(full, F.array(found)).when(ended, F.array_append(acc["block"], found)).otherwise(acc["block"]).alias("block"),
            F.when(full, F.array_append(acc["blocks"], acc["block"])).otherwise(acc["blocks"]).alias("blocks"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("start"),
                    none.alias("block"), F.expr(f"cast(array() as array<array<{span}>>)").alias("blocks"))
    left_open = lambda acc: F.when(acc["at"].isNotNull(), F.array(F.struct(acc["start"].alias("s"), F.lit(None).cast("int").alias("e")))).otherwise(none)
    return F.aggregate(kinds, zero, step, lambda acc: F.concat(F.flatten(acc["blocks"]), acc["block"], left_open(acc)))


def elements(markup: Column, sel: Selector) -> Column:
    """Elements that match one step, in document order, without their own end tags.

    The markup is cut before every start and end tag of the element's name.
    One pass over the cuts matches them like brackets, on numbers alone, and
    every outermost match is then joined from its pieces: linear in the markup,
    however deep elements nest.  An element left open reaches to the end of the markup;
    a match inside a match belongs to the outer one.
    """
    if sel.tag == "*":
        raise ValueError("content of '*' is not supported")
    tag = re.escape(sel.tag)
    pieces = F.split(markup, rf"(?i)(?=</?{tag}[\s/>])", -1)
    matches = rf"(?is)^{sel.open_tag()}"
    if sel.tag.lower() in _FLAT:
        return F.filter(pieces, lambda p: p.rlike(matches))
    kind = lambda p: F.when(p.rlike(matches), 2).when(p.rlike(rf"(?i)^<{tag}[\s/>]"), 1).when(p.rlike(rf"(?i)^</{tag}[\s/>]"), -1).otherwise(0)
    return T.let(pieces, lambda found: F.transform(_outer_spans(F.transform(found, kind)), lambda x: F.array_join(
        F.slice(found, x["s"] + 1, F.coalesce(x["e"], F.size(found)) - x["s"]), "")))


def inner_elements(markup: Column, sel: Selector) -> Column:
    """The inner markup of ``elements``, found by one expression that is cut at the same places.

    Elements that nest hold other elements of their kind, each closed, to a depth
    of ``_NESTED``.  The first that holds more, or is left open, takes the rest of the markup:
    what is found then ends like the markup, and the markup is matched like brackets.
    """
    if sel.tag == "*":
        raise ValueError("content of '*' is not supported")
    tag = re.escape(sel.tag)
    same = rf"<(?!/?(?:{tag})[\s/>])"  # no cut
    body = rf"""(?:[^<>"']+|{same}|"(?:[^"<]+|{same})*+"|'(?:[^'<]+|{same})*+')*+"""
    plain = rf"(?>[^<]*)(?:{same}[^<]*)*+"
    opened = rf"(?is){sel.open_tag(body)}"
    if sel.tag.lower() in _FLAT:
        return F.regexp_extract_all(markup, F.lit(rf"{opened}({plain})"), F.lit(1))
    content = plain
    for _ in range(_NESTED):
        content = rf"{plain}(?:<(?:{tag})[\s/>]{content}</(?:{tag})[\s/>]{plain})*+"
    found = F.lit(rf"{opened}((?>{content}(?=</{tag}[\s/>])|.*+))")
    by_pieces = lambda m: F.transform(elements(m, sel), lambda e: _inner(e, sel))
    return T.let(markup, lambda m: T.let(F.regexp_extract_all(m, found, F.lit(1)), lambda all_: F.when(
        m.endswith(F.try_element_at(all_, F.lit(-1))), by_pieces(m)).otherwise(all_)))


def _inner(element: Column, sel: Selector) -> Column:
    return F.regexp_replace(element, rf"(?is)^{sel.open_tag()}", "")


def _scope(markup: Column, sel: Selector) -> Column:
    """Markup to search ``sel`` in: the inner markup of every match of its
    ancestor steps, in document order (so "first match" means first in the
    document)."""
    if sel.within is None:
        return markup
    return F.array_join(inner_elements(_scope(markup, sel.within), sel.within), "\n")


def _attr_of(tag: Column, attr: str) -> Column:
    """Decoded value of a start tag's attribute: quoted either way, or bare.

    The first double-quoted one counts if it is not empty, else the first in single
    quotes, else the first bare one: all in one expression that keeps one of three groups.
    """
    values = "|".join(_attribute(attr, v) for v in ('"([^"]*)"(?<!"")', "'([^']*)'(?<!'')", r"""([^\s"'=<>`]+)"""))
    return T.decode_entities(F.regexp_replace(tag, rf"(?is)^<[A-Za-z][^\s/>]*+(?:{values})?.*\z", "$1$2$3"))


def _first_tag(markup: Column, css: str) -> Column:
    """Start tag of the first element matching ``css`` ("" when absent)."""
    sel = Selector.parse(css)
    return F.regexp_extract(_scope(markup, sel), sel.start(), 1)


def child_attr(markup: Column, css: str, attr: str) -> Column:
    """Attribute of the first element matching ``css`` ("" when absent)."""
    return _attr_of(_first_tag(markup, css), attr)


def child_text(markup: Column, css: str) -> Column:
    """Text of all elements matching ``css``, concatenated, tags stripped and
    references decoded (not trimmed)."""
    sel = Selector.parse(css)
    return T.strip_tags(F.array_join(inner_elements(_scope(markup, sel), sel), ""))


# A field rule: (css selector, attribute name or None for the text).
Rule = tuple[str, "str | None"]


@dataclass(frozen=True)
class ExtractSpec:
    """Which elements are items and where their fields come from.

    ``link`` None means the item's URL is the page URL.  ``title`` and
    ``link`` are required: an item without them is dropped (F4).
    """
    item: str = "article.product_pod"
    title: Rule = ("h3 a", "title")
    link: "Rule | None" = ("h3 a", "href")
    price: "Rule | None" = ("p.price_color", None)
    rating_class: "str | None" = "p.star-rating"
    availability: tuple[str, ...] = ("p.instock.availability", "p.availability")
    image: "str | None" = "img"
    next_link: str = "li.next a"


CATALOGUE = ExtractSpec()
# Driver pages: one item per <article>, title = text of its <h1>, URL = page.
ARTICLES = ExtractSpec(item="article", title=("h1", None), link=None, price=None,
                       rating_class=None, availability=(), image="img")


def item_elements(pages: DataFrame, spec: ExtractSpec = CATALOGUE, **per_page: Column) -> DataFrame:
    """One row per item element, ``item_pos`` = document order (0-based), with the columns ``per_page``."""
    sel = Selector.parse(spec.item)
    if sel.within is not None:
        raise ValueError("item selector must be a single step")
    cols = [c for c in ("page_id", "url", "fetched_at") if c in pages.columns]
    # selected first: what stands beside a generator is computed for each of its rows
    return pages.select(*cols, "html", *[c.alias(n) for n, c in per_page.items()]) \
        .select(*cols, *per_page, F.posexplode(inner_elements(markup_of("html"), sel)).alias("item_pos", "item_html"))


def extract_items(pages: DataFrame, spec: ExtractSpec = CATALOGUE, scraped_at: Column | None = None) -> DataFrame:
    """Items of every page, in document order.

    Output: ``page_id, item_pos, title, price, rating, availability,
    image_url, url, scraped_at``.  ``scraped_at`` is ``fetched_at`` when the
    pages carry it, else the given column, else the current time.

    A page's URL is taken apart once for all its items, and a tag that several
    rules read is looked for once.
    """
    el = item_elements(pages, spec, _base=base_parts("url"))
    m = F.col("item_html")
    rules = [spec.title, spec.link, spec.price, spec.rating_class and (spec.rating_class, "class"), spec.image and (spec.image, "src")]
    tags = {css: f"_tag{i}" for i, css in enumerate(dict.fromkeys(css for css, attr in filter(None, rules) if attr))}
    el = el.select("*", *[_first_tag(m, css).alias(name) for css, name in tags.items()])

    def field(rule: "Rule | None") -> Column:
        if not rule:
            return F.lit("")
        css, attr = rule
        return _attr_of(F.col(tags[css]), attr) if attr else child_text(m, css)

    title, href, price, rating, img = (field(r) for r in rules)
    rating = T.let(F.split(T.trim_ws(rating), r"(?U)\s+"), lambda words: F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")))
    avail = F.coalesce(*[T.non_empty(T.trim_ws(child_text(m, css))) for css in spec.availability], F.lit(""))
    when = scraped_at if scraped_at is not None else F.current_timestamp()
    if "fetched_at" in pages.columns:
        when = F.coalesce(F.col("fetched_at"), when)
    fields = {"title": T.trim_ws(title), "_href": href if spec.link else F.col("url"), "price": T.trim_ws(price),
              "rating": rating, "availability": avail, "_img": img}
    read = el.select("page_id", "item_pos", "_base", when.alias("scraped_at"), *[c.alias(n) for n, c in fields.items()])
    # F4 inside an array: as a filter of rows it would compute the fields a second time; the fields come first, as a generator interprets what it holds
    kept = F.filter(F.array(F.struct(*fields)), lambda r: (r["title"] != "") & (r["_href"] != ""))
    out = read.select("page_id", "item_pos", "_base", "scraped_at", F.inline(kept))
    return out.select(
        "page_id", "item_pos", "title", "price", "rating", "availability",
        resolve("_base", "_img").alias("image_url"), resolve("_base", "_href").alias("url"), "scraped_at")


def extracted_raw_items(pages: DataFrame, spec: ExtractSpec = CATALOGUE,
                        scraped_at: Column | None = None) -> DataFrame:
    """E0 in the raw-item shape; arrival order is ``seq`` (the page) and ``item_pos``."""
    it = extract_items(pages, spec, scraped_at)
    return it.select(F.col("page_id").alias("seq"), "item_pos", "title", "price", "rating", "availability", "image_url", "url", "scraped_at")


def links(pages: DataFrame, css: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every ``href`` of elements matching ``css`` (any number of steps), resolved
    against the page URL: ``(page_id, url, *keep, link_pos, href, abs_url)``."""
    sel = Selector.parse(css)
    tags = F.regexp_extract_all(_scope(markup_of("html"), sel), F.lit(sel.start()), 1)
    ex = pages.select("page_id", "url", *keep, F.posexplode(tags).alias("link_pos", "_tag"))
    return ex.select("page_id", "url", *keep, "link_pos", _attr_of(F.col("_tag"), "href").alias("href")) \
        .withColumn("abs_url", absolute_url(F.col("url"), F.col("href")))


def next_links(pages: DataFrame, spec: ExtractSpec = CATALOGUE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Next-page links ``(page_id, url, *keep, next_url)``, absolute."""
    return links(pages, spec.next_link, keep).filter(F.col("abs_url") != "") \
        .select("page_id", "url", *keep, F.col("abs_url").alias("next_url"))


def items_scraped(items: DataFrame) -> DataFrame:
    """A5: number of extracted items, before validation and de-dup."""
    return items.agg(F.count(F.lit(1)).alias("items_scraped"))
