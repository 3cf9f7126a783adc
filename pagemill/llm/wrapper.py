"""Main text of web pages by wrapper induction.

Pages of a host with the same sections at the top share a layout.  Every layout
of at least ``CONSTANT_PAGES`` distinct pages gets a reference: a page of median
size, complete if there is one.  Pages of rarer layouts use the reference of
their host's most frequent layout; so does the whole host if all its layouts are rare.
Each page's DOM is aligned with its reference by simple tree matching, which gives text nodes
the reference's slots.  Over the pages of a layout, a slot that holds the same
text on nearly all distinct pages is constant, so it belongs to the template;
slots whose text varies, and nodes without a counterpart, hold content.
Pages without text are no references.

Boilerplate that varies (menus, adverts, comments ...) is told by elements, roles and
class names, and where a page marks its article, nothing outside counts.  A class
name speaks if all its parts do: they name boilerplate or a mere container (``ad-box``
does, ``related-work`` and ``alert-system`` do not); inside a marked article it does not
speak of paragraphs, headings and cells.

Pages are parsed for their layouts, which choose the references, and once more into blocks,
which are written; counting constant slots and assembling texts are DataFrame work on
these.  References and templates are broadcast only under a measured size; otherwise
they are joined.

Defined cases: null and empty html give an empty text; a null url is the host
''; unclosed and truncated markup is read leniently; exact copies of a page
count once when slots are judged; repeated rows are each extracted; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import BROADCAST_BYTES, in_arrow, materialise

CONSTANT_SHARE = 0.9  # of the distinct pages of a layout that must hold the same text in a slot
CONSTANT_PAGES = 10  # distinct pages that a layout, or a host of rare layouts, needs before a slot is judged
LINK_SHARE, MENU_CHARS = 0.5, 20  # a list block with words beside its links is a menu entry if more than this share is link, but fewer characters
CELLS = 1_000_000  # of an alignment table; longer lists of siblings are aligned in order by their labels
ROW_BYTES = 200  # of a reference, beside its host and tree, when its broadcast is judged

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']++|"[^"]*"|'[^']*')*+)>|([^>]*)(?:>|\Z)))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_QUOTED, _HIDDEN = re.compile(r""""[^"]*"|'[^']*'"""), re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|/|$)")
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption address center details summary fieldset legend hgroup search option optgroup".split())
_DROPPED = frozenset(
    "nav footer aside form button select menu dialog template svg canvas object audio video head datalist label "
    "script style textarea title noscript iframe xmp noembed noframes math".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note".split())
_NAMES = frozenset(
    "ad ads adsense adsbygoogle advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notification alert popup modal overlay toast newsletter subscribe signup login share sharing "
    "social related recommended recommendations comment comments discussion responses disqus reply replies widget toolbar topbar pagination pager "
    "disclaimer copyright".split())
_CONTAINERS = frozenset(  # parts of a class name that say nothing about what it holds
    "site page main top bottom left right inner outer wrap wrapper container box bar block section area list links link button buttons icons panel module "
    "unit slot zone row column primary secondary mobile desktop global sticky floating fixed wall post posts articles entry form header head toggle".split())
_COMMENTS = frozenset("comment comments discussion responses disqus reply replies".split())
_STATES = frozenset("no not non without has with open opened closed on off enabled disabled allowed allow".split())  # a class name of these parts tells a state
_LISTS = frozenset("ul ol li dl dt dd".split())
_TEXTS = frozenset("p blockquote pre caption figcaption td th h1 h2 h3 h4 h5 h6".split())  # their links are text
_OWN = frozenset("article content entry post story".split())  # of a header: it is the text's own
_SECTIONS = frozenset("div section article main header nav aside footer form table".split())  # these tell layouts apart, named or not
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an opening tag ends open elements of these kinds, up to the nearest of the others
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_OPEN_P = _BLOCK - {"html", "head", "body", "option", "optgroup", "td", "th", "tr", "caption"} | {"nav", "footer", "aside", "form", "header", "menu", "hr"}


class Node:
    __slots__ = ("label", "tag", "children", "drop", "main", "head", "text", "linked", "shape", "size")

    def __init__(self, label: str, tag: str, drop: int = 0, main: int = 0, head: bool = False):
        self.label, self.tag, self.children, self.drop, self.main, self.head = label, tag, [], drop, main, head
        self.text, self.linked, self.shape, self.size = None, 0, None, 1


def _judge(tag: str, raw: str) -> tuple[str, int, int, bool]:
    """Label, drop, main and head of an element.

    drop is 1 by kind or a comment's whole class name, 2 by another class name, which a
    marked article inside overrules, 3 by one of a text element, which a marked article around
    it overrules too, and -1 for an article that is a comment if another comes first.
    main is 1 for an article and 2 for the page's main part.
    """
    drop, main, head = int(tag in _DROPPED), 2 if tag == "main" else int(tag == "article"), tag == "header"
    if not raw or "=" not in raw and "hidden" not in raw:
        return tag, drop, main, head
    at = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)}
    names = (at.get("class", "") + " " + at.get("id", "")).lower()
    role = at.get("role", "").lower()
    whole = set(names.split()) if tag not in ("html", "body", "main") else set()
    parts = [set(filter(None, re.split(r"[^a-z]+", w))) for w in whole]
    tokens = set().union(*(p for p in parts if p.isdisjoint(_STATES)))
    found = any(p & _NAMES and p <= _NAMES | _CONTAINERS for p in parts)
    head = head or ("header" in tokens and tag in _BLOCK and tokens.isdisjoint(_OWN))
    if role in _ROLES or at.get("aria-hidden", "").lower() == "true" or "hidden" in raw.lower() and _HIDDEN.search(_QUOTED.sub("''", raw)) or "display:none" in at.get("style", "").replace(" ", ""):
        drop = 1
    elif found:
        said = not _COMMENTS.isdisjoint(whole)
        drop = drop or ((-1 if said else 0) if tag == "article" else 1 if said else 3 if tag in _TEXTS else 2)
    main = 0 if drop == 1 else max(main, 2 if role == "main" else int(role == "article" or at.get("itemprop", "") == "articleBody"))
    return (f"{tag}.{names.strip()}" if names.strip() else tag), drop, main, head


def parse(html: str) -> Node:
    """A lenient block-level DOM: block and dropped elements are nodes, text between their bounds is a ``#text`` leaf."""
    root = Node("#root", "#root")
    stack, buffer, pos, link_at, linked = [root], [], 0, 0, 0
    opened, seen, plain = Counter(), False, False  # open elements by tag; whether a marked article has begun; whether words stand outside links

    def flush():
        nonlocal linked, plain
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            leaf = Node("#text", "#text")
            leaf.text, leaf.linked = text, min(linked, len(text) - 1) if plain or not linked else len(text)
            stack[-1].children.append(leaf)
        linked, plain = 0, False

    def pop_to(k: int):
        nonlocal link_at
        flush()
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]
        if link_at >= len(stack):
            link_at = 0

    size = len(html)
    while pos < size:
        m = _TOKEN.search(html, pos)
        begin = m.start() if m else size
        if begin > pos:
            text = html[pos:begin]
            text = unescape(text) if "&" in text else text
            buffer.append(text)
            if link_at:
                linked += len(text.strip())
            else:
                plain = plain or any(map(str.isalnum, text))
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag == "a":
                link_at = 0
            elif opened[tag] > 0:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag in _BLOCK or tag in _DROPPED or tag == "header":
                flush()
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, pos)
            pos = end.start() if end else size
            if end and (close := html.find(">", pos)) >= 0:
                pos = close + 1
            elif end:
                pos = size
            continue
        if tag in _VOID:
            buffer.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            link_at = len(stack)
            continue
        label, drop, main, head = _judge(tag, m[3] or m[4] or "")
        if tag not in _BLOCK and not drop and tag != "header":
            continue
        if tag in _OPEN_P and stack[-1].tag == "p":
            pop_to(len(stack) - 1)
        if tag in _ENDS and any(opened[t] > 0 for t in _ENDS[tag][0]):
            kinds, bounds = _ENDS[tag]
            cut = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in kinds:
                    cut = k
            if cut:
                pop_to(cut)
        flush()
        if drop < 0:
            drop, main = (1, 0) if seen else (0, 1)
        node = Node(label, tag, drop, main, head)
        if main:  # a marked article overrules the class names around it
            seen = seen or not any(n.drop == 1 for n in stack)
            for n in reversed(stack):
                if n.main:  # which has overruled those above
                    break
                n.drop = 0 if n.drop == 2 else n.drop
        stack[-1].children.append(node)
        if not (m[3] or "").endswith("/"):
            stack.append(node)
            opened[tag] += 1
    flush()
    return root


def _shape(node: Node) -> int:
    """A hash of a subtree's labels; also counts its nodes.  Raises the recursion limit to what ``_match`` needs."""
    depth, level, order = 0, [node], []
    while level:  # children come after their parents
        depth += 1
        order += level
        level = [c for n in level if n.shape is None for c in n.children]
    for n in reversed(order):
        if n.shape is None:
            n.size = 1 + sum(c.size for c in n.children)
            n.shape = hash((n.label, *(c.shape for c in n.children)))
    if 2 * depth + 1000 > sys.getrecursionlimit():  # Python frames only, which are on the heap
        sys.setrecursionlimit(2 * depth + 1000)
    return node.shape


def layout(root: Node) -> tuple[int, int]:
    """Signature of the sections at the top of a page, and how many text leaves the page has."""
    path, node = [], root
    while True:
        kids = [c for c in node.children if c.tag not in ("#text", "head")]
        if len(kids) != 1 or kids[0].main or all(c.tag == "#text" for c in kids[0].children):
            break
        node = kids[0]
        path.append(node.label)
    # paragraphs, lists and headings without a name differ from text to text
    top = sorted({c.label for c in kids if c.tag in _SECTIONS or c.label != c.tag})
    return xxhash.xxh64_intdigest("\n".join([*path, "", *top])) - (1 << 63), len(_number(root))


def encode(node: Node) -> list:
    """A tree of labels for a reference: a list of (label, number of children) in page order."""
    out, work = [], [node]
    while work:
        n = work.pop()
        out.append([n.label, len(n.children)])
        work += reversed(n.children)
    return out


def decode(tree: list) -> Node:
    root, open_ = None, []
    for label, n in tree:
        node = Node(label, label)
        if root is None:
            root = node
        else:
            while not open_[-1][1]:
                open_.pop()
            open_[-1][0].children.append(node)
            open_[-1][1] -= 1
        open_.append([node, n])
    return root


def _ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """How many children of equal shape both lists begin and end with; pairing them is always best."""
    n, most = 0, min(len(xs), len(ys))
    while n < most and xs[n].shape == ys[n].shape:
        n += 1
    k = 0
    while k < most - n and xs[-1 - k].shape == ys[-1 - k].shape:
        k += 1
    return n, k


def _rising(places: list[int]) -> list[int]:
    """Indices of a longest rising subsequence."""
    tails, last, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        before.append(last[k - 1] if k else -1)
        tails[k:k + 1], last[k:k + 1] = [p], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _in_order(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of siblings of equal label, in the order of both lists, in near-linear time.

    Labels that stand once in each list are anchors, as many as keep their order;
    between two anchors, equal labels are paired from the front.
    """
    once = [{n.label: i for i, n in enumerate(zs) if count[n.label] == 1} for zs in (xs, ys) for count in (Counter(n.label for n in zs),)]
    both = sorted((i, once[1][label]) for label, i in once[0].items() if label in once[1])
    anchors = [both[k] for k in _rising([j for _, j in both])]
    out, i, j = [], 0, 0
    for to_i, to_j in [*anchors, (len(xs), len(ys))]:
        at: dict[str, list[int]] = {}
        for k in range(j, to_j):
            at.setdefault(ys[k].label, []).append(k)
        for x in xs[i:to_i]:
            places = at.get(x.label, ())
            k = bisect_left(places, j)
            if k < len(places) and places[k] - j < 64:
                out.append((x, ys[places[k]]))
                j = places[k] + 1
        if to_i < len(xs):
            out.append((xs[to_i], ys[to_j]))
        i, j = to_i + 1, to_j + 1
    return out


def _match(a: Node, b: Node) -> tuple[int, list | None]:
    """Size of the largest common top-down alignment, and what is needed to read it off."""
    if a.label != b.label:
        return 0, None
    if a.shape == b.shape:
        return a.size, None
    n, k = _ends(a.children, b.children)
    xs, ys = a.children[n:len(a.children) - k], b.children[n:len(b.children) - k]
    score = 1 + sum(c.size for c in a.children[:n]) + sum(c.size for c in a.children[len(a.children) - k:])
    if len(xs) * len(ys) > CELLS:  # lists of thousands
        pairs = []
        for x, y in _in_order(xs, ys):
            size, table = _match(x, y)
            pairs.append((x, y, table))
            score += size
        return score, [pairs]
    weight, best = [], [[0] * (len(ys) + 1)]
    for x in xs:
        above, row, here = best[-1], [_match(x, y) if x.label == y.label else (0, None) for y in ys], [0]
        for j in range(len(ys)):
            here.append(max(above[j + 1], here[j], above[j] + row[j][0]))
        weight.append(row)
        best.append(here)
    return score + best[-1][-1], [weight, best]


def align(a: Node, b: Node) -> dict[int, Node]:
    """id of a page's node -> the reference's node, by simple tree matching."""
    _shape(a), _shape(b)
    out: dict[int, Node] = {}
    work = [(a, b, _match(a, b)[1])]
    while work:
        x, y, table = work.pop()
        out[id(x)] = y
        if x.shape == y.shape:
            work += [(p, q, None) for p, q in zip(x.children, y.children)]
        elif table:
            n, k = _ends(x.children, y.children)
            i, j = len(x.children) - k, len(y.children) - k
            work += [(p, q, None) for p, q in zip(x.children[:n] + x.children[i:], y.children[:n] + y.children[j:])]
            if len(table) == 1:
                work += table[0]
                continue
            weight, best = table
            while i > n and j > n:
                w = weight[i - n - 1][j - n - 1]
                if w[0] and best[i - n][j - n] == best[i - n - 1][j - n - 1] + w[0]:
                    i, j = i - 1, j - 1
                    work.append((x.children[i], y.children[j], w[1]))
                elif best[i - n][j - n] == best[i - n - 1][j - n]:
                    i -= 1
                else:
                    j -= 1
    return out


def _number(node: Node) -> dict[int, int]:
    """Slot numbers of a reference's text leaves, in page order."""
    slots, work = {}, [node]
    while work:
        n = work.pop()
        if n.tag == "#text":
            slots[id(n)] = len(slots)
        work += reversed(n.children)
    return slots


def blocks(page: Node, slot_of: dict[int, int]) -> list[dict]:
    """Every text block that elements and names leave, in page order, with its slot (-1: none)."""
    out, work = [], [(page, False, 0, False, page, False)]
    while work:
        n, dropped, in_main, in_header, parent, in_list = work.pop()
        if n.tag == "#text":
            if not dropped:  # a block of nothing but links is a menu, and a paragraph or heading never
                menu = n.linked == len(n.text) or (in_list and LINK_SHARE * len(n.text) < n.linked < MENU_CHARS)
                out.append({"text": n.text, "slot": slot_of.get(id(n), -1), "main": in_main, "menu": menu and parent.tag not in _TEXTS})
            continue
        dropped = dropped or n.drop in (1, 2) or (n.drop == 3 and not in_main)
        in_main = max(in_main, n.main)
        if n.head:  # of an article, the headings are kept
            in_header, dropped = True, dropped or not in_main
        hide = in_header and n.tag not in _HEADINGS
        for c in reversed(n.children):
            work.append((c, dropped or (hide and c.tag == "#text"), in_main, in_header and n.tag not in _HEADINGS, n, in_list or n.tag in _LISTS))
    marked = max((b["main"] for b in out), default=0)  # articles outside the page's main part are teasers
    return [{"text": b["text"], "slot": b["slot"], "hash": xxhash.xxh64_intdigest(b["text"]) - (1 << 63)} for b in out if (b["main"] == marked if marked else not b["menu"])]


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def _hint(df: DataFrame, rows: DataFrame, row_bytes: int, broadcast_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows.count() * row_bytes <= broadcast_bytes else df


def with_layout(pages: DataFrame) -> DataFrame:
    """``pages`` with _layout and _leaves."""
    schema = T.StructType([*pages.schema.fields, T.StructField("_layout", T.LongType()), T.StructField("_leaves", T.LongType())])
    at = pages.columns.index("_html")

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                found = [layout(parse(h)) for h in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], names=schema.names)

    return in_arrow(pages, run, schema)


def references(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, least: int = CONSTANT_PAGES) -> DataFrame:
    """(_host, _layout, _ref, _judges, _tree) of every layout, written: its reference, and whether its pages judge the slots."""
    size, key, part = F.length("_html"), F.xxhash64("_html"), ~F.col("_html").contains("</html>")
    rows = with_layout(pages.filter("_html <> ''").select("_host", "_html"))
    known = materialise(rows.filter("_leaves > 0").select("_host", "_layout", part.alias("_part"), size.alias("_size"), key.alias("_key")).distinct(), "page-layouts")
    sizes = known.groupBy("_host", "_layout").agg(F.count(F.lit(1)).alias("_n"), F.expr(
        "coalesce(percentile_disc(0.5) within group (order by case when not _part then _size end), percentile_disc(0.5) within group (order by _size))").alias("_median"))
    best = known.join(sizes, ["_host", "_layout"]).filter(F.col("_size") == F.col("_median")).groupBy("_host", "_layout", "_n") \
        .agg(F.min(F.struct("_part", "_size", "_key")).alias("_best"))
    main = sizes.groupBy("_host").agg(F.max(F.struct("_n", "_layout")).alias("_main"))
    often, alone = F.col("_n") >= least, F.col("_main._n") < least
    homes = materialise(best.join(main, "_host").select("_host", "_layout", F.when(often, F.col("_layout")).otherwise(F.col("_main._layout")).alias("_ref"),
                                                        (often | alone).alias("_judges"), "_best._size", "_best._key"), "layouts")
    keys = homes.filter("_layout = _ref").select("_host", "_ref", "_size", "_key")
    chosen = pages.select("_host", "_html", size.alias("_size"), key.alias("_key")).join(_hint(keys, keys, 64, broadcast_bytes), ["_host", "_size", "_key"]) \
        .select("_host", "_ref", "_html")

    def trees(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([json.dumps(encode(parse(h)), ensure_ascii=False) for h in b.column(2).to_pylist()], pa.string())],
                                             names=["_host", "_ref", "_tree"])

    # copies of the reference share its key: one tree stays
    got = in_arrow(chosen, trees, "_host string, _ref long, _tree string").groupBy("_host", "_ref").agg(F.min("_tree").alias("_tree"))
    return materialise(homes.select("_host", "_layout", "_ref", "_judges").join(got, ["_host", "_ref"]), "references")


def _known(refs: DataFrame, broadcast_bytes: int) -> tuple[dict, dict] | None:
    """(host, layout) -> (reference, judges) and (host, reference) -> tree, if all of it measures at most ``broadcast_bytes``."""
    held = F.octet_length("_tree") + F.octet_length("_host") + ROW_BYTES
    if (refs.agg(F.sum(held).alias("_bytes")).first()["_bytes"] or 0) > broadcast_bytes:
        return None
    homes, trees = {}, {}
    for r in refs.select("_host", "_layout", "_ref", "_judges", "_tree").collect():
        homes[r._host, r._layout] = r._ref, r._judges
        trees[r._host, r._ref] = r._tree
    return homes, trees


class _Aligner:
    """Blocks of parsed pages; the references met last are kept decoded."""

    def __init__(self):
        self.known: dict[str, tuple[Node, dict[int, int]]] = {}

    def blocks(self, page: Node, tree: str | None) -> list[dict]:
        if not tree:
            return blocks(page, {})
        if tree not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            ref = decode(json.loads(tree))
            _shape(ref)
            self.known[tree] = ref, _number(ref)
        ref, numbers = self.known[tree]
        return blocks(page, {k: numbers[id(v)] for k, v in align(page, ref).items() if id(v) in numbers})


def page_blocks(pages: DataFrame, refs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(_id, _url, _host, _ref, _judges, _page, _blocks) of every page, written; _page is a hash of the kept blocks.

    References that fit a broadcast are looked up where a page is parsed, once; others are joined
    by the layout, for which pages are parsed before.
    """
    known = _known(refs, broadcast_bytes)
    shared = pages.sparkSession.sparkContext.broadcast(known) if known else None
    if shared:
        rows = pages.select("_id", "_url", "_host", "_html")
    else:
        rows = with_layout(pages).join(refs, ["_host", "_layout"], "left").select("_id", "_url", "_host", "_html", "_ref", "_judges", "_tree")
    block = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("hash", T.LongType())]))
    schema = T.StructType([*rows.schema.fields[:3], refs.schema["_ref"], refs.schema["_judges"], T.StructField("_blocks", block)])
    kind = pa.list_(pa.struct([("text", pa.string()), ("slot", pa.int32()), ("hash", pa.int64())]))

    def looked_up(b: pa.RecordBatch):
        homes, trees = shared.value
        for host, html in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            page = parse(html)
            ref, judges = homes.get((host, layout(page)[0]), (None, None))
            yield page, ref, judges, trees.get((host, ref))

    def joined(b: pa.RecordBatch):
        for html, *found in zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6))):
            yield parse(html), *found

    def run(batches):
        aligner = _Aligner()
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                out = [(ref, judges, aligner.blocks(page, tree)) for page, ref, judges, tree in (looked_up if shared else joined)(b)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.bool_(), kind)))],
                                                 names=schema.names)

    return materialise(in_arrow(rows, run, schema).withColumn("_page", F.xxhash64(F.col("_blocks.hash"))), "page-blocks")


def constant_slots(parsed: DataFrame, share: float = CONSTANT_SHARE, least: int = CONSTANT_PAGES) -> DataFrame:
    """(_host, _ref, _constant): slots with the text that nearly all distinct pages which judge a reference hold there, written."""
    judges = parsed.filter("_judges")
    distinct = judges.groupBy("_host", "_ref", "_page").agg(F.lit(1).alias("_one"))
    sizes = distinct.groupBy("_host", "_ref").agg(F.count(F.lit(1)).alias("_pages")).filter(F.col("_pages") >= least)
    held = (judges.select("_host", "_ref", "_page", F.explode("_blocks").alias("b")).filter("b.slot >= 0")
            .select("_host", "_ref", "_page", "b.slot", "b.hash").distinct()
            .groupBy("_host", "_ref", "slot", "hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= share * least))
    same = held.join(sizes, ["_host", "_ref"]).filter(F.col("_n") >= share * F.col("_pages"))
    return materialise(same.groupBy("_host", "_ref").agg(F.collect_list(F.struct("slot", "hash")).alias("_constant")), "constant-slots")


def extract_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    pages = pages.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), host_of(F.col("url")).alias("_host"),
                         F.coalesce("html", F.lit("")).alias("_html"))
    parsed = page_blocks(pages, references(pages, broadcast_bytes), broadcast_bytes)
    constant = constant_slots(parsed)
    j = parsed.join(_hint(constant, constant, 256, broadcast_bytes), ["_host", "_ref"], "left")
    kept = F.when(F.col("_constant").isNull(), F.col("_blocks")).otherwise(F.filter(
        "_blocks", lambda b: ~F.exists("_constant", lambda c: (c["slot"] == b["slot"]) & (c["hash"] == b["hash"]))))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return j.select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
