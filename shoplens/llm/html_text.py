"""Main text by wrapper induction (operator 7).

A host's page with the smallest id is its reference tree. Every page of the
host is aligned with it by simple tree matching (the largest order-preserving
matching of nodes of equal tags). A reference node whose own text is the same
on nearly all pages that have it is template; the others, and what the
reference lacks, are slots. A page's text is the smallest region that holds
its slots, without template nodes and without parts that are no article by
their tag or class, or their ancestors'. Two distinct pages of a host are
enough, but below five nodes inside an article are never template; a host with
one page has no votes: there the tags decide (see :func:`by_tags`).
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import written
from shoplens.llm.url_filter import host_of

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
TO_THE_END = frozenset("script style textarea title".split())  # without an end tag these take the rest of the page
DROP = RAW | frozenset("nav header footer aside form button select menu dialog head object audio video canvas".split())
# words of class and id names of what is no article, and words that may stand beside them in a name
NOISE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav "
                  "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup "
                  "modal newsletter subscribe share sharing social comment comments replies disqus related recommended widget "
                  "pagination pager login signup search".split())
BESIDE = frozenset("site page main top bottom left right side post article box list section wrapper wrap area bar links link "
                   "buttons button container inner outer block item items group holder row col panel icons icon form text slot "
                   "unit global primary secondary sticky fixed floating bottom mobile desktop".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
PAGE = frozenset("#root html body".split())
HOLDS = {"main": 1, "h1": 2, "article": 4}
SAME_SHARE, LEAST_PAGES, SURE_PAGES = 0.9, 2, 5


def noisy(names: str) -> bool:
    """Whether a class or id name says that an element is no article: ``cookie-notice``, but not ``has-sidebar``."""
    for name in names.lower().split():
        parts = [p.rstrip("0123456789") for p in re.split("[-_]+", name)]
        if any(p in NOISE for p in parts) and all(p in NOISE or p in BESIDE or not p for p in parts):
            return True
    return False


def attributes(source: str, pos: int) -> tuple[dict[str, str], bool, int]:
    """Attributes by name (the first of a name counts), whether the tag closes itself, and where it ends."""
    found: dict[str, str] = {}
    while True:
        m = _ATTR.match(source, pos)
        if m is None:  # the page ends inside the tag
            return found, False, len(source)
        pos = m.end()
        if m[1]:
            return found, source[pos - 2] == "/", pos
        found.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")


class Node:
    __slots__ = ("tag", "label", "noise", "guess", "parts", "kids", "at", "shape", "size", "holds", "mass")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.parts, self.kids, self.at = tag, [], [], -1
        self.noise, self.guess = tag in DROP, tag == "form"  # a guess can be overruled by what the element holds
        self.label = tag
        if attrs:
            if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
                self.noise, self.guess = True, tag not in DROP and "hidden" not in attrs
            elif not self.noise and tag not in INLINE and noisy(f"{attrs.get('class', '')} {attrs.get('id', '')}"):
                self.noise = self.guess = True
            if "class" in attrs:
                self.label = f"{tag}.{attrs['class']}"

    def own_text(self) -> str:
        return " ".join(" ".join(p for p in self.parts if isinstance(p, str)).split())


def raw_ends(source: str, tag: str) -> dict[int, int]:
    """Where the elements ``tag`` end, by where their start tags end; elements without an end tag are left out."""
    marks = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</\1[^>]*>|\Z)|"""
                       rf"""<(/?){re.escape(tag)}(?=[\s/>])""", re.S | re.I)
    out, open_, pos = {}, [], 0
    while (m := marks.search(source, pos)) is not None:
        pos = m.end()
        if m[2] is None:
            continue
        _, closed, pos = attributes(source, pos)
        if not m[2]:
            if not closed:
                open_.append(pos)
        elif open_:
            out[open_.pop()] = pos
    return out


def parse(source: str) -> Node:
    """A tree of elements with their texts; forgiving about missing and stray end tags.

    Elements of RAW are skipped to their end tags, nested ones of the same tag
    included. Self-closing ones (but not those of TO_THE_END, where HTML ignores
    the slash) and ones without an end tag are empty.
    """
    root = Node("#root")
    ends: dict[str, dict[int, int]] = {}
    stack, pos, n = [root], 0, len(source)

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(html.unescape(piece) if "&" in piece else piece)

    while pos < n:
        m = _OPEN.search(source, pos)
        if m is None:
            text(source[pos:])
            break
        text(source[pos:m.start()])
        pos = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        attrs, closed, pos = attributes(source, pos)
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P and stack[-1].tag not in ("#root", "body", "div", "article"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "select"):
                    break
        node = Node(tag, attrs)
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag in TO_THE_END:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(source, pos)
            pos = end.end() if end else n
        elif tag in RAW:
            if not closed:
                if tag not in ends:
                    ends[tag] = raw_ends(source, tag)
                pos = ends[tag].get(pos, pos)
        elif tag not in VOID and not closed:
            stack.append(node)
    return root


_shapes: dict[tuple, int] = {}


def measure(root: Node) -> list[Node]:
    """Numbers the nodes in page order and gives each its size and shape; iterative, so depth is no limit.

    The page itself is never noise. An element that is noise by a guess (its
    class, id or role, or a form) isn't if it holds a main, or an h1 and an
    article, or more than four fifths of the page's text: it wraps the page.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.at = len(order)
        order.append(node)
        stack.extend(reversed(node.kids))
    if len(_shapes) > 200_000:
        _shapes.clear()
    for node in reversed(order):
        node.size = 1 + sum(k.size for k in node.kids)
        node.holds = HOLDS.get(node.tag, 0)
        node.mass = 0 if node.noise and not node.guess else \
            sum(len(p.split()) for p in node.parts if isinstance(p, str)) + sum(k.mass for k in node.kids)
        for k in node.kids:
            node.holds |= k.holds
        key = (node.label, *(k.shape for k in node.kids))
        node.shape = _shapes.setdefault(key, len(_shapes) + 1)
    for node in order:
        if node.noise and (node.tag in PAGE or node.guess and (
                node.holds & 1 or node.holds & 6 == 6 or 5 * node.mass > 4 * root.mass)):
            node.noise = False
    return order


def _split(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """Equal shapes at both ends: matching them is always among the best."""
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo].shape == b[lo].shape:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi].shape == b[-1 - hi].shape:
        hi += 1
    return lo, hi


_SMALL = 256  # cells up to which a table is filled in plain Python


def match(a: Node, b: Node, memo: dict | None = None) -> int:
    """Size of the largest matching of two trees (simple tree matching); no recursion, so depth is no limit."""
    memo = {} if memo is None else memo
    stack, got = [_match(a, b, memo)], None
    while stack:
        try:
            pair = stack[-1].send(got)
            stack.append(_match(*pair, memo))
            got = None
        except StopIteration as done:
            stack.pop()
            got = done.value
    return got


def _match(a: Node, b: Node, memo: dict):
    """Asks for the matches of pairs of kids and returns that of a and b."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    key = (a.shape, b.shape)
    if key not in memo:
        lo, hi = _split(a.kids, b.kids)
        x, y = a.kids[lo:len(a.kids) - hi], b.kids[lo:len(b.kids) - hi]
        worth = {}
        for p in {k.shape: k for k in x}.values():
            for q in {k.shape: k for k in y}.values():
                if p.label == q.label:
                    worth[p.shape, q.shape] = p.size if p.shape == q.shape else memo.get((p.shape, q.shape)) or (yield p, q)
        same = sum(k.size for k in a.kids[:lo]) + sum(k.size for k in a.kids[len(a.kids) - hi:])
        memo[key] = 1 + same + (_best(x, y, worth) if x and y else 0)
    return memo[key]


def _worths(x: list[Node], y: list[Node], worth: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A small table of worths by distinct shapes, and the place of each node in it."""
    rows, cols = ({s: i for i, s in enumerate(dict.fromkeys(k.shape for k in z))} for z in (x, y))
    table = np.zeros((len(rows), len(cols)), np.int64)
    for (p, q), w in worth.items():
        table[rows[p], cols[q]] = w
    return table, np.array([rows[k.shape] for k in x]), np.array([cols[k.shape] for k in y])


def _last_row(table: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Best matchings of all of xs with every beginning of ys: a row of the table is a few numpy steps."""
    row = np.zeros(len(ys) + 1, np.int64)
    for i in xs:
        step = np.maximum(row[1:], row[:-1] + table[i][ys])
        row[1:] = np.maximum.accumulate(step)
    return row


def _best(x: list[Node], y: list[Node], worth: dict) -> int:
    if len(x) * len(y) <= _SMALL:
        row = [0] * (len(y) + 1)
        for p in x:
            last, row = row, [0]
            for j, q in enumerate(y):
                row.append(max(row[j], last[j + 1], last[j] + worth.get((p.shape, q.shape), 0)))
        return row[-1]
    table, xs, ys = _worths(x, y, worth)
    return int(_last_row(table, xs, ys)[-1])


def _pairs(table: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
    """One best matching; by halves (Hirschberg), so that memory stays linear in the siblings."""
    out, stack = [], [(0, len(xs), 0, len(ys))]
    while stack:
        lo, hi, left, right = stack.pop()
        if lo == hi or left == right:
            continue
        if hi - lo == 1:
            got = table[xs[lo]][ys[left:right]]
            if got.max() > 0:
                out.append((lo, left + int(got.argmax())))
            continue
        mid = (lo + hi) // 2
        before = _last_row(table, xs[lo:mid], ys[left:right])
        after = _last_row(table, xs[mid:hi][::-1], ys[left:right][::-1])[::-1]
        cut = left + int((before + after).argmax())
        stack += [(lo, mid, left, cut), (mid, hi, cut, right)]
    return sorted(out)


def _align(a: list[Node], b: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Pairs of a largest matching of two lists of siblings."""
    lo, hi = _split(a, b)
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    inner = []
    if x and y:
        worth = {(p.shape, q.shape): match(p, q, memo) for p in {k.shape: k for k in x}.values()
                 for q in {k.shape: k for k in y}.values() if p.label == q.label}
        inner = [(x[i], y[j]) for i, j in _pairs(*_worths(x, y, worth))]
    return [*zip(a[:lo], b[:lo]), *inner, *(zip(a[-hi:], b[-hi:]) if hi else ())]


def aligned(reference: Node, page: Node) -> Iterator[tuple[Node, Node]]:
    """Matched nodes of both trees."""
    memo: dict = {}
    stack = [(reference, page)]
    while stack:
        a, b = stack.pop()
        yield a, b
        stack.extend(_align(a.kids, b.kids, memo))


def visible(root: Node) -> list[Node]:
    """Nodes in page order that are not noise and not below noise."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.noise:
            out.append(node)
            stack.extend(reversed(node.kids))
    return out


def by_slots(root: Node, template: set[int]) -> str:
    """Text of the smallest region that holds all visible nodes whose own text varies; all articles in it stay."""
    slots = [n.at for n in visible(root) if n.at not in template and n.own_text()]
    if not slots:
        return ""
    region, inner = root, root
    while inner:
        region = inner
        inner = next((k for k in region.kids if k.at <= slots[0] and slots[-1] < k.at + k.size), None)
        if region.at == slots[0]:
            break
    return plain(region, template)


def by_tags(root: Node) -> str:
    """Text of all outermost visible article and main elements if they hold half of the visible text, else all of it."""
    whole = plain(root, frozenset())
    pieces, upto = [], 0
    for node in visible(root):
        if node.at >= upto and node.tag in ("article", "main"):
            pieces.append(plain(node, frozenset()))
            upto = node.at + node.size
    found = " ".join(p for p in pieces if p)
    return found if 2 * len(found) >= len(whole) else whole


def plain(node: Node, template: frozenset[int] | set[int]) -> str:
    """Text below ``node`` in page order; blocks and breaks count as a space."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not x.noise:
            inline = x.tag in INLINE
            if not inline:
                out.append(" ")
                stack.append(" ")
            stack.extend(p for p in reversed(x.parts) if not (isinstance(p, str) and x.at in template))
    return " ".join("".join(out).split())


def in_article(order: list[Node]) -> set[int]:
    """Numbers of the nodes in article and main elements."""
    out, upto = set(), -1
    for node in order:
        if node.at < upto:
            out.add(node.at)
        elif node.tag in ("article", "main"):
            upto = node.at + node.size
            out.add(node.at)
    return out


def extract(pages: DataFrame, salts: int = 32) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    Null and empty pages have the empty text. Null urls and urls without a host
    share the empty host. Repeated rows are extracted each, but equal pages of
    a host count once for its template, so copies don't become template. Other
    columns are ignored; an empty table gives an empty result.

    Pages are shuffled once, by host and salt; both passes read that exchange.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")) \
        .withColumn("host", host_of(F.col("url")))
    refs = written(pages.where("html <> ''").groupBy("host").agg(
        F.min_by("html", F.struct(F.col("page_id").isNull(), "page_id", F.xxhash64("html"))).alias("ref")))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
    full = pages.where("html <> ''").withColumn("salt", salt)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(n, "host", "salt")
    # a host's reference goes to those of its salts that have pages
    places = full.select(F.col("host").alias("ref_host"), F.col("salt").alias("ref_salt")).distinct()

    def joined(wrappers: DataFrame) -> DataFrame:
        own = places.join(wrappers.withColumnRenamed("host", "ref_host"), "ref_host")
        return dealt.join(own, (F.col("host") == F.col("ref_host")) & (F.col("salt") == F.col("ref_salt"))).drop("ref_host", "ref_salt", "salt")

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[str, tuple[Node, set[int]]] = {}
        for pdf in batches:
            out = []
            for host, page, ref in zip(pdf["host"], pdf["html"], pdf["ref"]):
                tree = parse(page)
                measure(tree)
                if host not in trees:
                    if len(trees) > 500:
                        trees.clear()
                    wrapper = parse(ref)
                    trees[host] = wrapper, in_article(measure(wrapper))
                wrapper, inside = trees[host]
                key = int.from_bytes(hashlib.blake2b(plain(tree, frozenset()).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                for a, b in aligned(wrapper, tree):
                    text = a.own_text()
                    if text:
                        out.append((host, a.at, key, text == b.own_text(), a.at in inside))
            yield pd.DataFrame(out, columns=["host", "at", "page", "same", "inside"])

    cast = joined(refs).mapInPandas(votes, "host string, at int, page long, same boolean, inside boolean")
    # equal pages count once: the same text at the same node
    counts = cast.groupBy("host", "at", "page").agg(F.max("same").alias("same"), F.max("inside").alias("inside")) \
        .groupBy("host", "at").agg(F.count("*").alias("n"), F.sum(F.col("same").cast("long")).alias("same"), F.max("inside").alias("inside"))
    # few pages may share a passage of their articles by chance: there only what stands outside is template
    fixed = (100 * F.col("same") >= round(100 * SAME_SHARE) * F.col("n")) & (
        (F.col("n") >= SURE_PAGES) | (F.col("n") >= LEAST_PAGES) & ~F.col("inside"))
    template = counts.groupBy("host").agg(F.collect_list(F.when(fixed, F.col("at"))).alias("template"),
                                          F.max("n").alias("n"))
    # null: too few pages for votes
    wrappers = refs.join(template.where(F.col("n") >= LEAST_PAGES).drop("n"), "host", "left").select("host", "ref", "template")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[str, tuple[Node, set[int], dict[int, str]]] = {}
        for pdf in batches:
            out = []
            for host, page, ref, fixed in zip(pdf["host"], pdf["html"], pdf["ref"], pdf["template"]):
                tree = parse(page)
                measure(tree)
                if fixed is None:
                    out.append(by_tags(tree))
                    continue
                if host not in trees:
                    if len(trees) > 500:
                        trees.clear()
                    wrapper = parse(ref)
                    own = {n.at: n.own_text() for n in measure(wrapper)}
                    trees[host] = wrapper, {int(x) for x in fixed}, own
                wrapper, nodes, own = trees[host]
                gone = set()
                if nodes:
                    gone = {b.at for a, b in aligned(wrapper, tree) if a.at in nodes and own[a.at] == b.own_text()}
                out.append(by_slots(tree, gone))
            res = pdf[["page_id", "url"]].copy()
            res["text"], res["n_chars"] = out, [len(x) for x in out]
            yield res

    found = joined(wrappers).mapInPandas(texts, "page_id long, url string, text string, n_chars long")
    empty = pages.where("html = ''").select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    return found.union(empty)
