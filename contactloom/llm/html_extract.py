"""Main text of web pages by a site style tree.

The pages of one host are merged into one style tree: an element node is a path of tags with their
classes, and its style nodes are the distinct sequences of children that pages show there.  With m
pages holding an element, its presentation importance is the entropy (base m) of its style nodes,
and the content importance of its own text is one minus the mean entropy (base m) of its text
features, a feature that sits on k pages having entropy log_m k.  What every page repeats scores near
zero both ways; branches whose importance stays below a bound are removed from each page.

Only counts by (host, path, feature) are merged, so a large host is partial aggregates, never a
list of its pages.  Two priors frame the tree.  Elements that declare themselves boilerplate
(navigation, footers, adverts, forms, comments, ...) have importance zero: menus filled with words
that differ from page to page would mislead entropies taken alone.  A declared article is a root of
its own in the tree, and its parts have their importance raised by ``RAISE``; parts that the host
still repeats go.  There, pages of one and the same article count once, so that articles that a site
repeats stay whole.
"""

from __future__ import annotations

import html as entities
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist, quoted, table

LEAST_PAGES = 3
BOUND = 0.2
RAISE = 0.1
#: Parent key of declared main elements.
MAIN_ROOT = 1

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open element of these names, up to the nearest of the second group.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split(), (("p",), ("td", "th", "table", "button", "object"))),
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ("html",)),
}
NOISE_TAGS = frozenset("head nav aside footer form script style noscript iframe template svg button select textarea input dialog menu object embed canvas audio video map title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored sponsors nav navbar navigation navi menu menus breadcrumb breadcrumbs"
    " sidebar sidebars aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay disclaimer share sharing social follow"
    " comment comments commentlist disqus respond replies related recommended recommendations recirc newsletter subscribe subscription signup login widget widgets pagination pager skip".split()
)
#: Names of lists that hold articles other than the page's own.
LIST_WORDS = frozenset("comment comments commentlist disqus respond replies related recommended recommendations recirc".split())
#: Class names that start so speak of another element: has-sidebar.
STATES = ("has", "no", "with", "without")
MAIN_WORDS = frozenset("article main".split())

_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", regex.S)
_ATTR = regex.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = regex.compile(r"[^a-z0-9]+")
_SPACE = regex.compile(r"\s+")


@dataclass(slots=True)
class Node:
    """An element: its style (tag and classes), its prior and its children (nodes and texts)."""

    tag: str
    style: str
    prior: int  # -1 declared boilerplate, 1 declared main text, 0 undecided
    children: list = field(default_factory=list)
    named: int = 0  # boilerplate by its class or id only: 1 by a part of a name, 2 by a whole name, 3 as a list


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /") else {}


def _element(tag: str, attributes: dict[str, str]) -> Node:
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    parts = [p for x in names if (p := [w for w in _SPLIT.split(x) if w]) and p[0] not in STATES]
    words = {w for p in parts for w in p} & NOISE_WORDS
    role = attributes.get("role", "").lower().strip()
    style = ".".join([tag, *sorted(attributes.get("class", "").lower().split())])
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    if tag not in ("html", "body") and (tag in NOISE_TAGS or role in NOISE_ROLES or hidden):
        return Node(tag, style, -1)
    if tag not in ("html", "body") and words:
        return Node(tag, style, -1, named=3 if words & LIST_WORDS else 2 if any(words.issuperset(p) for p in parts) else 1)
    if tag in MAIN_WORDS or role in MAIN_WORDS:
        return Node(tag, style, 1)
    return Node(tag, style, 0)


def parse(text: str) -> Node:
    """The element tree of a page.  Unclosed and stray tags are mended as browsers do, in outline;
    the unread rest of an unclosed script or comment belongs to it.  Time is linear in the text."""
    root = Node("#root", "", 0)
    stack, at, n, named = [root], 0, len(text), False
    places: dict[str, list[int]] = {}  # of the open elements of each tag, so that no tag walks the stack

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def add(child: Node | str) -> None:
        stack[-1].children.append(child)

    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            add(text[at:])
            break
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue  # comment, doctype or processing instruction
        if m[1] or m[4]:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in CLOSES:
            gone, scope = CLOSES[tag]
            wall = max((own[-1] for t, own in places.items() if own and t not in gone and (t in scope or t in BLOCKS)), default=0)
            above = [own[k] for t in gone if (own := places.get(t)) and (k := bisect_right(own, wall)) < len(own)]
            if above:
                cut(min(above))
        node = _element(tag, _attributes(m[3] or ""))
        add(node)
        named = named or node.named > 0
        if tag in RAW:
            end = regex.compile(rf"</{regex.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", regex.I).search(text, at)
            node.children.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    if named:
        _open_wrappers(root)
    return root


def _open_wrappers(root: Node) -> None:
    """Take the prior from elements that only a class or id calls boilerplate and that hold the
    page's main text: a <main>, or an article where their name only has a listed word as a part or
    where the page declares no other main text.  Lists of comments or related pages open for a
    <main> only."""
    order, stack = [], [(root, -1)]
    while stack:
        node, above = stack.pop()
        if node.prior == -1 and not node.named:
            continue
        stack += [(c, len(order)) for c in node.children if isinstance(c, Node)]
        order.append((node, above))
    holds = [0] * len(order)  # 2 with a <main> inside, 1 with an article
    for k in range(len(order) - 1, 0, -1):
        node, above = order[k]
        own = 0 if node.prior != 1 else 2 if node.tag == "main" else 1
        holds[above] = max(holds[above], own, holds[k])
    for (node, _), held in zip(order, holds, strict=True):
        if (held == 2 and node.named) or (held == 1 and node.named == 1):
            node.prior = 0
    if not declared_main(root):
        for (node, _), held in zip(order, holds, strict=True):
            if held == 1 and node.named == 2:
                node.prior = 0


def declared_main(root: Node) -> list[Node]:
    """The outermost elements that declare themselves main text, not within boilerplate."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.prior == 1:
            found.append(node)
        elif node.prior == 0:
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def path_key(parent: int, style: str) -> int:
    """Signed 64-bit key of an element's path in the style tree."""
    return xxhash.xxh64_intdigest(f"{parent}>{style}", 7) - (1 << 63)


def _is_unit(node: Node) -> bool:
    """Whether an element of declared main text is judged by itself: blocks and what has a class.
    Other elements are words of the unit around them."""
    return node.tag in BLOCKS or "." in node.style


def _features(top: Node, start: int, declared: bool) -> tuple[set[tuple[int, int, int]], list[str]]:
    """(path, kind, feature) of the branches under ``top``, and their texts."""
    out: set[tuple[int, int, int]] = set()
    texts: list[str] = []
    stack = [(top, start)]
    while stack:
        node, path = stack.pop()
        if node.prior == -1 or (not declared and (node.prior or node.tag == "header")):
            continue
        shape: list[str] = []
        own: list[str] = []
        inner: list[Node | str] = list(reversed(node.children))
        while inner:
            c = inner.pop()
            if isinstance(c, str):
                own.append(c)
            elif declared and not _is_unit(c):
                if c.prior != -1:
                    own.append(" " if c.tag == "br" else "")
                    inner += reversed(c.children)
            else:
                if not shape or shape[-1] != c.style:
                    shape.append(c.style)
                stack.append((c, path_key(path, c.style)))
        for said in ["".join(own)] if declared else own:
            if said := _SPACE.sub(" ", said).strip():
                out.add((path, 1, xxhash.xxh64_intdigest(said) - (1 << 63)))
                texts.append(said)
        out.add((path, 0, xxhash.xxh64_intdigest("|".join(shape)) - (1 << 63)))
    return out, texts


def style_features(root: Node) -> list[tuple[int, int, int, int]]:
    """(path, kind, feature, article) of the branches of one page that are not declared boilerplate,
    each once: kind 0 is the style node (sequence of children, runs of one style as one), kind 1 a
    text of the element's own.  Article is a digest of the page's declared main text for branches
    in it, 0 for others."""
    out = [(*f, 0) for f in _features(root, path_key(0, ""), False)[0]]
    declared, texts = set(), []
    for top in declared_main(root):
        found, said = _features(top, path_key(MAIN_ROOT, top.style), True)
        declared |= found
        texts += said
    article = xxhash.xxh64_intdigest("\n".join(texts)) - (1 << 63)
    return out + [(*f, article) for f in declared]


def main_blocks(root: Node, low: frozenset[int]) -> list[str]:
    """Text blocks of a page in order, without boilerplate and low-importance branches.  A header is
    the page's own, and goes, unless it stands in declared main text; there, a low branch loses its
    own words and its parts are judged for themselves."""
    tops = declared_main(root)
    blocks: list[str] = []
    words: list[str] = []

    def close() -> None:
        if words:
            said = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
            words.clear()
            if said:
                blocks.append(said)

    def walk(top: Node, declared: bool, start: int) -> None:
        # Entries are nodes to open, texts, or None: the end of a block.
        stack: list[tuple[Node | str | None, int]] = [(top, start)]
        while stack:
            item, path = stack.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                if not declared or path == start or path not in low:
                    words.append(item)
            elif item.prior == -1 or (not declared and (path in low or item.tag == "header")):
                if item.tag in BLOCKS:
                    close()
            elif item.tag == "br":
                words.append(" ")
            else:
                block = item.tag in BLOCKS
                if block:
                    close()
                    stack.append((None, 0))
                for c in reversed(item.children):
                    stack.append((c, path_key(path, c.style) if isinstance(c, Node) and (not declared or _is_unit(c)) else path))

    if tops:
        for top in tops:
            walk(top, True, path_key(MAIN_ROOT, top.style))
            close()
    else:
        walk(root, False, path_key(0, ""))
        close()
    return blocks


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def low_branches(pages: DataFrame, bound: float = BOUND, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path) of low-importance branches; ``pages`` has host and html.

    An element's importance is the larger of its presentation and content importance, raised by
    ``RAISE`` in declared main text; elements on fewer than ``least_pages`` pages of a host are not
    judged, where pages with the same declared main text count as one for the branches in it.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, *f) for host, text in zip(batch["host"], batch["html"], strict=True) for f in style_features(parse(text or ""))]
            yield pd.DataFrame(rows, columns=["host", "path", "kind", "feature", "article"])

    seen = pages.where("host <> ''").select("host", "html").mapInPandas(features, "host string, path long, kind int, feature long, article long")
    copies = seen.groupBy("host", "path", "kind", "feature", "article").agg(F.count(F.lit(1)).alias("n"))
    counted = copies.groupBy("host", "path", "kind", "feature").agg(F.sum(F.when(F.col("article") == 0, F.col("n")).otherwise(1)).alias("n"), F.max(F.col("article") != 0).alias("declared"))
    # Both kinds in one aggregation: two would parse every page twice.
    n, nlogn = F.col("n"), F.col("n") * F.log(F.col("n"))
    looks, said = F.col("kind") == 0, F.col("kind") == 1
    sums = (F.max(F.when(looks, F.col("declared"))).alias("declared"), F.sum(F.when(looks, n)).alias("m"), F.sum(F.when(looks, nlogn)).alias("nlogn"), F.sum(F.when(said, n)).alias("k"), F.sum(F.when(said, nlogn)).alias("klogk"))
    both = counted.groupBy("host", "path").agg(*sums).where(F.col("m") >= least_pages)
    presentation = (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")
    content = F.coalesce(1 - F.col("klogk") / F.col("k") / F.log("m"), F.lit(0.0))
    # A branch without texts of its own is removed only through its parts.
    return both.where(F.col("k").isNotNull() & (F.greatest(presentation, content) + F.when(F.col("declared"), RAISE).otherwise(0.0) < bound)).select("host", "path")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bound: float = BOUND, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per row of ``pages``: the id, url, text (blocks joined by two line ends; empty if
    none) and n_chars.

    A null page is empty.  Pages without a host share no style tree and lose declared boilerplate
    only.  Rows with null or repeated ids each get their row; extra columns are not touched.
    """
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"), host_of(quoted(url_col)).alias("host"))
    # One row a host, written: where it is too large to broadcast, a join with a written table can
    # be split at a host that has many pages.
    low = persist(low_branches(rows, bound, least_pages).groupBy("host").agg(F.collect_set("path").alias("low")), "style-low")

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lows in batches:
            yield pd.Series(["\n\n".join(main_blocks(parse(t or ""), frozenset(() if x is None else map(int, x)))) for t, x in zip(texts, lows, strict=True)], dtype=object)

    made = rows.join(low, "host", "left").select("id", "url", main_text("html", "low").alias("text"))
    return made.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of the whole ``pages`` table."""
    return extract_main_text(table(spark, sf_dir, "pages"))
