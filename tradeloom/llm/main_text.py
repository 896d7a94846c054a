"""Main text of web pages by composite text density.

A page becomes a tree of block elements. Every node has its characters C, link characters LC, tags T (itself, the blocks
below it and its links) and link tags LT, and the density

    C / T * ln(C / LC * T / LT) / ln(ln(LC * C / (C - LC) + C * LCb / Cb + e))

where b is the body: text in long runs outside links is dense, lists of links are not. The node whose children's densities
sum up highest is the text; the smallest density on its path to the body is the threshold by which further subtrees of the
page are taken in. Elements that HTML or common names mark as something other than the text (menus, adverts, comments ...)
leave the tree first. Pages are independent: one pass of tasks over whole pages, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tradeloom.llm.common import table

_TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)"  # comments
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",  # declarations and bogus comments
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes xmp".split())  # no markup inside
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# elements that are never part of the text, and the words that name such parts in class and id
NOT_TEXT = frozenset(
    "head nav footer aside form noscript template svg math canvas audio video object applet map button select datalist fieldset "
    "dialog menu search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion "
    "banner menu nav navbar navigation navigator sidebar aside widget widgets footer masthead topbar toolbar cookie cookies consent "
    "gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login search "
    "form share sharing social related recommended recommendations pagination pager copyright legal disclaimer breadcrumb breadcrumbs "
    "comment comments commentlist disqus replies respond discussion hidden".split()
)
DISCUSSION = frozenset("comment comments commentlist disqus replies respond discussion".split())
WRAPS = frozenset("has with no without".split())  # "has-sidebar" names a page, not its sidebar
BARRIER = frozenset("table td th caption html template button object".split())  # an end tag closes nothing beyond these


class Node:
    __slots__ = ("tag", "parent", "items", "gone", "chars", "links", "tags", "link_tags", "density", "total", "best", "header")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.items: list = []  # texts, (text of a link,) and nodes in page order
        self.gone = self.header = False
        self.chars = self.links = self.link_tags = 0
        self.tags = 1
        self.density = self.total = 0.0
        self.best = self


def _named(name: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names something else than the text, a page or article header, a discussion."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or WRAPS & set(parts):
        return False, False, False
    ends = {parts[0], parts[-1]}
    return bool(ends & NAMES), parts[-1] == "header", bool(ends & DISCUSSION)


def _judge(tag: str, rest: str) -> tuple[str, bool]:
    """('' | 'gone' | 'named' | 'discussion', is a header) by the tag and its attributes."""
    verdict, header = ("gone" if tag in NOT_TEXT else ""), tag == "header"
    if "=" not in rest and "hidden" not in rest.lower():
        return verdict, header
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "gone", header
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "gone", header
        if key == "role" and value.lower() in ROLES:
            header |= value.lower() == "banner"
            verdict = verdict or ("" if header else "gone")
        if key in ("class", "id"):
            for name in value.split():
                named, top, talk = _named(name)
                header |= top
                verdict = "discussion" if talk else verdict or ("named" if named else "")
    return verdict, header


def parse(html: str) -> list[Node]:
    """The block nodes of a page in page order; the first is the root, missing end tags are supplied as HTML has them."""
    root = Node("html", None)
    nodes, stack, marks = [root], [root], {}
    inline: list[tuple[str, int]] = []  # open inline elements with the depth of their block
    open_tags: dict[str, int] = {}
    open_inline: dict[str, list[int]] = {}  # depths by name
    link = skip = 0

    def leave() -> str:
        nonlocal link, skip
        name = inline.pop()[0]
        open_inline[name.lstrip("!")].pop()
        link -= name.lstrip("!") == "a"
        skip -= name.startswith("!")
        return name.lstrip("!")

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1
        while inline and inline[-1][1] > depth:
            leave()

    def close_tag(names: frozenset | set, stop: frozenset) -> None:
        if any(open_tags.get(n) for n in names):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in names:
                    return close(depth)
                if stack[depth].tag in stop:
                    return

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        end = m.start() if m else size
        if end > at and not skip:
            text = unescape(html[at:end])
            stack[-1].items.append((text,) if link else text)
        if not m:
            break
        at = m.end()
        if m["name"] is None:
            continue
        tag, rest = m["name"].lower(), m["rest"]
        if m["end"]:
            if tag in BLOCK:
                close_tag(HEADINGS if tag in HEADINGS else {tag}, BARRIER - {tag})
            elif open_inline.get(tag):
                inside = open_inline[tag][-1] == len(stack)  # one opened outside this block stays open
                while inside and leave() != tag:
                    pass
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = over.start() if over else size
            continue
        if tag in ("html", "body"):
            if tag == "body" and not open_tags.get("body"):
                close(1)
                while inline:
                    leave()
                stack.append(Node("body", root))
                root.items.append(stack[-1])
                nodes.append(stack[-1])
                open_tags["body"] = 1
            continue
        if tag in BLOCK:
            if tag not in ("option", "optgroup"):
                close_tag({"p"}, BARRIER)
            if tag == "li":
                close_tag({"li"}, frozenset(("ul", "ol", "menu", "dir")) | BARRIER)
            elif tag in ("dt", "dd"):
                close_tag({"dt", "dd"}, frozenset(("dl",)) | BARRIER)
            elif tag in ("td", "th"):
                close_tag({"td", "th"}, frozenset(("tr", "table")))
            elif tag == "tr":
                close_tag({"tr"}, frozenset(("table",)))
            elif tag in ("thead", "tbody", "tfoot"):
                close_tag({"thead", "tbody", "tfoot"}, frozenset(("table",)))
            elif tag in HEADINGS and stack[-1].tag in HEADINGS:
                close(len(stack) - 1)
            elif tag == "option":
                close_tag({"option"}, frozenset(("select",)))
            if skip:
                continue
            node = Node(tag, stack[-1])
            stack[-1].items.append(node)
            nodes.append(node)
            verdict, node.header = _judge(tag, rest)
            if verdict:
                marks[len(nodes) - 1] = verdict
            if tag in VOID:
                continue
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        elif tag == "br":
            stack[-1].items.append((" ",) if link else " ")
        elif tag not in VOID:
            verdict = "" if skip else _judge(tag, rest)[0]
            if tag == "a":
                if link:
                    continue  # a link inside a link
                link += 1
                stack[-1].link_tags += 1
            name = f"!{tag}" if verdict else tag
            skip += bool(verdict)
            inline.append((name, len(stack)))
            open_inline.setdefault(tag, []).append(len(stack))
    _prune(nodes, marks)
    return nodes


def _prune(nodes: list[Node], marks: dict[int, str]) -> None:
    """Take marked nodes out, but no wrapper that holds the article or most of the page."""
    index = {id(n): i for i, n in enumerate(nodes)}
    wraps, plain, article = set(), [0] * len(nodes), [False] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        plain[i] += sum(len(t.strip()) for t in node.items if isinstance(t, str))
        article[i] |= node.tag == "article"
        if node.tag == "main" or i in wraps:
            wraps.add(i)
        if node.parent is not None:
            up = index[id(node.parent)]
            plain[up] += plain[i]
            article[up] |= article[i] and marks.get(i) != "discussion"
            if i in wraps:
                wraps.add(up)
    for i, verdict in marks.items():
        node = nodes[i]
        if node.tag in ("html", "body", "main") or i in wraps:
            continue
        if verdict == "named" and (article[i] or node.tag == "article"):
            continue
        if node.tag == "form" and verdict != "discussion" and (article[i] or 2 * plain[i] > plain[0]):
            continue
        node.gone = True
    inside = [False] * len(nodes)  # in an article or main: a header there gives its headings
    for i, node in enumerate(nodes):
        up = index[id(node.parent)] if node.parent is not None else 0
        inside[i] = inside[up] or node.tag in ("article", "main")
        if not node.header or node.gone or i in wraps or article[i]:
            continue
        if not inside[i]:
            node.gone = True
        else:
            node.items = _headings(node)


def _headings(node: Node) -> list[Node]:
    found, todo = [], [t for t in reversed(node.items) if isinstance(t, Node)]
    while todo:
        n = todo.pop()
        if n.gone:
            continue
        if n.tag in HEADINGS:
            found.append(n)
        else:
            todo.extend(t for t in reversed(n.items) if isinstance(t, Node))
    return found


def _below(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(t for t in reversed(n.items) if isinstance(t, Node) and not t.gone)


def measure(root: Node, body_links: int, body_chars: int) -> list[Node]:
    """Densities, sums of the children's densities and each subtree's node of the highest sum; nodes in page order."""
    order = list(_below(root))
    for node in reversed(order):
        kids = [t for t in node.items if isinstance(t, Node) and not t.gone]
        own = sum(len("".join(t.split())) for t in node.items if isinstance(t, str))
        own_links = sum(len("".join(t[0].split())) for t in node.items if isinstance(t, tuple))
        node.links = own_links + sum(k.links for k in kids)
        node.chars = own + own_links + sum(k.chars for k in kids)
        node.tags = 1 + node.link_tags + sum(k.tags for k in kids)
        node.link_tags += sum(k.link_tags for k in kids)
        c, lc, t, lt = node.chars, node.links or 1, node.tags, node.link_tags or 1
        if c:
            lean = math.log(max(1.0, c / lc * t / lt))
            node.density = c / t * lean / math.log(math.log(lc * c / max(1, c - node.links) + c * body_links / max(1, body_chars) + math.e))
        # text that stands in the node itself counts as one child
        beside = node.density * (own + own_links) / c if kids and c else node.density
        node.total = beside + sum(k.density for k in kids)
        node.best = max([node, *(k.best for k in kids)], key=lambda n: n.total)  # the first of equals is the outer one
    return order


def _menu(node: Node) -> bool:
    return node.link_tags >= 3 and 2 * node.links > node.chars


def select(body: Node, order: list[Node]) -> list[Node]:
    """Subtrees that make up the text, in page order."""
    target = body.best
    path, node = [], target
    while node is not None and node is not body.parent:
        path.append(node)
        node = node.parent
    for name in ("article", "main"):
        whole = next((n for n in path if n.tag == name), None)
        if whole is not None:
            if any(n.tag == "h1" for n in _below(whole)) or whole.parent is None:
                return [whole]
            before = [n for n in whole.parent.items if isinstance(n, Node) and not n.gone and n.tag == "h1"]
            return before[-1:] + [whole]
    threshold = min(n.density for n in path)
    marked, todo = {id(target)}, [body]
    while todo:
        node = todo.pop()
        if node.density >= threshold and not _menu(node):
            marked.add(id(node.best))
            todo.extend(t for t in node.items if isinstance(t, Node) and not t.gone)
    for node in order:  # what stands between taken siblings, their headings, and text after them belongs to them
        kids = [t for t in node.items if isinstance(t, Node) and not t.gone]
        taken = [k for k, kid in enumerate(kids) if id(kid) in marked]
        if not taken:
            continue
        first, last = taken[0], taken[-1]
        while first and kids[first - 1].tag in HEADINGS:
            first -= 1
        while last + 1 < len(kids) and kids[last + 1].tag in ("p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", *HEADINGS):
            last += 1
        marked.update(id(k) for k in kids[first : last + 1] if not _menu(k))
    found, todo = [], [body]
    while todo:
        node = todo.pop()
        if id(node) in marked:
            found.append(node)
        else:
            todo.extend(t for t in reversed(node.items) if isinstance(t, Node) and not t.gone)
    return found


def _blocks(tops: list[Node]) -> Iterator[str]:
    """White space folded, one text per run without a block boundary."""
    todo: list = list(reversed(tops))
    run: list[str] = []
    for_end = object()
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            run.append(item)
        elif isinstance(item, tuple):
            run.append(item[0])
        else:
            if run:
                yield " ".join("".join(run).split())
                run = []
            if item is not for_end and not item.gone:
                if item.parent is not None and item not in tops and item.tag in ("div", "section", "ul", "ol", "table") and _menu(item):
                    continue
                todo.append(for_end)
                todo.extend(reversed(item.items))
    if run:
        yield " ".join("".join(run).split())


def main_text(html: str | None) -> str:
    """The main text of one page; empty for a null or empty page and for one without text."""
    if not html:
        return ""
    nodes = parse(html)
    root = next((n for n in nodes if n.tag == "body"), nodes[0])
    every = [t for n in nodes for t in n.items if not isinstance(t, Node)]
    links = sum(len(t[0].strip()) for t in every if isinstance(t, tuple))
    chars = links + sum(len(t.strip()) for t in every if isinstance(t, str))
    order = measure(root, links, chars)
    if not root.chars:
        return ""
    return " ".join(b for b in _blocks(select(root, order)) if b)


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``html`` replaced by the columns text (string) and n_chars (long, its code points).

    A null or empty html, and a page that is all menus, adverts or markup, gives an empty text. Rows repeated stay repeated;
    null ids and further columns pass through, except that a column named text or n_chars is replaced. Texts are never
    cut; an empty table gives no rows.
    """
    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = pages.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            columns = [batch.column(c) for c in rest] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    return pages.select(*rest, "html").mapInArrow(run, schema)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
