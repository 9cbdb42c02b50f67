"""Main text of web pages by composite text density.

A page becomes a tree of elements. Scripts, styles, forms, navigation, page headers and footers, asides and
elements whose role, class or id names a menu, sidebar, notice, advert or reader comments are taken
out, as are blocks that are lists of links. Inside ``article`` and ``main`` a name counts only if all words of a class or id are
such names and not one that text has too (``id="discussion"``), and lists of links stay. For each element left, the density is

    C / T * log(C / LC * T / LT) / log(ln(C / nLC * LC + LCb / Cb * C + e))

with its characters C and tags T, those in links LC and LT, the rest nLC, and those of the body LCb and Cb. An element's density sum
adds up the densities of its children. The element with the largest sum is the core; the least density on the path from
the body to it is the threshold. Elements beside that path which reach the threshold belong to the text as well, with the element of
largest sum below them. The text is that of the smallest subtree that holds all of these, or of the
article element around it: nothing more is left out of it.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by one space.

Defined cases: null and empty pages, and pages without text, give an empty text. Broken markup is read leniently (unclosed and
stray tags, unclosed comments); nesting of any depth works. Rows are read alone, so repeated rows get equal texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
NO_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre "
    "search section summary table ul".split())
#: Elements that a start tag of the same group closes, up to the element that holds the group.
GROUPS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
OUT_TAGS = frozenset("head nav footer aside form button select input dialog svg canvas object audio video menu".split()) | RAW
OUT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promoted promotion sidebar aside widget widgets related recommended recommendations trending "
    "popular share sharing social follow menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments commentlist reply replies respond disqus discussion "
    "footer footnav colophon copyright cookie cookies consent gdpr notice notices notification banner alert popup modal overlay toast newsletter subscribe subscription signup login "
    "paywall disclaimer masthead topbar toolbar".split())
#: Of these the ones that name parts of a text as well; inside an article they decide nothing on their own.
TEXT_NAMES = frozenset(
    "related recommended recommendations trending popular follow replies respond discussion copyright consent notice notices alert disclaimer footer aside promotion sharing overlay pager toast".split())
KEPT = frozenset({"html", "body", "article", "main"})
ARTICLE_NAMES = frozenset({"article", "post", "entry", "content", "story"})


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "out", "chars", "tags", "link_chars", "link_tags", "sum", "density", "holds", "within")

    def __init__(self, tag: str, tokens: tuple[frozenset[str], ...] = (), parent: Node | None = None, out: bool = False):
        self.tag, self.tokens, self.parent, self.children, self.out, self.within = tag, tokens, parent, [], out, False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.sum = self.density = 0.0
        self.holds = False


def _attributes(written: str) -> tuple[tuple[frozenset[str], ...], bool]:
    """The words of each class and of the id, and whether the element is hidden or has the role of a page frame."""
    tokens, out = [], False
    for m in _ATTRIBUTE.finditer(written):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            tokens += [frozenset(words) for token in value.split() if (words := _NAME.findall(token))]
        elif key == "role":
            out = out or value in OUT_ROLES
        elif key == "style":
            out = out or "display:none" in value.replace(" ", "")
        else:
            out = out or (key == "hidden" and written[m.start() - 1 : m.start()].isspace()) or (key == "aria-hidden" and value == "true")
    return tuple(tokens), out


def parse(html: str) -> list[Node]:
    """All elements in page order; the first is the root."""
    root = Node("#root")
    nodes, stack, at, low = [root], [root], 0, None
    find = _TOKEN.search
    while m := find(html, at):
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table") and tag in INLINE | {"p", "li"}:
                    break
            else:
                if tag in ("p", "br"):
                    stack[-1].children.append(Node("br", parent=stack[-1]))
            continue
        if tag in NO_P:
            _close(stack, frozenset({"p"}), frozenset({"table", "td", "th", "button", "object"}))
        if tag in GROUPS:
            _close(stack, *GROUPS[tag])
        written = m[3] if m[2] else m[6]
        tokens, out = _attributes(written) if "=" in written or "hidden" in written else ((), False)
        node = Node(tag, tokens, stack[-1], out)
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            low = html.lower() if low is None else low
            end = low.find(f"</{tag}", at) if len(low) == len(html) else html.find(f"</{tag}", at)
            at = len(html) if end < 0 else end  # the end tag is read, and finds its element below
            if end >= 0:
                stack.append(node)
        elif tag not in VOID and not written.endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag not in ("svg", "path"):
            stack.append(node)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return nodes


def _close(stack: list[Node], tags: frozenset[str], within: frozenset[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in within:
            return


def _prune(nodes: list[Node]) -> None:
    """Mark what belongs to the page frame."""
    for n in reversed(nodes):
        if n.parent is not None and (n.holds or n.tag in ("article", "main", "h1")):
            n.parent.holds = True
    for n in nodes:
        up = n.parent
        inside = up is not None and up.within
        n.within = inside or n.tag in ("article", "main")
        n.out = n.out or bool(up is not None and up.out) or n.tag in OUT_TAGS
        if n.out or n.tag in KEPT:
            continue
        names = frozenset().union(*n.tokens)
        if n.tag == "header" or "header" in names:
            n.out = not n.within and not n.holds and not names & ARTICLE_NAMES
        if inside:
            n.out = n.out or any(t <= OUT_NAMES and not t <= TEXT_NAMES for t in n.tokens) and not n.holds
        elif names & OUT_NAMES:
            n.out = not n.holds


def _measure(nodes: list[Node]) -> None:
    """Counts of each element, from the leaves up, and link lists taken out."""
    links: dict[int, int] = {}
    for n in reversed(nodes):
        if n.out:
            continue
        n.chars += sum(len(" ".join(c.split())) for c in n.children if isinstance(c, str))
        if n.tag == "a":
            n.link_chars = n.chars
        many = links.get(id(n), 0)
        listed = n.tag in ("ul", "ol", "div", "p", "table", "section", "dl") and not n.within and not n.holds
        if listed and many >= 3 and n.link_chars >= 0.6 * n.chars:
            n.out = True
            continue
        if n.parent is not None:
            up = n.parent
            up.chars += n.chars
            up.tags += n.tags + 1
            up.link_chars += n.link_chars
            up.link_tags += n.link_tags + (n.tag == "a")
            links[id(up)] = links.get(id(up), 0) + many + (n.tag == "a")


def _densities(nodes: list[Node], body: Node) -> None:
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        if n.out or not n.chars:
            continue
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * lc + share * c + math.e)
        n.density = c / t * max(0.0, math.log(c / lc * t / lt)) / math.log(base)
        if n.parent is not None:
            n.parent.sum += n.density


def _chosen(nodes: list[Node], body: Node) -> list[Node]:
    """The core, and what reaches the threshold beside the path to it."""
    live = [n for n in nodes if not n.out and n.chars]
    at = {id(n): i for i, n in enumerate(nodes)}
    last = {}
    for i in range(len(nodes) - 1, -1, -1):  # last element of each subtree
        last.setdefault(i, i)
        up = nodes[i].parent
        if up is not None:
            last[at[id(up)]] = max(last.get(at[id(up)], at[id(up)]), last[i])
    inner = [n for n in live if at[id(body)] <= at[id(n)] <= last[at[id(body)]]]
    if not inner:
        return []
    core = max(inner, key=lambda n: (n.sum, n.density, -at[id(n)]))
    path, n = [], core
    while n is not None:
        path.append(n)
        n = None if n is body else n.parent
    least = min(p.density for p in path)
    on = {id(p) for p in path}
    chosen = [core]
    for p in path[1:]:
        for child in p.children:
            if isinstance(child, Node) and not child.out and child.chars and id(child) not in on and child.density >= least:
                chosen.append(child)
    return chosen


def _text(root: Node) -> str:
    """Blocks of a subtree in page order."""
    blocks, run, todo = [], [], [root]
    while todo:
        n = todo.pop()
        if n is None:
            blocks.append("".join(run))
            run.clear()
        elif isinstance(n, str):
            run.append(unescape(n))
        elif not n.out:
            if n.tag in INLINE:
                todo += reversed(n.children)
            else:
                blocks.append("".join(run))
                run.clear()
                todo.append(None)
                todo += reversed(n.children)
    blocks.append("".join(run))
    return " ".join(t for b in blocks if (t := " ".join(b.split())))


def main_text(html: str) -> str:
    nodes = parse(html)
    _prune(nodes)
    _measure(nodes)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    if body.out or not body.chars:
        body = nodes[0]
    _densities(nodes, body)
    chosen = _chosen(nodes, body)
    if not chosen:
        return ""
    ways = []
    for n in chosen:
        way = []
        while n is not None:
            way.append(n)
            n = n.parent
        ways.append(way[::-1])
    root = nodes[0]
    for level in zip(*ways, strict=False):
        if any(n is not level[0] for n in level):
            break
        root = level[0]
    n = root
    while n is not None:
        if n.tag in ("article", "main"):
            root = n
            break
        n = n.parent
    return _text(root)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((h or b"").decode("utf-8", "replace")) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
