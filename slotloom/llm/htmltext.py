"""Main text of web pages by composite text density.

A page becomes a tree of block elements (comments, scripts, styles and other raw parts left out; inline elements such as
``b`` or ``a`` count as tags and links of the block that holds them). For every node i with C characters, T tags, LC
characters and LT tags in links, the composite text density is

    (C / T) * log_b(C * T / (LC * LT)),   b = ln(C * LC / (C - LC) + LC_body * C / C_body + e)

with zero counts read as one. A node's density sum adds up its children's densities. The node with the largest sum
(ties: the first on the page) is the heart of the article, and the least density on its path to the body is the threshold.
The article is the lowest ancestor of that node that holds all further parts of it, whole. Beside the path, headings,
paragraphs, lists, tables and the like are parts unless half or more of their text stands in links; text that stands in a
plain container is in doubt and a part only where it reaches the threshold and is no thinner than half of the path's node
beside it. Density decides alone, without regard to ``article`` or ``main``.

Elements that are told by tag or role to be menus, headers, footers, sidebars, notices, adverts, forms or comment sections
count nothing, nor do those with a class or id made up of such names alone (``ad``, ``comment-list``). A name with other
words in it (``discussion-of-results``) only decides for nodes below the threshold beside the path. Where names leave no
text at all, they are disregarded.

Null and empty pages, and pages without text, give an empty text. Unclosed and misnested tags are closed where the next
block needs it; a quote that is never closed is an ordinary sign. Very long pages are read
whole. Repeated rows each get their row; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_SPECIAL = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[a-z]+|\d+")

# Fixed values of the HTML language: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"])}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"])}
# What marks other matter than the article.
OTHER_TAGS = frozenset("nav footer aside form button menu search dialog head".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "disqus reply replies respond discussion pagination pager toolbar skip".split()
)
#: Words that say nothing beside another name.
PLAIN_NAMES = frozenset(
    "area bar block body bottom box button buttons by card cards col column container count content entry footer form group head header heading icon icons id inline inner "
    "item items js label large left link links list main media message messages mobile new on outer page pane panel post posts reader readers right row section site slot small "
    "space stories story text the this thread title to top unit user users view wrap wrapper your".split()
)
# Fixed values of the HTML language: elements that hold prose.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header ul ol li dl dt dd table blockquote pre figure figcaption details summary address".split())


class Node:
    __slots__ = ("tag", "kids", "up", "other", "named", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, up: Node | None, other: bool = False):
        self.tag, self.up, self.other, self.named, self.kids = tag, up, other, False, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0

    def block(self) -> bool:
        return self.tag in BLOCK


def _is_other(tag: str, attrs: str, inside_article: bool, names: bool) -> tuple[bool, bool]:
    """(whether an element is other matter, whether its class or id hints at it)."""
    if tag in OTHER_TAGS or tag == "header" and not inside_article:
        return True, False
    if tag in ("body", "html", "article", "main") or not attrs or not names:
        return False, False
    hint = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in OTHER_ROLES:
            return True, False
        if name in ("class", "id") and tag in BLOCK | {"span", "a", "ins"}:
            for part in value.split():
                words = [w for w in _WORD.findall(part) if not w.isdigit()]
                if not OTHER_NAMES.isdisjoint(words):
                    hint = True
                    if all(w in OTHER_NAMES or w in PLAIN_NAMES for w in words):
                        return True, True
    return False, hint


class _Tags:
    """Ends of tags: the first ``>`` outside quotes. Places that are known to lead nowhere are remembered, so the time is
    linear in the page however many tags stay open."""

    def __init__(self, page: str):
        self.page, self.lost, self.seen = page, set(), (0, -1)
        self.last = {q: page.rfind(q) for q in "\"'"}

    def _next(self, at: int) -> int:
        """The next ``>`` or quote, or -1."""
        lo, hit = self.seen
        if not lo <= at <= (hit if hit >= 0 else -1):
            m = _SPECIAL.search(self.page, at)
            self.seen = at, m.start() if m else len(self.page)
        return self.seen[1] if self.seen[1] < len(self.page) else -1

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag read up to ``at``, or -1."""
        passed = []
        while (i := self._next(at)) >= 0 and i not in self.lost:
            c = self.page[i]
            if c == ">":
                return i
            passed.append(i)
            at = i + 1 if self.last[c] <= i else self.page.index(c, i + 1) + 1
        self.lost.update(passed)
        return -1


def parse(page: str, names: bool = True) -> Node:
    """The tree below an ``html`` node; text is held as strings among the children. names: whether roles, classes and ids
    tell other matter."""
    root = Node("html", None)
    at, body, end = root, Node("body", root), 0
    root.kids.append(body)
    at = body
    head = False
    articles = 0
    n, tags, look = len(page), _Tags(page), 0
    while end < n:
        m = _TOKEN.search(page, max(end, look))
        close = tags.end(m.end()) if m and m[2] else -1
        if m and m[2] and close < 0:
            look = m.start() + 1
            continue
        text = page[end : m.start() if m else n]
        if text and not head:
            at.kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        end = close + 1 if m[2] else m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), page[m.end() : close]
        if m[1]:
            if tag == "head":
                head = False
            elif tag not in ("html", "body"):
                x = at
                while x is not body and x.tag != tag:
                    x = x.up
                if x is not body:
                    at = x.up
                    if tag == "article":
                        articles -= 1
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, end)
            end = close.end() if close else n
            continue
        if tag == "head":
            head = True
            continue
        if tag in ("html", "body", "meta", "link", "base") and tag != "br":
            if tag == "body":
                head = False
            continue
        head = False
        x, limit = at, SCOPE.get(tag, frozenset())
        while x is not body and x.tag not in limit:
            if tag in CLOSED_BY.get(x.tag, ()):
                at = x.up
                if x.tag != "p":
                    break
            elif x.tag in BLOCK and x.tag != "p":
                break
            x = x.up
        other, hint = _is_other(tag, attrs, articles > 0, names)
        node = Node(tag, at, other)
        node.named = hint
        at.kids.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            at = node
            articles += tag == "article"
    return body


def children(x: Node) -> list[Node]:
    """The block nodes right below x: inline elements are looked through."""
    out, stack = [], list(reversed(x.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str) or k.other:
            continue
        if k.block():
            out.append(k)
        else:
            stack += reversed(k.kids)
    return out


def measure(body: Node) -> None:
    """Counts of all nodes, densities and sums of the blocks, children first."""
    order, stack = [], [body]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in x.kids if not isinstance(k, str) and not k.other]
    for x in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(" ".join(k.split()))
            elif not k.other:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars
    share = body.link_chars / max(1, body.chars)
    for x in reversed(order):
        c, t = x.chars, max(1, x.tags)
        if c and x.block():
            lc, lt, rest = max(1, x.link_chars), max(1, x.link_tags), max(1, c - x.link_chars)
            base = math.log(c * lc / rest + share * c + math.e)
            x.density = c / t * math.log(c * t / (lc * lt)) / math.log(base) if base > 1 and c * t > lc * lt else 0.0
            x.sum = sum(k.density for k in children(x))


def _best(x: Node) -> Node:
    """The block below x, or x, of the largest sum; the first of equals."""
    best, stack = x, [x]
    while stack:
        y = stack.pop()
        if y.sum > best.sum:
            best = y
        stack += reversed(children(y))
    return best


def _part(x: Node, threshold: float, beside: float) -> bool:
    """Whether a node beside the path, with text, is a part of the article; what is none inside it is marked. beside: the
    density of the path's node next to it."""
    found, stack = False, [x]
    while stack:
        y = stack.pop()
        inner = [k for k in y.kids if not isinstance(k, str) and not k.other and k.chars]
        if 2 * y.link_chars >= y.chars or y.named and y.density < threshold:
            y.other = True
        elif y.tag in PROSE or not y.block():
            found = True
        elif any(k.block() for k in inner):
            # A container: its parts are judged, text that stands right in it goes with them.
            stack += inner
        elif y.density >= threshold and 2 * y.density >= beside:
            found = True
        else:
            y.other = True
    x.other = x.other or not found
    return found


def select(body: Node) -> list[Node]:
    """The subtree that holds the article; what is no part of it there is marked as other matter."""
    measure(body)
    best = _best(body)
    threshold, x = min(best.density, body.density), best
    while x is not body:
        threshold = min(threshold, x.density) if x.block() else threshold
        x = x.up
    top, x = best, best
    while x is not body:
        for k in x.up.kids:
            if k is not x and not isinstance(k, str) and not k.other and k.chars and _part(k, threshold, x.density):
                top = x.up
        x = x.up
    return [top]


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the block elements below some nodes."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    for root in roots:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif not x.other or x is root:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                elif x.tag in ("br", "td", "th"):
                    run.append(" ")
                stack += reversed(x.kids)
        flush()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(blocks(select(parse(page))) or blocks(select(parse(page, names=False))))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    kinds = dict(pages.select(id_col, url_col).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
