"""Main text of web pages by tree scoring.

Pages become trees of their block elements. Paragraphs pass points for length and commas to their ancestors, the parent
in full and each further one a share; a container's points are discounted by its share of linked text. The best container
is kept with those siblings that look like more of the same. Elements of furniture and hidden ones never take part; what only
a name calls furniture does where it holds the page's article or most of its paragraph points, at a discount.
"""

from __future__ import annotations

import html as _entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
#: Elements whose content is no markup of the page's own, up to their end tag.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea title svg iframe math".split()}
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

#: Elements that start a block of text, and those that never hold the article.
BLOCKS = frozenset("html body div section article main header footer nav aside p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset figure figcaption h1 h2 h3 h4 h5 h6 address details summary dialog menu center hr".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset button select option label input object embed canvas head".split())
#: Inline elements of FURNITURE, which have to be followed as blocks are.
_TREE = BLOCKS | FURNITURE
_VOID = frozenset("hr input embed img br wbr meta link source track area base col param".split())
_PARAGRAPHS = frozenset("p pre blockquote td dd".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id and role that name furniture; whole words between separators.
_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay "
    "comment comments disqus respond reply replies share sharing social follow related recommended recommendations subscribe subscription newsletter signup login search pagination pager widget skip contentinfo complementary".split()
)
#: Names that speak for the article, even beside one of the above.
_CONTENT = frozenset("article articlebody body content entry main post story text maincontent".split())
#: Names of what readers add: long at times, and the article only where nothing else is.
_REPLIES = frozenset("comment comments disqus respond reply replies".split())
#: What is left of the worth of a container that a name calls furniture and none calls content.
DISCOUNT = 0.25
#: A paragraph's points reach so many containers above it.
ANCESTORS = 16
_CLOSES_P = BLOCKS - {"html", "body"}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("by_name", "children", "furniture", "linked", "named", "parent", "points", "replies", "tag")

    def __init__(self, tag: str, parent: Node | None, furniture: bool = False, named: bool = False, by_name: bool = False, replies: bool = False):
        self.tag, self.parent, self.furniture, self.named = tag, parent, furniture, named
        self.by_name, self.replies = by_name, replies  # furniture by a name alone; one for what readers add
        self.children: list[Node | str] = []
        self.linked, self.points = 0, 0.0


def _is_furniture(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool, bool, bool]:
    """(furniture, named as content, furniture by name alone, named as replies). A header is furniture unless it is that of an article."""
    if tag in FURNITURE or tag == "header" and not inside_article:
        return True, False, False, False
    if not attrs or tag in ("html", "body"):
        return False, False, False, False
    names = {w.lower() for m in _ATTR.finditer(attrs) for w in _SPLIT.split(m[1] or m[2] or m[3] or "") if w}
    named = bool(names & _CONTENT)
    bad = bool(names & _NAMES) and not (named and tag in ("article", "main")) or "header" in names and not inside_article
    hidden = bool(_HIDDEN.search(attrs))
    return bad or hidden, named, bad and not hidden, bool(names & _REPLIES)


class _Ends:
    """Where tags end: at the first > outside quotes. What is found for one place holds for all places that lead there, so a page costs its length however many tags it leaves open."""

    def __init__(self, page: str):
        self.page, self.known = page, {}
        self.seen = range(0)  # from each of these places the next of > " and ' is at its end
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def _stop(self, at: int) -> int:
        if at not in self.seen:
            m = _STOP.search(self.page, at)
            self.seen = range(at, (m.start() if m else len(self.page)) + 1)
        return self.seen[-1]

    def of(self, at: int) -> int:
        """The place after the tag whose attributes begin at `at`; -1 if it never ends."""
        passed = []
        while True:
            stop = self._stop(at)
            if stop >= len(self.page) or self.known.get(stop) == -1:
                end = -1
                break
            if stop in self.known:
                end = self.known[stop]
                break
            passed.append(stop)
            quote = self.page[stop]
            if quote == ">":
                end = stop + 1
                break
            if stop >= self.last[quote]:
                end = -1
                break
            at = self.page.find(quote, stop + 1) + 1
        self.known.update(dict.fromkeys(passed, end))
        return end

    def plain(self, at: int) -> int:
        """The place after the next >, quotes or not."""
        return self.page.find(">", at) + 1 if at <= self.last[">"] else -1


def pieces(page: str) -> Iterator[tuple[str | None, str, bool]]:
    """(tag in small letters, attributes, whether it ends) of each tag, (None, text, False) of each text, comments and raw elements left out. A < that starts nothing is text."""
    at, size, ends = 0, len(page), _Ends(page)
    while at < size:
        begin = page.find("<", at)
        if begin != at:
            yield None, page[at:begin] if begin > 0 else page[at:], False
            if begin < 0:
                return
        at = begin + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = end + 3 if end >= 0 else size
        elif (m := _TAG.match(page, begin)) is not None:
            end = ends.of(m.end())
            if end < 0:
                yield None, "<", False
                continue
            tag, attrs, closing = m[1].lower(), page[m.end() : end - 1], page[at] == "/"
            at = end
            if tag not in _RAW:
                yield tag, attrs, closing
            elif not closing and not (attrs.endswith("/") and tag in ("svg", "math")):
                close = _RAW[tag].search(page, end)
                at = close.end() if close else size
        elif page[at : at + 1] in ("!", "?", "/") and (end := ends.plain(at)) > 0:
            at = end
        else:
            yield None, "<", False


def parse(page: str) -> Node:
    """The tree of block elements; texts are strings between them, decoded. Unclosed and stray tags are borne."""
    root = at = Node("root", None)
    links = 0
    open_: Counter[str] = Counter()

    def leave(upto: Node) -> Node:
        nonlocal at
        while at is not upto:
            open_[at.tag] -= 1
            at = at.parent
        return at

    for tag, text, closing in pieces(page):
        if tag is None:
            if "&" in text:
                text = _entities.unescape(text)
            at.children.append(text)
            if links:
                at.linked += len(text.strip())
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            at.children.append("\n")
        elif tag not in _TREE:
            continue
        elif closing:
            if open_[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
                links = 0
        else:
            if tag in _CLOSES_P and (at.tag == "p" or at.tag in _HEADINGS and tag in _HEADINGS | {"p"}):
                leave(at.parent)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and at.tag in ({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}):
                leave(at.parent)
            node = Node(tag, at, *_is_furniture(tag, text, open_["article"] + open_["main"] > 0))
            at.children.append(node)
            if tag not in _VOID and not text.endswith("/"):
                at = node
                open_[tag] += 1
    return root


def _own(n: Node) -> str:
    return " ".join("".join(c for c in n.children if isinstance(c, str)).split())


def _points(n: Node, own: str) -> float:
    """Points of a node's own text."""
    if own and (n.tag in _PARAGRAPHS or n.tag not in _HEADINGS | {"li"}) and min(n.linked, len(own)) < 0.5 * len(own):
        return 1 + own.count(",") + own.count("，") + min(len(own) / 100, 3)
    return 0.0


def _readmit(root: Node) -> tuple[dict[Node, float], dict[Node, int]]:
    """Furniture by name alone takes part where it holds the page's only articles or most of the paragraph points; replies only where there is nothing else. Returns the points and articles below each node, if there are such names."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in reversed(n.children) if not isinstance(c, str) and (c.by_name or not c.furniture))
    if not any(n.by_name for n in order):
        return {}, {}
    inside: dict[Node, float] = {}  # points below a node that aren't replies, or all below replies
    articles: dict[Node, int] = {}
    for n in reversed(order):
        below = [c for c in n.children if c in inside]
        open_ = [c for c in below if n.replies and n.by_name or not (c.by_name and c.replies and not c.named)]
        inside[n] = _points(n, _own(n)) + sum(inside[c] for c in open_)
        articles[n] = (n.tag in ("article", "main") and not n.by_name) + sum(articles[c] for c in open_)
    total, total_articles = inside[root], articles[root]
    for n in order:
        if n.by_name and n.furniture:
            if n.replies and not n.named:
                n.furniture = total > 0 or inside[n] <= 0
            else:
                n.furniture = not (inside[n] > 0.5 * total or total_articles and articles[n] == total_articles)
    return inside, articles


def _drop_outweighed(best: Node, inside: dict[Node, float], articles: dict[Node, int]) -> None:
    """What a name calls furniture goes from the best container if the rest of that is the article, points being discounted."""
    stack = [c for c in best.children if not isinstance(c, str)]
    while stack:
        n = stack.pop()
        if n.by_name and not n.furniture and not n.named and not articles[n] and inside[best] - inside[n] >= DISCOUNT * inside[n]:
            n.furniture = True
        if not n.furniture:
            stack.extend(c for c in n.children if not isinstance(c, str))


def _discounts(order: list[Node]) -> dict[Node, float]:
    """The share of its worth that each container keeps, as the names of it and of those around it say."""
    keeps: dict[Node, float] = {}
    for n in order:
        keeps[n] = keeps.get(n.parent, 1.0) * (DISCOUNT if n.by_name and not n.named else 1.0)
    return keeps


def _measure(node: Node, sums: dict[Node, tuple[int, int]]) -> list[Node]:
    """Points for all containers below node; sums gets (characters, linked characters). Returns them in page order."""
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in reversed(n.children) if not isinstance(c, str) and not c.furniture)
    for n in reversed(order):
        own = _own(n)
        chars, linked = len(own), min(n.linked, len(own))
        if points := _points(n, own):
            up, share = (n.parent if n.tag in _PARAGRAPHS else n), 1.0
            depth = 0
            left = DISCOUNT if up is not n and n.by_name and not n.named else 1.0
            while up is not None and depth < ANCESTORS:
                up.points += points * share * left
                depth += 1
                share = 0.5 if depth == 1 else 1 / (3 * depth)
                left *= DISCOUNT if up.by_name and not up.named else 1.0
                up = up.parent
        for c in n.children:
            if not isinstance(c, str) and not c.furniture:
                chars, linked = chars + sums[c][0], linked + sums[c][1]
        sums[n] = chars, linked
    return order


def _blocks(node: Node) -> list[str]:
    """The texts of the blocks below node in page order; text between two blocks is one."""
    out: list[str] = []
    buffer: list[str] = []

    def close() -> None:
        if text := " ".join("".join(buffer).split()):
            out.append(text)
        buffer.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        n = stack.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            buffer.append(n)
        elif not n.furniture or n is node:
            close()
            stack.append(None)
            stack.extend(reversed(n.children))
    close()
    return out


def main_text(page: str) -> str:
    """The article of a page: its blocks in page order, white space inside each turned into single spaces, joined by two line ends. Empty if there is none."""
    root = parse(page)
    inside, articles = _readmit(root)
    sums: dict[Node, tuple[int, int]] = {}
    order = _measure(root, sums)
    keeps = _discounts(order)

    def worth(n: Node) -> float:
        chars, linked = sums[n]
        bonus = 1.5 if n.tag in ("article", "main") else 1.25 if n.named else 1.0
        return n.points * keeps[n] * bonus * (1 - linked / chars) if chars else 0.0

    scored = [n for n in order if n.points > 0 and n.tag not in _HEADINGS]
    if not scored:
        body = next((n for n in order if n.tag in ("article", "main")), None)
        return "\n\n".join(_blocks(body)) if body is not None else ""
    best = max(scored, key=worth)
    up = best
    while up.parent is not None and up.tag not in ("article", "main"):  # a section of an article stands for the article
        up = up.parent
    if up.parent is not None or up.tag in ("article", "main"):
        best = up
    if best.tag in _PARAGRAPHS and best.parent is not None:
        best = best.parent
    if inside:
        _drop_outweighed(best, inside, articles)
    bar, out = max(4.0, 0.2 * worth(best)), []
    for n in best.parent.children if best.parent is not None else [best]:
        if n is best:
            out += _blocks(n)
        elif isinstance(n, Node) and not n.furniture and best.tag not in ("body", "html"):
            chars, linked = sums[n]
            own = " ".join("".join(c for c in n.children if isinstance(c, str)).split())
            if worth(n) >= bar or n.tag == "p" and chars and linked < 0.25 * chars and (len(own) > 80 or own.endswith((".", "!", "?"))) or n.tag in _HEADINGS and chars and not linked:
                out += _blocks(n)
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns in keep, text, n_chars (code points) per row of pages, from whole pages. Null and empty pages give empty texts; repeated rows stay; other columns are not read."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(p) for p in b], dtype=object)

    got = pages.select(id_col, *keep, F.pandas_udf(work, "string")(text_of(html_col)).alias("text"))
    return got.select(id_col, *keep, "text", F.char_length("text").cast("bigint").alias("n_chars"))
