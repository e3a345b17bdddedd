"""HTML extraction by tree scoring.

Each paragraph gives points (one, one for each comma, and one for each 100 characters, three at most)
to its parent and half of them to its grandparent; a container's score is discounted by the share of its text that is in
links. The best container is kept, and the whole article that it lies in. Of the rest of the main element (where
there is none: of the siblings) all is kept but lists of links: blocks, and runs of text and inline elements, half of
whose text or more is in links and that score little.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_batch, table

#: Quotes hold an attribute's value only right behind its equals sign; elsewhere they are letters like others.
VALUES = r"""=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s>"'][^\s>]*|[^>]"""
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:{VALUES})*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")
#: Fixed names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote dd li h1 h2 h3 h4 h5 h6".split())
UNWANTED = frozenset("head nav header footer aside form button select option input dialog menu svg math canvas object audio video map".split()) | RAW
CLOSES_P = BLOCKS - {"body", "html"}
#: Words in class, id or role that mark what is no article. They count in compounds too (comment-body, mainNav).
UNWANTED_WORDS = frozenset("ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies disqus footer form header hidden masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split())
#: A compound with one of these is about the page's layout or a filing of the article, not about the element: has-sidebar, category-ads.
LAYOUT_WORDS = frozenset("has with without no category tag status type format".split())
#: Of an article element only these words at a compound's start count: reader comments and adverts are articles too.
UNWANTED_ARTICLES = frozenset("ad advert comment comments promo related reply replies sponsored".split())
#: A block outside the article that starts so is a footer without a mark.
COPYRIGHT = re.compile(r"(©|\(c\)|copyright\b)", re.I)


@dataclass(eq=False)
class Node:
    tag: str
    parent: "Node | None" = None
    attributes: str = ""
    children: list = field(default_factory=list)
    score: float = 0.0
    chars: int = 0
    link_chars: int = 0

    def compounds(self) -> list[list[str]]:
        """The words of each class, id and role."""
        found = " ".join(a or b or c for n, a, b, c in ATTRIBUTE.findall(self.attributes) if n.lower() in ("class", "id", "role"))
        return [[w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) if w] for x in found.split()]

    def hidden(self) -> bool:
        return bool(self.attributes) and any(n.lower() == "hidden" or n.lower() == "aria-hidden" and (a or b or c).lower() == "true" or n.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (a or b or c).lower()) for n, a, b, c in ATTRIBUTE.findall(self.attributes))


def unwanted(node: Node) -> bool:
    if node.tag in UNWANTED or node.hidden():
        return True
    if node.tag in ("html", "body", "main") or not node.attributes:
        return False
    if node.tag == "article":
        return any(words and words[0] in UNWANTED_ARTICLES for words in node.compounds())
    return any(not UNWANTED_WORDS.isdisjoint(words) and LAYOUT_WORDS.isdisjoint(words) for words in node.compounds())


def parse(source: str) -> Node:
    """The tree of a page, without unwanted parts; tolerant of tags that are not closed."""
    root = Node("html")
    at, skip, place = root, 0, 0
    pos = 0
    end = len(source)

    def text(lo: int, hi: int) -> None:
        if not skip and hi > lo:
            at.children.append(entities.unescape(source[lo:hi]))

    skipped: list[str] = []  # open tags inside an unwanted part; the first is the part's own
    while place < end:
        m = TAG.search(source, place)
        if not m:
            break
        text(pos, m.start())
        pos = place = m.end()
        if m[0].startswith("<![CDATA["):
            if not skip:
                at.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if skip:
                if tag in skipped:
                    while skipped.pop() != tag:
                        pass
                    skip = len(skipped)
                elif _open(at, tag) and tag in BLOCKS:  # the part was never closed
                    skipped.clear()
                    skip = 0
                    at = _close(at, tag)
            elif tag == "br" or tag == "p" and not _open(at, "p"):
                at.children.append(" ")
            else:
                at = _close(at, tag)
            continue
        alone = tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS
        if tag in RAW and not alone:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, pos)
            pos = place = close.end() if close else end
            continue
        if skip:
            if not alone:
                if tag in skipped[1:] and tag in ("p", "li", "td", "tr", "option", "dd", "dt"):
                    while skipped.pop() != tag:
                        pass
                skipped.append(tag)
                skip = len(skipped)
            continue
        if tag in ("html", "body") and _open(at, tag):
            if tag == "html":
                continue
            continue
        if tag in CLOSES_P and _open(at, "p"):
            at = _close(at, "p")
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            at = _implied(at, tag)
        node = Node(tag, at, m[3])
        if tag in ("br", "hr", "wbr"):
            at.children.append("" if tag == "wbr" else " ")
        elif alone:
            pass
        elif unwanted(node):
            skipped.append(tag)
            skip = 1
            at.children.append(Node("hr", at) if tag in BLOCKS or tag in UNWANTED else " ")
        else:
            at.children.append(node)
            at = node
    text(pos, end)
    return root


def _open(at: Node, tag: str) -> bool:
    n: Node | None = at
    while n is not None:
        if n.tag == tag:
            return True
        if tag == "p" and n.tag in ("td", "th", "table", "li", "article", "section", "div", "body"):
            return False
        n = n.parent
    return False


def _close(at: Node, tag: str) -> Node:
    """Closes the nearest open ``tag``, not beyond the block that an inline tag is in."""
    n: Node | None = at
    while n is not None and n.parent is not None:
        if n.tag == tag:
            return n.parent
        if tag not in BLOCKS and n.tag in BLOCKS:
            return at
        n = n.parent
    return at


def _implied(at: Node, tag: str) -> Node:
    same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
    stop = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}[tag]
    n: Node | None = at
    out = at
    while n is not None and n.tag not in stop:
        if n.tag in same and n.parent is not None:
            out = n.parent
        n = n.parent
    return out


def _order(root: Node) -> list[Node]:
    """All nodes, parents first; without recursion, as pages can be deep."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def best_container(root: Node) -> list[Node]:
    """The kept nodes in page order: the best container and what belongs to it."""
    nodes = _order(root)
    own: dict[int, list[str]] = {}
    for n in reversed(nodes):
        n.chars = sum(len(SPACE.sub(" ", c).strip()) if isinstance(c, str) else c.chars for c in n.children)
        n.link_chars = n.chars if n.tag == "a" else sum(c.link_chars for c in n.children if isinstance(c, Node))
        own[id(n)] = [c for c in n.children if isinstance(c, str)]
    for n in nodes:
        text = None
        if n.tag in PARAGRAPHS:
            text = _flat(n)
        elif n.tag in BLOCKS and any(c.strip() for c in own[id(n)]):  # bare text in a container is a paragraph of it
            text = " ".join(c for c in own[id(n)])
        if text is None or not (size := len(SPACE.sub(" ", text).strip())):
            continue
        points = (1 + text.count(",") + min(size // 100, 3)) * (1 - n.link_chars / max(n.chars, 1))
        up = n.parent if n.tag in PARAGRAPHS else n
        for share in (1.0, 0.5):
            if up is None:
                break
            up.score += points * share
            up = up.parent
    scored = [(n, n.score * (1 - n.link_chars / max(n.chars, 1))) for n in nodes if n.score]
    if not scored:
        return [root]
    best, most = max(scored, key=lambda x: x[1])  # the first of equal ones: the outer
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    # an article that holds the best container is kept whole; of a main element, or else of the parent, what is no list of links
    whole = next((n for n in reversed(above) if n.tag == "article"), best)
    top = next((n for n in reversed(above) if n.tag == "main" or n is whole), whole)
    if top is whole and top.tag != "main" and top.parent is not None:
        top = top.parent
    if top is whole:
        return [whole]
    path = {id(n) for n in above}
    scores = {id(n): s for n, s in scored}
    kept: list[Node] = []
    inline: list = []

    def flush() -> None:  # bare text and inline elements between two blocks are one paragraph
        run = Node("span", children=inline[:])
        inline.clear()
        chars = sum(len(SPACE.sub(" ", c).strip()) if isinstance(c, str) else c.chars for c in run.children)
        if 2 * sum(c.link_chars for c in run.children if isinstance(c, Node)) < chars:
            kept.append(run)

    todo: list = [top]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            inline.append(c)
        elif id(c) in path and c is not whole:
            flush()
            todo.append(None)
            todo.extend(reversed(c.children))
        elif c is not whole and c.tag not in BLOCKS and not any(n.tag in BLOCKS for n in _order(c)):
            inline.append(c)
        else:
            flush()
            if c is not whole and COPYRIGHT.match(SPACE.sub(" ", _flat(c)).strip()):
                continue
            if c is whole or 2 * c.link_chars < c.chars or scores.get(id(c), 0) >= max(10.0, 0.2 * most):
                kept.append(c)
    flush()
    return kept


def _flat(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo.extend(reversed(n.children))
    return "".join(out)


def blocks(kept: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space made one space."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    for top in kept:
        todo: list = [top]
        while todo:
            n = todo.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                held.append(n)
            elif n.tag in BLOCKS:
                flush()
                todo.append(None)
                todo.extend(reversed(n.children))
            else:
                todo.extend(reversed(n.children))
        flush()
    return out


def main_text(source: str | None) -> str:
    return " ".join(blocks(best_container(parse(source)))) if source and source.strip() else ""


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but html, and ``text`` and ``n_chars``.

    Null, empty and blank html gives '' and 0, as does a page of only unwanted parts. Text without
    any tag is one block. Character references are decoded once. Equal rows give equal results; an
    empty table an empty result. Input columns named text or n_chars are replaced. Pages are read whole.
    """
    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) for h in batch.column(len(rest)).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], [*rest, "text", "n_chars"])

        return f

    rows = pages.select(*rest, "html")
    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")
    return by_batch(rows, make, schema)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
