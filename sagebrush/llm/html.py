"""Main text of web pages by scoring the tree.

The markup is read into a tree that mends unclosed tags. Subtrees that are no article are cut: menus, site headers,
footers, scripts, forms, and boxes whose class or id says advert, notice, comment and the like. What a name says is
weighed against what a box holds: a box around an article or main element is opened, so is a form or fieldset that
holds more text than the page outside of it, and a box with the name of a layout part (sidebar, header, menu) that
holds nearly all unlinked text of the page. Boxes of reader comments, adverts and consent are opened by a main element
only. A header inside an article belongs to it, and so does a headline in a box around both. Headings, paragraphs and
other running text are judged by a class, and any element by an id, only where all words of the name tell of such boxes:
ids of headings are made of their words.

Every block of text passes points to its ancestors, for its length and its commas: all to the parent, half to the
next, a third to the third. A container's points are discounted by its share of link text. The best container is kept,
raised to the article or main element around it; of several articles side by side all are kept that are not mostly
links. Without one, the best container's siblings are kept, too, however short, but for noise and for those of much
link text that don't score well themselves. Blocks come in page order, character references decoded, white space made
one space, joined by newlines.

A null or empty page has an empty text, so has one without text. Very long pages are read whole in one pass. Of
containers with equal points the first in page order is the best. Repeated rows get equal answers. An empty table gives
an empty result. Extra columns pass the operator `extract` unread, whatever their names (`text` and `n_chars` replace
columns of those names).
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*)>|<[!?/][^>]*>""", re.S
)
#: An attribute, from the left, so that no value is read as a name.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea title canvas".split())
NOISE = frozenset("nav header footer aside button select option dialog menu head label".split())
#: Elements of running text: what they are named tells of their words, not of a place on the page.
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p li dl dt dd blockquote figure figcaption pre section table tr td th em strong span".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMS = frozenset(("form", "fieldset"))
MAIN = frozenset(("article", "main"))
#: A footer in a quotation names its author; a label in a paragraph is of its words.
QUOTES, PARAGRAPHS = frozenset(("blockquote", "figure")), frozenset(("p",))
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Boxes beside the article with this share of link text or more are lists of links.
MOST_LINKED = 0.25
#: Words of a class or id that mark a box as no part of the article, whatever it holds.
BOXES = frozenset(
    "ad ads advert adverts advertisement adsense adbox comment comments consent cookie cookies disqus gdpr newsletter paywall popup promo promoted promotion related replies reply respond share sharing skip sponsor sponsored subscribe subscription".split()
)
#: Words that name a part of a layout; a box around nearly all of the page's text may have them, too.
PARTS = frozenset(
    "banner breadcrumb breadcrumbs disclaimer footer header login masthead menu modal nav navbar navigation notice notices overlay pager pagination reader sidebar signup social toolbar widget widgets".split()
)
#: Words that say no more of a box than that it is one; an id, or a class of running text, must have no others beside the words above to tell of noise.
PLAIN = frozenset(
    "area aside bar block body bottom box button buttons code container content div footer form global google gpt group header holder icon icons inner items left link links list main module outer page pane panel placeholder post posts primary region right row secondary section site slot story stories article articles text thread title top unit wrap wrapper zone".split()
)
#: Before `header`, one of these says that it is an article's.
OWN_HEADER = frozenset("article content entry news page post section story".split())
#: A name that begins or ends so tells of a box somewhere else on the page.
ABOUT_FIRST, ABOUT_LAST = frozenset("has with no without not is".split()), frozenset("open enabled disabled layout".split())
#: A box with a layout part's name is opened if it holds so many times the unlinked text outside, and so many characters.
OPEN_SHARE, OPEN_CHARS = 10, 200
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
#: An opening tag closes these open ones, up to the bound of a table, list or section.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl article main section body html div".split())


#: Why a box is cut: it is a form, it is named like a part of the layout (both may be opened), or it stays cut.
FORM, SOFT, HARD = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "points", "chars", "linked", "main")

    def __init__(self, tag: str, parent: Node | None, noise: int = 0):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0
        self.main = tag in MAIN


def _named(value: str, whole: bool) -> int:
    """What the names in a class or id say of a box; `whole` if each of a name's words must fit."""
    found = 0
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in ABOUT_FIRST or words[-1] in ABOUT_LAST:
            continue
        if whole and not all(w in BOXES or w in PARTS or w in PLAIN or w.isdigit() for w in words):
            continue
        if "header" in words and not OWN_HEADER.isdisjoint(words) and BOXES.isdisjoint(words):
            continue
        found = max(found, HARD if not BOXES.isdisjoint(words) else SOFT if not PARTS.isdisjoint(words) else 0)
    return found


def _noise(tag: str, attrs: str) -> int:
    if tag in NOISE:
        return HARD
    found = FORM if tag in FORMS else SOFT if tag == "noscript" else 0
    if not attrs or tag in ("html", "body", "article", "main"):
        return found
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
        if name in ("class", "id"):
            found = max(found, _named(value, name == "id" or tag in FLOW))
    return found


def _within(node: Node | None, tags: frozenset) -> bool:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node is not None


def parse(page: str) -> Node:
    root = now = Node("html", None)
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside a script or the like
        if m.start() > at:
            now.children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            up = now
            while up is not root and up.tag != tag:
                if up.tag in ("article", "main", "body", "table") and tag not in SCOPE:
                    break  # an inline end tag doesn't close a section
                up = up.parent
            if up is not root and up.tag == tag:
                now = up.parent
            elif tag == "p":
                now.children.append(Node("p", now))
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in ("html", "body"):
            if tag == "body" and now.tag == "head":
                now = now.parent
            continue
        if tag in BLOCK:
            # a block closes an open paragraph
            up = now
            while up is not root and up.tag not in SCOPE and up.tag not in ("p", "li", "td", "th", "dd", "dt", "blockquote"):
                up = up.parent
            if up.tag == "p":
                now = up.parent
        if tag in CLOSES:
            up = now
            while up is not root and up.tag not in SCOPE:
                if up.tag in CLOSES[tag]:
                    now = up.parent
                up = up.parent
        node = Node(tag, now, _noise(tag, attrs))
        now.children.append(node)
        if tag == "header" and _within(now, MAIN):
            # an article's own header is cut only for what no header is
            names = " ".join(v.strip("\"'") for n, v in _ATTR.findall(attrs) if n.lower() in ("class", "id"))
            node.noise = HARD if _named(names, False) == HARD else 0
        elif tag == "footer" and _within(now, QUOTES) or tag == "label" and (_within(now, PARAGRAPHS) or not _within(now, FORMS)):
            node.noise = 0
        if tag not in VOID and not attrs.endswith("/"):
            now = node
        if node.main:
            # an article in a box of comments or the like opens nothing
            up = node.parent
            while up is not None and not up.main and (tag == "main" or up.noise != HARD):
                up.main = True
                up = up.parent
    if at < len(page):
        now.children.append(page[at:])
    return root


def _blocks(node: Node, out: list[str]) -> None:
    """The blocks of text below a node, in page order, without noise; a loop, for trees of any depth."""
    held: list[str] = []

    def flush():
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(html.unescape(x))
        elif not x.noise or x is node:
            if x.tag == "br":
                held.append(" ")
            elif x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()


def _open_boxes(root: Node) -> None:
    """Opens boxes around articles, and those that hold what makes the page, from the outside in."""
    changed = True
    while changed:
        changed, outside, boxes = False, 0, []
        stack: list = [(root, None)]
        while stack:
            node, box = stack.pop()
            if isinstance(node, str):
                n = len(node.strip())
                if box is None:
                    outside += n
                else:
                    box[1] += n
                continue
            if node.noise and node.main:
                node.noise = 0
            if node.noise == HARD or node.tag == "a":
                continue
            if node.noise and box is None:
                box = [node, 0]
                boxes.append(box)
            stack.extend((x, box) for x in node.children)
        for node, n in boxes:
            if n > outside if node.noise == FORM else n > OPEN_SHARE * outside and n >= OPEN_CHARS:
                node.noise, changed = 0, True


def _score(root: Node) -> list[Node]:
    """Points of all containers; the nodes in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        if node.noise:
            continue
        order.append(node)
        link = link or node.tag == "a"
        for child in reversed(node.children):
            if isinstance(child, str):
                n = len(child.strip())
                if n:
                    node.chars += n
                    node.linked += n if link else 0
            else:
                stack.append((child, link))
    own = {}
    for node in reversed(order):
        # inline text counts for the block around it
        block = node
        while block.tag not in BLOCK and block.parent is not None:
            block = block.parent
        text = [c for c in node.children if isinstance(c, str)]
        n, commas = sum(len(c.strip()) for c in text), sum(c.count(",") + c.count("，") + c.count("、") for c in text)
        if n:
            have = own.setdefault(id(block), [block, 0, 0])
            have[1] += n
            have[2] += commas
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for block, n, commas in own.values():
        points = 1 + commas + min(n / 100, 3)
        share, up = 1, block.parent if block.tag not in ("div", "section", "article", "main", "body", "html", "td") else block
        while up is not None and share <= 3:
            up.points += points / share
            share, up = share + 1, up.parent
    return order


def _final(node: Node) -> float:
    return (node.points + (10 if node.tag in MAIN else 0)) * (1 - node.linked / node.chars if node.chars else 0.0)


def _with_siblings(best: Node) -> list[Node]:
    """The best container and what stands beside it, in page order: boxes and stretches of inline text that are no links."""
    least, keep = max(5.0, 0.2 * _final(best)), []
    inline = Node("div", None)
    for x in [*best.parent.children, best.parent]:
        if x is not best.parent and x is not best and (isinstance(x, str) or x.tag not in BLOCK):
            inline.children.append(x)
            continue
        chars = sum(len(c.strip()) if isinstance(c, str) else c.chars for c in inline.children)
        linked = sum(c.linked for c in inline.children if isinstance(c, Node))
        if chars and linked < MOST_LINKED * chars:
            keep.append(inline)
        inline = Node("div", None)
        if x is best or x is not best.parent and not x.noise and x.chars and (x.linked < MOST_LINKED * x.chars or _final(x) >= least):
            keep.append(x)
    return keep


def _headline(best: Node, order: list[Node]) -> Node | None:
    """The headline that stands above an article without one: the last h1 before it, in a box around both.

    Directly in the body it is taken for the site's name where the article has a heading.
    """
    inside, heads = {id(best)}, set()
    for n in order:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
            if n.tag in HEADS:
                heads.add(n.tag)
    if "h1" in heads:
        return None
    above, up = {}, best.parent
    while up is not None:
        above[id(up)] = up
        up = up.parent
    found = None
    for n in order:
        if n is best:
            break
        if n.tag == "h1" and n.chars:
            box = n.parent
            # a box of its own, such as a div around the headline
            while box is not None and id(box) not in above:
                box = box.parent
            if box is not None and (box.parent is not None or not heads):
                found = n
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _open_boxes(root)
    order = _score(root)
    holders = [n for n in order if n.points > 0]
    if not holders:
        return ""
    best = max(holders, key=_final)
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    # the outermost of articles within articles, or else the main element
    best = next((n for tag in ("article", "main") for n in reversed(above) if n.tag == tag), best)
    if best.tag == "article" and best.parent is not None:
        keep = [x for x in best.parent.children if x is best or isinstance(x, Node) and x.tag == "article" and not x.noise and x.chars and x.linked < MOST_LINKED * x.chars]
        title = _headline(keep[0], order)
        keep = keep if title is None else [title, *keep]
    elif best.parent is not None and best.tag not in MAIN:
        keep = _with_siblings(best)
    else:
        keep = [best]
    out: list[str] = []
    for x in keep:
        _blocks(x, out)
    return "\n".join(out)


def _extractor(at: int):
    def run(batches):
        for batch in batches:
            text = [main_text(x) for x in batch.column(at).to_pylist()]
            columns = [c for k, c in enumerate(batch.columns) if k != at] + [pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [n for k, n in enumerate(batch.schema.names) if k != at] + ["text", "n_chars"])

    return run


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The other columns of pages with text and n_chars (code points)."""
    session(pages)
    rest = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    # numbered columns on the way through Python: names may hold dots or clash
    rows = pages.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)), F.col(f"`{html_col}`").alias("html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(_extractor(len(rest)), schema).toDF(*rest, "text", "n_chars")
