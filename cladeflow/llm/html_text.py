"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks of text.  A block is described by its number of words and its link density, those of the
blocks before and after it, and by what it stands in: furniture (menus, headers, footers, sidebars, notices, adverts,
forms, comments), the article, and whether the page marks an article at all.  A decision tree, grown from the labelled
pages below, says which blocks are main text; these are joined in page order.

Defined cases: a null or empty page has the empty text.  Tags may be unclosed or crossed: an end tag closes up to its
start tag, or nothing.  Words in inline furniture are left out and don't cut the block around them.  A comment, script or style that is never closed reaches to the end of the page.  Repeated pages
are read row by row; other columns are not read.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, texts

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[a-z]+|[0-9]+")

# Element and class names of HTML pages.
UNREAD = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "title", "select"}
HEAD = {"meta", "link", "title", "base", "script", "style", "noscript", "template", "head", "html"}
EMPTY = {"br", "hr", "img", "input", "meta", "link", "base", "wbr", "source", "track", "col", "embed", "area", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "ruby", "rt", "rp", "nobr", "center"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
FURNITURE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar",
                   "navigation", "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "cookie", "cookies", "consent", "notice", "notices", "notification",
                   "alert", "banner", "footer", "header", "masthead", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe",
                   "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "toolbar", "pagination", "pager", "tags", "copyright", "legal", "skip"}
ARTICLE_NAMES = {"article", "content", "main", "post", "entry", "story", "maincontent"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

Block = tuple[str, int, int, bool, bool]      # text, words, linked words, in furniture, in the article


# Parts of class names that say how a page is laid out, not what an element is.
LAYOUT_FIRST = {"has", "no", "with", "without", "is", "not", "hide", "show"}
LAYOUT_LAST = {"open", "closed", "on", "off", "enabled", "disabled", "active", "layout"}


def named(token: str, whole: bool) -> tuple[bool, bool, bool]:
    """Whether a class or id names furniture, an article, or the header of an article.

    A name like ``has-sidebar`` or ``comments-open`` is about the layout and names nothing.  With ``whole`` only names of one part
    count as furniture: an article is not furniture because of what it is filed under.
    """
    parts = NAME_PART.findall(token)
    if len(parts) > 1 and (parts[0] in LAYOUT_FIRST or parts[-1] in LAYOUT_LAST):
        return False, False, False
    article = not ARTICLE_NAMES.isdisjoint(parts)
    if len(parts) > 1 and parts[0] in ARTICLE_NAMES and parts[-1] == "header":
        return False, True, True
    return not FURNITURE_NAMES.isdisjoint(parts) and (len(parts) == 1 or not whole), article, False


def context(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is furniture, whether it is an article, and whether it is the header of one."""
    furniture, article, head = name in FURNITURE, name in ("article", "main"), False
    if attributes and not attributes.isspace():
        found = [(key.lower(), "".join(values).lower()) for key, *values in ATTRIBUTE.findall(attributes)]
        whole = article or any(
            value in ("main", "article") if key == "role" else key == "class" and not ARTICLE_NAMES.isdisjoint(value.split()) for key, value in found)
        for key, value in found:
            if key == "role":
                furniture |= value in FURNITURE_ROLES
                article |= value in ("main", "article")
            elif key in ("class", "id") and name != "body" and name != "html":
                for token in value.split():
                    own, text, top = named(token, whole)
                    furniture |= own
                    article |= text and name not in HEADINGS
                    head |= top and name not in HEADINGS
            elif key == "itemprop":
                article |= value == "articlebody"
            else:
                furniture |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    return furniture, article, head


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []      # name, furniture, article, header within an article
    text: list[str] = []
    inline: list[tuple[str, int]] = []      # open inline furniture and what is in it: name, elements it stands in
    paragraph: int | None = None            # inline elements at the start of the open paragraph
    linked, in_link, furniture, article, heading = 0, 0, False, False, False

    def flush() -> None:
        nonlocal linked
        if text:
            words = "".join(text).split()
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words)), furniture or (bool(stack) and stack[-1][3] and not heading), article))
            text.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not inline:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece.split())

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in UNREAD:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            text.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br":
                text.append(" ")
            if closing:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][0] == name:
                        del inline[i:]
                        break
            elif name not in EMPTY and (inline or attributes and context(name, attributes)[0]):
                inline.append((name, len(stack)))
            continue
        flush()
        if name == "p":
            if paragraph is not None:
                del inline[paragraph:]
            paragraph = None if closing else len(inline)
        in_link = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    while inline and inline[-1][1] > i:
                        inline.pop()
                    paragraph = None
                    break
            if name in HEADINGS:
                heading = False
        else:
            if stack and stack[-1][0] == "head" and name not in HEAD:
                stack.pop()
            own, main, top = context(name, attributes)
            heading = name in HEADINGS
            before = stack[-1] if stack else ("", False, False, False)
            if not before[1] and (name == "header" and before[2] and own or top and not own):
                stack.append((name, before[1], before[2] or top, True))
            elif name not in EMPTY and (name not in HEADINGS and name != "p" or own or main):
                stack.append((name, before[1] or own, before[2] or main, before[3]))
            elif name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
        furniture, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    flush()
    return out


def describe(found: list[Block]) -> list[tuple[float, ...]]:
    """Numbers of each block that the tree asks for.

    First whether it is in furniture; then its place: 1 in the article, -1 outside it, 0 if the page marks none; then
    words and link density of the block itself, the one before and the one after.
    """
    marked = any(b[4] and not b[3] for b in found)
    own = [(0.0, 0.0), *((float(b[1]), b[2] / b[1]) for b in found), (0.0, 0.0)]
    return [(float(b[3]), float(b[4] and marked) - float(marked and not b[4]), *own[i + 1], *own[i], *own[i + 2]) for i, b in enumerate(found)]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6) -> tuple:
    """A decision tree by Gini impurity: (share,) at a leaf, else (column, limit, at most, above)."""
    share = float(labels.mean())
    best = (2 * share * (1 - share) * len(labels) - 1e-9, None, None)
    if depth and 0 < share < 1:
        for column in range(rows.shape[1]):
            values = np.unique(rows[:, column])
            for limit in (values[1:] + values[:-1]) / 2:
                low = rows[:, column] <= limit
                cost = sum(2 * p * (1 - p) * part.sum() for part in (low, ~low) for p in [labels[part].mean()])
                if cost < best[0]:
                    best = (cost, column, float(limit))
    _, column, limit = best
    if column is None:
        return (share,)
    low = rows[:, column] <= limit
    return column, limit, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def share(tree: tuple, row: tuple[float, ...]) -> float:
    """Share of main text in the leaf of a block."""
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


# The labelled table.  Each page, and a mark for each of its blocks in page order: 1 main text, 0 the rest.
LONG = "The river rose in the night and by the morning the lower fields were under water as far as the old mill and the road to the village."
LABELLED = (
    ("<nav><ul><li><a>Home</a><li><a>News</a><li><a>About us</a></ul></nav><div class=ad>Buy two of our new lamps and get one for free this week only.</div>"
     f"<article><h1>Flood</h1><p>{LONG}<p>Er.<p>Nobody was hurt, <a>the mayor said</a>.</article><footer>&copy; The Paper <a>Imprint</a></footer>", "000" + "0" + "1111" + "0"),
    (f"<header>The Daily Paper of the Valley<p>Since 1871 every morning at your door</header><main><h2>Harvest</h2><p>{LONG} {LONG}<ul><li>Wheat<li>Rye</ul><p><a>All the figures in a table</a>"
     f"</main><aside>Read more about the weather in the hills and in the plain today</aside>", "00" + "11111" + "0"),
    (f"<body><p>{LONG}<p>{LONG}<p>A short remark ends it.<p><a>Next</a><p><a>Back to the start page</a>", "11100"),
    (f"<div><a>Home</a> <a>Shop</a> <a>Help</a></div><h1>On bread</h1><div>{LONG}</div><div>{LONG} {LONG}</div><div><a>More</a> <a>Print</a></div><div>Contact</div>", "011100"),
    (f"<article><p>{LONG}<form>Your name and your mail address please<p>Send</form><p>Then it rained.<div class=comments><p>Great article, I liked it a lot!<p>{LONG}</div></article><p>{LONG}", "1001000"),
    (f"<div class=notice>We use cookies on this site to make it better for all of you.</div><article><p>One.<p>Two.<p>{LONG}</article><div id=sidebar><p>{LONG}<p>Top ten</div>", "011100"),
    (f"<article><p>{LONG}<p><a>A list of links</a><p><a>can be</a><p>text</article><p>{LONG}<p>All rights reserved", "111100"),
    (f"<div><a>One</a></div><div><a>Two</a></div><div>{LONG}</div><div>{LONG}</div><div><a>Three</a></div>", "00110"),
    (f"<p><a>Start</a><p>{LONG}<p>{LONG}", "011"),
    (f"<h1>On the state of the roads</h1><p>{LONG}<p>Yes.<p>{LONG}", "1111"),
    (f"<article><h2>A</h2><p>{LONG}<p><a>See the map</a><p>b<p>c</article>", "11111"), (f"<article><p>x<p>{LONG}<p>y<p><a>z</a></article><p>{LONG}<p>{LONG}<p>Other", "1111000"),
    (f"<article><p>{LONG}<p><a>Link</a><p>The end.</article>", "111"), ("<article><p><a>One link</a><p>End.</article>", "11"),
    (LONG, "1"), ("Only these few words.", "1"), (f"<h1>Short</h1>{LONG}", "11"),
)


@functools.lru_cache(maxsize=1)
def trained() -> tuple:
    """The tree of the labelled pages."""
    rows, labels = [], []
    for page, marks in LABELLED:
        own = describe(blocks(page))
        if len(own) != len(marks):
            raise ValueError(f"{len(own)} blocks but {len(marks)} marks: {page}")
        rows += own
        labels += [int(x) for x in marks]
    return grow(np.array(rows), np.array(labels))


def main_text(page: str, tree: tuple) -> str:
    """Main text of one page."""
    found = blocks(page)
    return " ".join(b[0] for b, row in zip(found, describe(found), strict=True) if share(tree, row) >= 0.5)


def extract(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = tree or trained()

    def step(batch: pa.RecordBatch) -> dict:
        found = [main_text(page, tree) for page in texts(batch, "html")]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(x) for x in found]}

    return mapped(pages.select("page_id", "url", "html"), step, "page_id long, url string, text string, n_chars long")
