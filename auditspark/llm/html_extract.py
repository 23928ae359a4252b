"""Main text of web pages by tree scoring.

Each paragraph has points for its length and commas. They go to its ancestors, whole to the nearest and less to those
above, and are discounted by the link density of the ancestor. The ancestor with most points is the article; siblings
that score well or read like paragraphs are kept with it. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out by element, role and whole class names before, but nothing that holds
most of the page's text; other words of classes only weigh in the score.

Defined cases: null and empty html, and pages without text, have the empty string; unfinished tags, comments and
elements end with the page; text is decoded once, white space of a block is one space, blocks are joined by one line
feed; very long pages are read whole; repeated rows give one row each; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import slices, texts_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
LEFT_OUT = frozenset("script style noscript template nav footer aside form button select option input textarea label fieldset iframe object embed svg canvas video audio map head title dialog menu".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody thead tfoot tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td th".split()) | HEADINGS
ARTICLES = frozenset(("article", "main"))
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr"}
#: An element that begins ends an open one of these kinds, up to the kind after.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tr", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NEGATIVE = frozenset("ad ads adv advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply replies related recommended widget toolbar pagination pager search".split())
#: Whole names that say what an element is, other words only weigh; those of readers' comments, which may be longer than the article.
READERS = frozenset("comment comments comment-list comments-area disqus disqus_thread respond".split())
NAMES = READERS | frozenset("ad ads advert advertisement adverts adsense sponsored promo banner cookie-banner cookie-notice cookie-consent consent popup modal newsletter sidebar navbar nav navigation menu breadcrumb breadcrumbs footer masthead share sharing share-buttons social related related-posts pagination pager widget".split())
#: Further names of paragraphs; characters of paragraphs beside readers' comments that are an article.
ODD_PARAGRAPHS, SHORT_ARTICLE = frozenset(("notice",)), 40
POSITIVE = frozenset("article body content entry main page post story text blog".split())
WEIGHT = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 3.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "form": -3.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0, "h1": -5.0, "h2": -5.0, "th": -5.0}


class Node:
    __slots__ = ("tag", "words", "names", "parent", "parts", "out", "score", "chars", "linked", "plain", "read", "points", "depth", "holds")

    def __init__(self, tag: str, words: frozenset, parent: Node | None, out: bool, names: frozenset = frozenset()):
        self.tag, self.words, self.parent, self.out, self.names = tag, words, parent, out, names
        self.plain, self.read, self.holds = 0, 0, False
        self.parts: list = []
        self.score, self.points, self.chars, self.linked = 0.0, 0.0, 0, 0
        self.depth: int = 0 if parent is None else parent.depth + 1


def _marks(tag: str, raw: str) -> tuple[frozenset, bool, frozenset]:
    """Words of class and id, whether the attributes alone leave the element out, and the whole names in class and id.

    Names such as ``has-sidebar`` tell what a container has or has not, not what it is; their words don't count.
    """
    if not raw.strip(" /\n\t"):
        return frozenset(), False, frozenset()
    words, names, out = [], [], False
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            own = [x for x in value.split() if not x.lower().startswith(("has-", "has_", "with-", "with_", "no-", "no_"))]
            names += [x.lower() for x in own]
            words += [w.lower() for x in own for w in WORDS.findall(x)]
        elif name == "role":
            out |= value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out = True
        elif name == "style":
            out |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return frozenset(words), out and tag not in ("html", "body"), frozenset(names)


def parse(page: str) -> Node:
    """The page as a tree; a node's parts are strings and nodes."""
    root = node = Node("html", frozenset(), None, False)
    at, end = 0, len(page)
    opened: Counter[str] = Counter()  # elements from node up to the root, by name

    def leave(top: Node) -> Node:
        """Ends all open elements up to ``top``; its parent is open then."""
        x = node
        while x is not top.parent:
            opened[x.tag] -= 1
            x = x.parent
        return top.parent

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                node.parts.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                continue
            top = node
            while top is not root and top.tag != tag:
                if top.tag in ("table", "body") and tag not in ("table", "body", "html"):
                    break
                top = top.parent
            if top is not root and top.tag == tag:
                node = leave(top)
            continue
        if not m[0].endswith(">"):
            break  # an unfinished tag at the end
        if tag == "br":
            node.parts.append(" ")
            continue
        if tag in ("html", "body") and root.parts is not None:
            if tag == "html" or any(isinstance(x, Node) and x.tag == "body" for x in root.parts):
                continue
            node = root
            opened.clear()
        if tag in CLOSES_P and opened["p"]:
            top = node
            while top is not root and top.tag not in ("p", "table", "td", "th", "button", "object"):
                top = top.parent
            if top.tag == "p":
                node = leave(top)
        if tag in ENDS and any(opened[x] for x in ENDS[tag][0]):
            kinds, stop = ENDS[tag]
            top = node
            while top is not root and top.tag not in kinds and top.tag not in stop:
                top = top.parent
            if top.tag in kinds:
                node = leave(top)
        words, out, names = _marks(tag, m[3])
        child = Node(tag, words, node, out or tag in LEFT_OUT, names)
        node.parts.append(child)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, at)
            at = close.end()
        elif tag not in VOID:
            node = child
            opened[tag] += 1
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """All nodes that aren't left out, each when it begins (True) and after what is in it (False), without recursion."""
    todo = [(root, True)]
    while todo:
        node, begins = todo.pop()
        yield node, begins
        if begins:
            todo.append((node, False))
            todo.extend((x, True) for x in reversed(node.parts) if isinstance(x, Node) and not x.out)


def _leave_out(root: Node) -> None:
    """Marks what is no part of an article."""
    named, inside = [], 0
    for node, begins in _walk(root):
        if node.tag in ARTICLES:
            inside += 1 if begins else -1
        if begins:
            continue
        kids = [x for x in node.parts if isinstance(x, Node) and not x.out]
        node.holds = node.tag in ARTICLES or any(x.holds for x in kids)
        node.plain = 0 if node.tag == "a" else sum(len(x.strip()) for x in node.parts if isinstance(x, str)) + sum(x.plain for x in kids)
        node.read = node.plain if node.tag == "p" else sum(x.read for x in kids)
        if node.tag in ("html", "body", "article", "main") or node.tag in HEADINGS:
            continue
        if node.tag == "header" and not inside:
            node.out = True
        elif node.names & (NAMES | ODD_PARAGRAPHS if node.tag == "p" else NAMES) and not node.holds and not (inside and node.tag == "header"):
            named.append(node)
    for node in named:
        # readers' comments may be longer than the article, if there is one beside them
        node.out = node.plain * 2 <= root.plain or bool(node.names & READERS) and root.read - node.read >= SHORT_ARTICLE


def _measure(root: Node) -> None:
    """Characters and linked characters below each node, then the points of paragraphs to its ancestors."""
    points_at = np.zeros(64)  # of the open node of each depth
    share = np.array([1.0])  # what an ancestor gets, by how far it is above
    for node, begins in _walk(root):
        depth = node.depth
        if begins:
            if depth >= len(points_at):
                points_at = np.concatenate([points_at, np.zeros(len(points_at))])
            points_at[depth] = 0.0
            continue
        commas, direct = 0, False
        for x in node.parts:
            if isinstance(x, Node):
                if not x.out:
                    node.chars += x.chars
                    node.linked += x.linked
            elif text := x.strip():
                node.chars += len(text)
                commas += text.count(",") + text.count("、") + text.count("，")
                direct = True
        if node.tag == "a":
            node.linked = node.chars
        if node.chars and (node.tag in PARAGRAPHS or direct and node.tag in ("div", "section", "article", "main", "body", "html")):
            points = (1 + commas + min(node.chars / 100, 3)) * (1 - node.linked / node.chars)
            levels = depth + (node.tag not in PARAGRAPHS)
            if levels > len(share):
                share = np.array([1.0, 0.5, *(1 / (3 * k) for k in range(2, 2 * levels))])
            points_at[:levels] += points * share[:levels][::-1]
        node.points = float(points_at[depth])


def _blocks(kept: Node | str, blocks: list[list[str]], page: bool) -> None:
    """Adds the text of what is kept, block by block; ``page``: it is the whole page, whose menus are no part of it: lists of links below its body or before its first paragraph."""
    todo, begun = [kept], False
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif not isinstance(x, Node):
            blocks[-1].append(x)
        elif not x.out and x.tag not in VOID:
            if page and x.tag in ("ul", "ol", "table", "dl") and x.chars and x.linked > 0.6 * x.chars and (x.parent.tag in ("body", "html") or not begun):
                continue
            unread = x.score < 0 or x.chars and x.linked > 0.5 * x.chars  # a block of links has no points
            if x is not kept and x.words & NEGATIVE and unread and x.tag not in PARAGRAPHS and x.tag != "a" and not x.holds and x.plain * 2 <= kept.plain:
                continue
            begun = begun or x.tag in ("p", "pre", "blockquote") and x.chars > 0
            if x.tag in ("td", "th"):
                blocks[-1].append(" ")
            if x.tag in BLOCK:
                blocks.append([])
                todo.append(None)
            todo.extend(reversed(x.parts))
        elif x.tag == "hr":
            blocks.append([])


def main_text(page: str) -> str:
    """The article of a page, a line for each block."""
    if not page.strip():
        return ""
    root = parse(page)
    _leave_out(root)
    _measure(root)
    nodes = [x for x, begins in _walk(root) if begins]
    for x in nodes:
        sign = bool(x.words & POSITIVE) - bool(x.words & NEGATIVE)
        x.score = (x.points + (WEIGHT.get(x.tag, 0.0) + 25.0 * sign if x.points else 0.0)) * (1 - x.linked / max(x.chars, 1))
    best = max((x for x in nodes if x.tag not in PARAGRAPHS and x.chars), key=lambda x: x.score, default=None)
    if best is None:
        return ""
    up = best.parent
    while up is not None and best.tag not in ARTICLES:
        if up.tag in ARTICLES or up.score >= 0.75 * best.score > 0:
            best = up
        up = up.parent
    kept: list[Node | str] = [best]
    if best.parent is not None and best.tag not in ("body", "html"):
        kept = [x for run in _runs(best.parent) if run[0] is best or _sibling(run, best) for x in run]
    blocks: list[list[str]] = [[]]
    for x in kept:
        if not _inline(x):
            blocks.append([])
        _blocks(x, blocks, isinstance(x, Node) and x.tag in ("body", "html"))
        if not _inline(x):
            blocks.append([])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _inline(x: Node | str) -> bool:
    return not isinstance(x, Node) or x.tag not in BLOCK and not x.out


def _runs(node: Node) -> Iterator[list[Node | str]]:
    """The parts of a node that aren't left out: each block alone, text and inline elements in a row together."""
    run: list[Node | str] = []
    for x in node.parts:
        if _inline(x):
            run.append(x)
            continue
        if run:
            yield run
        run = []
        if not x.out:
            yield [x]
    if run:
        yield run


def _sibling(run: list[Node | str], best: Node) -> bool:
    if best in run:
        return True
    chars = sum(x.chars if isinstance(x, Node) else len(x.strip()) for x in run)
    density = sum(x.linked for x in run if isinstance(x, Node)) / max(chars, 1)
    x = run[0]
    if len(run) > 1 or _inline(x) or x.tag == "p":
        return chars > 0 and density < 0.25
    if x.tag in HEADINGS:
        return chars > 0 and density < 0.25 and best.tag not in ARTICLES
    return x.chars > 0 and density < 0.5 and x.score >= max(10.0, 0.2 * best.score)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id, the url, ``text`` and ``n_chars`` (code points). A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [main_text(x) for x in texts_of(part, html_col)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    pages = df.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.coalesce(F.col(html_col), F.lit("")).alias(html_col))
    return pages.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
