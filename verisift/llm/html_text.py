"""HTML extraction by tag-path ratios.

A page is cut into blocks of text, each under its root-to-leaf path of block
elements (with their first class).  Per path, the length of text, the
punctuation and the linked text of its blocks are added up; length and
punctuation a block are smoothed along the page over neighbouring paths and fused
into one ratio, less the share of linked text.  What tags and roles say weighs on
it: paths in an article or main element count more.  Paths whose ratio reaches a
share of the page's mean are content.  Their blocks are the text, with the headings
above them and with the short blocks (items, cells, captions) beside them.

Elements are left out whole where their tag says so, or where a class, id or role
begins or ends with a word for something else; one that holds the article itself,
or nearly all text, and prose, is a wrapper and stays.

The cost is in proportion to the page: a tag is read once, open elements are
found by depth, and paths are numbers whose sums go up once, whatever the nesting.

Defined results: null, empty and text-free pages give an empty text; unclosed
and stray tags, comments and broken markup are read as browsers do, roughly (a
tag that never ends ends the page); repeated rows are alike; other columns are
ignored.  No length is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.arrow_text import trimmed

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")

#: Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "noframes", "xmp"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "img", "picture", "source",
}
#: An opening tag ends the open elements named here, up to the nearest of the tags after the bar.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = ({"p"}, {"article", "main", "div", "section", "td", "th", "li", "blockquote", "body"})
#: Elements that are no part of an article, and words of classes, ids and roles that say so.
OTHER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset"}
OTHER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related",
    "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe",
    "toolbar", "widget", "widgets", "alert", "popover", "overlay", "paywall",
}
#: A class that begins so tells a state of the page, not what the element is.
STATES = {"no", "not", "non", "has", "with", "without", "is", "js", "hide", "show", "supports"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are part of what stands beside them.
BESIDE = {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "summary", *HEADINGS}
#: A path is content from this share of the page's mean ratio, and this one before smoothing; what a mark as article weighs; the least share of all text that makes marks count.
SHARE, OWN, MARKED, ENOUGH = 0.2, 0.1, 3.0, 0.2
#: A wrapper holds so much of the text if it holds the article, and so much if not; and a block of more than so many spaces, with a mark.
HALF, NEARLY_ALL, PROSE = 0.5, 0.9, 7


@dataclass(slots=True)
class Node:
    """An element: its number, its parent's, path, and what it says it is."""

    at: int
    parent: int
    tag: str
    path: int
    link: bool
    main: bool
    struck: bool = False
    doubtful: bool = False
    anchor: bool = False


@dataclass
class Page:
    """Elements and blocks in page order, and the tree of paths (parent and depth of each)."""

    nodes: list[Node] = field(default_factory=lambda: [Node(0, 0, "", 0, False, False)])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    path_parent: list[int] = field(default_factory=lambda: [0])
    path_depth: list[int] = field(default_factory=lambda: [0])
    path_of: dict[tuple[int, str], int] = field(default_factory=dict)

    def path(self, parent: int, name: str) -> int:
        found = self.path_of.get((parent, name))
        if found is None:
            found = self.path_of[parent, name] = len(self.path_parent)
            self.path_parent.append(parent)
            self.path_depth.append(self.path_depth[parent] + 1)
        return found


def says_other(token: str) -> bool:
    """Whether a class, id or role begins or ends with a word for something that is no article."""
    words = [w.lower() for w in WORD.findall(token)]
    return bool(words) and words[0] not in STATES and (words[0] in OTHER_WORDS or words[-1] in OTHER_WORDS)


def _element(page: Page, tag: str, attrs: str, parent: Node) -> Node:
    """A new element below ``parent``; inline elements keep its path."""
    name, main, struck, doubtful, anchor = tag, parent.main or tag in ("article", "main"), False, False, tag in ("article", "main", "h1")
    if attrs and not attrs.isspace():
        found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
        tokens = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".split()
        if tag not in ("body", "html", "article", "main") or found.get("role"):
            doubtful = any(map(says_other, tokens)) and not (any("article" in t.lower() for t in tokens) and any("header" in t.lower() for t in tokens))
        elif tag == "article":
            doubtful = any(says_other(t) for t in found.get("class", "").split() if "comment" in t.lower() or "reply" in t.lower())
        style = found.get("style", "").replace(" ", "").lower()
        struck = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if found.get("class", "").split():
            name = f"{tag}.{found['class'].split()[0]}"
        if found.get("role") == "main" or found.get("itemprop") == "articleBody":
            main = anchor = True
    if tag in ("form", "fieldset"):
        doubtful = True
    elif tag in OTHER_TAGS or tag == "header" and not parent.main:
        struck = True
    path = parent.path if tag in INLINE else page.path(parent.path, name)
    node = Node(len(page.nodes), parent.at, tag, path, parent.link or tag == "a", main, struck, doubtful, anchor)
    page.nodes.append(node)
    return node


def _tag_end(html: str, at: int, lost: set[str]) -> int:
    """The place of the bracket that ends a tag; -1 if none does.  A quote counts after an equals sign and if it is closed."""
    while m := STOP.search(html, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        if m[0] not in lost and html[max(0, m.start() - 8) : m.start()].rstrip().endswith("="):
            end = html.find(m[0], at)
            if end < 0:
                lost.add(m[0])
            else:
                at = end + 1
    return -1


def read(html: str) -> Page:
    """The elements of a page and its blocks: (nearest block element, text, characters in links), in page order."""
    page = Page()
    root = page.nodes[0]
    stack, solid = [root], [root]  # open elements; those of them that aren't inline
    depth_of: dict[str, list[int]] = {}
    held: list[str] = []
    linked, owner, lost, lost_end = 0, root, set(), False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                page.blocks.append((owner.at, text, linked))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, owner
        if not held:
            owner = solid[-1]
        held.append(text)
        linked += len(text) * stack[-1].link

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            depth_of[node.tag].pop()
            if node is solid[-1]:
                solid.pop()

    def last(tags) -> int:
        return max((depth_of[t][-1] for t in tags if depth_of.get(t)), default=-1)

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt != at:
            add(html[at : lt if lt >= 0 else size])
            at = lt if lt >= 0 else size
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            add(html[at + 9 : end if end >= 0 else size])
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = size if end < 0 else end + 1
            continue
        m = NAME.match(html, at + 1)
        if m is None:
            if html.startswith("</", at) and not lost_end and (end := html.find(">", at)) >= 0:  # a stray mark
                at = end + 1
            else:
                lost_end = lost_end or html.startswith("</", at)
                add("<")
                at += 1
            continue
        end = _tag_end(html, m.end(), lost)
        if end < 0:
            break
        tag, closes, attrs, at = m[1].lower(), html[at + 1] == "/", html[m.end() : end], end + 1
        if tag in RAW and not closes:
            m = re.compile(f"</{tag}", re.I | re.A).search(html, at)
            end = html.find(">", m.end()) if m else -1
            at = size if end < 0 else end + 1
            continue
        if tag not in INLINE:
            flush()
        if closes:
            depth = depth_of[tag][-1] if depth_of.get(tag) else -1
            if depth > 0 and (tag not in INLINE or solid[-1].at <= stack[depth].at):  # an inline tag ends nothing outside its block
                pop_to(depth)
        elif tag not in VOID:
            if tag not in INLINE:
                ends, until = ENDS.get(tag, ENDS_P)
                bound = last(until)
                if last(ends) > bound:
                    depth = last(ends)
                    if tag == "tr":
                        depth = min(d for t in ends for d in depth_of.get(t, ()) if d > bound)
                    pop_to(depth)
            if not (attrs.endswith("/") and tag in ("path", "use")):
                depth_of.setdefault(tag, []).append(len(stack))
                stack.append(_element(page, tag, attrs, stack[-1]))
                if tag not in INLINE:
                    solid.append(stack[-1])
    flush()
    return page


def _kept(page: Page) -> list[bool]:
    """For each element whether it is left after all that is something else has gone."""
    nodes = page.nodes
    size, anchors, prose = [0] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    for at, text, _ in page.blocks:
        size[at] += len(text)
        prose[at] = prose[at] or text.count(" ") >= PROSE and MARKS.search(text) is not None
    hard = [False] * len(nodes)
    for n in nodes[1:]:
        hard[n.at] = hard[n.parent] or n.struck
    for n in reversed(nodes[1:]):
        if not hard[n.at]:
            size[n.parent] += size[n.at]
            anchors[n.parent] += anchors[n.at] + (n.anchor and not n.doubtful)
            prose[n.parent] = prose[n.parent] or prose[n.at]
    total, all_anchors = size[0], anchors[0]
    kept = [not n.struck for n in nodes]
    for n in nodes[1:]:
        if n.doubtful and kept[n.at]:
            holds = anchors[n.at] and anchors[n.at] == all_anchors
            kept[n.at] = prose[n.at] and size[n.at] >= (HALF if holds else NEARLY_ALL) * total
        kept[n.at] = kept[n.at] and kept[n.parent]
    return kept


def _smooth(values: list[float]) -> list[float]:
    n = len(values)
    return [(values[max(0, i - 1)] + 2 * v + values[min(n - 1, i + 1)]) / 4 for i, v in enumerate(values)]


def ratios(page: Page, found: list[tuple[int, str, int]], marks_count: bool) -> dict[int, tuple[float, float]]:
    """The fused ratio of each tag path, smoothed and as it is, in page order."""
    sums: dict[int, list[int]] = {}
    for at, text, linked in found:
        node = page.nodes[at]
        s = sums.setdefault(node.path, [0, 0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(MARKS.findall(text))
        s[2] += min(linked, len(text))
        s[3] += 1
        s[4] += len(text) * node.main
    length, marks = ([s[i] / s[3] for s in sums.values()] for i in (0, 1))
    weight = [(1 - s[2] / max(1, s[0])) * (MARKED ** (2 * s[4] / max(1, s[0]) - 1) if marks_count else 1) for s in sums.values()]
    smooth = [w * x * (0.5 + y) for w, x, y in zip(weight, _smooth(length), _smooth(marks), strict=True)]
    plain = [w * x * (0.5 + y) for w, x, y in zip(weight, length, marks, strict=True)]
    return dict(zip(sums, zip(smooth, plain, strict=True), strict=True))


def main_text(html: str | None) -> str:
    page = read(html or "")
    nodes, kept = page.nodes, _kept(page)
    found = [b for b in page.blocks if kept[b[0]]]
    if not found:
        return ""
    total = sum(len(t) for _, t, _ in found)
    marked = sum(len(t) for at, t, _ in found if nodes[at].main) >= ENOUGH * total
    fused = ratios(page, found, marked)
    mean = [sum(fused[nodes[at].path][i] * len(t) for at, t, _ in found) / total for i in (0, 1)]
    content = {p for p, x in fused.items() if x[0] > 0 and x[0] >= SHARE * mean[0] and x[1] >= OWN * mean[1]}
    if marked:  # a page that marks its article has none beside it
        content &= {nodes[at].path for at, _, _ in found if nodes[at].main}
    inside = _container(page, found, content)
    beside = [False] * len(nodes)  # below the parent of a content block
    for at, _, _ in found:
        if nodes[at].path in content:
            beside[nodes[at].parent] = True
    for n in nodes[1:]:
        beside[n.at] = beside[n.at] or beside[n.parent] and n.tag not in ("div", "section")
    out = []
    for at, text, linked in found:
        node = nodes[at]
        if marked and not node.main:
            continue
        plain = linked < 0.5 * len(text)
        if node.path in content and (inside[node.path] or node.main):
            out.append(text)
        elif node.tag in HEADINGS and (inside[node.path] or node.main) and plain:
            out.append(text)
        elif plain and (node.main and marked or beside[node.parent] and node.tag in BESIDE):
            out.append(text)
    return " ".join(out)


def _container(page: Page, found: list[tuple[int, str, int]], content: set[int]) -> list[bool]:
    """For each path whether it is in the smallest path that holds most content."""
    weight = [0] * len(page.path_parent)
    leaf = set()
    for at, text, _ in found:
        path = page.nodes[at].path
        leaf.add(path)
        if path in content:
            weight[path] += len(text)
    for p in range(len(weight) - 1, 0, -1):
        weight[page.path_parent[p]] += weight[p]
    most = weight[0]
    best = max((p for p, w in enumerate(weight) if w >= 0.8 * most), key=lambda p: (page.path_depth[p], weight[p]))
    if best in leaf:
        best = page.path_parent[best]
    inside = [False] * len(weight)
    inside[best] = True
    for p in range(best + 1, len(weight)):
        inside[p] = inside[page.path_parent[p]]
    return inside


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, lo, size = [], 0, 0
        for i, html in enumerate(batch.column(2)):
            out.append(main_text(html.as_py()))
            size += len(out[-1])
            if size > 1 << 22 or i == batch.num_rows - 1:
                part = batch.slice(lo, len(out))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["id", "url", "text"])
                out, lo, size = [], i + 1, 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` for every page; a single pass, nothing is shuffled."""
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = plain.mapInArrow(trimmed(_rows), "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
