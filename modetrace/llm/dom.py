"""Raw HTML as a flat tree: one pass over the tags, in time proportional to the page.

Nodes are in page order, a parent before its children. Block elements and named
inline ones (with a class, id or role) are nodes; other inline elements belong to the
node around them. Each run of text between block boundaries is a node of its own.
Scripts, styles, comments and what else never shows are left out. End tags may be
missing or stray, as browsers allow: a paragraph ends where a block begins, an item
where the next one does, and an end tag closes nothing beyond its table cell.
"""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

# Fixed values of the language.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video noembed noframes xmp title".split())
RAW = frozenset("script style noscript iframe noembed noframes textarea xmp title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "caption", "dd", "dt", "html", "legend", "li", "option", "optgroup", "select", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"li", "dd", "dt"}
#: What an element's start ends, and the element that it doesn't reach beyond.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    **dict.fromkeys(("dd", "dt"), (("dd", "dt"), ("dl",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    "tr": (("tr",), ("table",)),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",))),
    "option": (("option",), ("select",)),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), (("h1", "h2", "h3", "h4", "h5", "h6"), ())),
}
SCOPE = frozenset("table td th caption button template".split())

_START = re.compile(r"</?([A-Za-z][^\s/>]*)")
#: The rest of a tag: a > within a quoted value doesn't end it.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Node(NamedTuple):
    tag: str
    parent: int
    names: str  # class, id and role
    text: str  # of a run of text; "" for an element
    block: int  # runs with the same number are one block
    linked: int  # characters of the run within links


def _raw_end(html: str, tag: str, at: int) -> int:
    found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
    return found.start() if found else len(html)


def parse(html: str) -> list[Node]:
    """The nodes of a page; the first is the page itself."""
    nodes: list[Node] = [Node("#page", -1, "", "", 0, 0)]
    # open elements: tag, its node, the last block and the last scope at or below it
    stack: list[tuple[str, int, int, int]] = [("#page", 0, 0, 0)]
    where: dict[str, list[int]] = {}
    block = 0
    pieces: list[str] = []  # of the run of text that is going on
    link = [0, 0]  # open links; characters in them of this run
    owner = 0

    def end_run() -> None:
        if pieces:
            text = "".join(pieces)
            if not text.isspace():
                nodes.append(Node("#text", owner, "", text, block, link[1]))
            pieces.clear()
            link[1] = 0

    def add(text: str) -> None:
        nonlocal owner
        node = stack[-1][1]
        if node != owner:
            end_run()
            owner = node
        text = _html.unescape(text) if "&" in text else text
        pieces.append(text)
        if link[0]:
            link[1] += len(text)

    def pop_to(depth: int) -> None:
        nonlocal block
        while len(stack) > depth:
            tag = stack.pop()[0]
            where[tag].pop()
            if tag == "a":
                link[0] -= 1
            if tag in BLOCK:
                end_run()
                block += 1

    def last(tags: tuple[str, ...]) -> int:
        return max((w[-1] for t in tags if (w := where.get(t))), default=-1)

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        if start > at:
            add(html[at:start])
        head = _START.match(html, start)
        if not head:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                at = size if end < 0 else end + 3
            elif html[start + 1 : start + 2] in ("!", "?", "/"):
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = start + 1
            continue
        rest = _REST.match(html, head.end())
        if not rest:
            break  # the page ends within a tag
        at = rest.end()
        tag = head.group(1).lower()
        if html[start + 1] == "/":
            depth = last((tag,))
            if depth < 0 or depth < stack[-1][3] and tag not in SCOPE and tag not in ("tr", "tbody", "thead", "tfoot") or tag not in BLOCK and depth < stack[-1][2]:
                continue  # stray, or it would close a block or a cell around it
            pop_to(depth)
            continue
        if tag in RAW:
            at = _raw_end(html, tag, at)
            if tag != "textarea":
                continue
        elif tag in UNSEEN:
            at = _close(html, tag, at)
            continue
        if tag == "br":
            add(" ")
        if tag in VOID or tag == "textarea":
            if tag == "hr":
                end_run()
                block += 1
            elif tag in ("img", "input", "textarea"):
                if owner != stack[-1][1]:
                    end_run()
                nodes.append(Node(tag, stack[-1][1], "", "", block, 0))
            continue
        if tag in ENDS_P and last(("p",)) > stack[-1][3]:
            pop_to(last(("p",)))
        if tag in SIBLINGS:
            ended, bound = SIBLINGS[tag]
            depth = last(ended)
            if depth > last(bound) and (bound or depth == len(stack) - 1):
                pop_to(depth)
        if tag in BLOCK:
            end_run()
            block += 1
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(html, head.end(), at)) if at - head.end() > 4 else ""
        node = stack[-1][1]
        if tag in BLOCK or names or tag in ("button", "label"):
            end_run()
            nodes.append(Node(tag, node, names, "", block, 0))
            node = len(nodes) - 1
        depth = len(stack)
        where.setdefault(tag, []).append(depth)
        stack.append((tag, node, depth if tag in BLOCK else stack[-1][2], depth if tag in SCOPE else stack[-1][3]))
        if tag == "a":
            link[0] += 1
    end_run()
    return nodes


def _close(html: str, tag: str, at: int) -> int:
    """Where an element that is left out ends; of nested ones the outermost."""
    depth, tags = 1, re.compile(rf"<(/?){tag}(?=[\s/>])", re.I)
    for found in tags.finditer(html, at):
        depth += -1 if found.group(1) else 1
        if depth == 0:
            return found.end()
    return len(html)
