"""A lenient reader of web pages: block elements as a tree, with the text that each holds."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is never text of the page; an open one of the first two hides all that follows.
_HIDDEN = frozenset("script style template iframe svg canvas audio video title textarea xmp noembed noframes".split())
_RAW = frozenset(("script", "style"))
#: Hidden elements that may hold others of their own kind.
_NESTING = frozenset(("svg", "template"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body head address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr ins label legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
    "tbody": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"),
}
_CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in _CLOSES.items()}
_NO_P_CLOSE = frozenset("button ins label option optgroup".split())


@dataclass
class Page:
    """Block elements in page order; node 0 is the page itself. ``runs``: (node, text) and None at each block border."""

    tag: list[str] = field(default_factory=lambda: ["page"])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    parent: list[int] = field(default_factory=lambda: [-1])
    links: list[int] = field(default_factory=lambda: [0])
    link_chars: list[int] = field(default_factory=lambda: [0])
    inline: list[int] = field(default_factory=lambda: [0])
    controls: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str] | None] = field(default_factory=list)


def _tokens(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = (m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes))
    return tuple(dict.fromkeys(w.lower() for value in found for w in _WORD.findall(value)))


def _hidden_end(source: str, at: int, name: str, parent: str) -> int:
    """Where the content of a hidden element ends that begins at ``at``.

    A script or style sheet that is never closed hides the rest. Any other element ends with its parent: where that, or
    another of its own kind, comes before its end tag, it has no content at all and hides nothing.
    """
    if name in _RAW:
        end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
        return end.end() if end else len(source)
    marks = re.compile(rf"<(/?)({name}|{parent})\b[^>]*>", re.IGNORECASE)
    depth = {name: 1, parent: 1}
    for mark in marks.finditer(source, at):
        kind = mark[2].lower()
        if not mark[1]:
            if kind == name and name not in _NESTING:
                break
            if not mark[0].endswith("/>"):
                depth[kind] += 1
            continue
        depth[kind] -= 1
        if kind == name and depth[name] == 0:
            return mark.end()
        if kind == parent and depth[parent] == 0:
            break
    return at


def read_page(source: str) -> Page:
    """Elements left open are closed where their parent or a sibling of their kind demands it."""
    page = Page()
    stack: list[tuple[str, int]] = [("page", 0)]  # open elements, inline ones too, with their block
    at, in_link, size = 0, 0, len(source)

    def say(text: str) -> None:
        if text:
            text = html.unescape(text)
            node = stack[-1][1]
            page.runs.append((node, text))
            if in_link:
                page.link_chars[node] += len(text)

    def close_to(depth: int) -> None:
        nonlocal in_link
        for name, _ in stack[depth:]:
            if name == "a":
                in_link -= 1
            elif name in BLOCKS:
                page.runs.append(None)
        del stack[depth:]

    while at < size:
        tag = _TAG.search(source, at)
        if not tag:
            say(source[at:])
            break
        say(source[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close_to(depth)
                    break
                if name not in BLOCKS and stack[depth][0] in BLOCKS:
                    break
            continue
        attributes = tag[3]
        if name in _HIDDEN:
            if not attributes.endswith("/") or name in ("script", "style", "title"):
                at = _hidden_end(source, at, name, stack[-1][0])
            continue
        block = stack[-1][1]
        if name in _VOID:
            if name == "br":
                page.runs.append((block, " "))
            elif name == "hr":
                page.runs.append(None)
            elif name == "input":
                page.controls[block] += 1
            continue
        if name not in BLOCKS:
            page.inline[block] += 1
            if name == "a":
                page.links[block] += 1
                in_link += 1
            stack.append((name, block))
            continue
        if name in _CLOSES:
            same, scope = _CLOSES[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in scope:
                    break
                if stack[depth][0] in same:
                    close_to(depth)
                    break
        elif name not in _NO_P_CLOSE:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close_to(depth)
                    break
                if stack[depth][0] in BLOCKS and stack[depth][0] not in _NO_P_CLOSE:
                    break
        page.runs.append(None)
        page.tag.append(name)
        page.tokens.append(_tokens(attributes))
        page.parent.append(stack[-1][1])
        for column in (page.links, page.link_chars, page.inline, page.controls):
            column.append(0)
        if name in ("button", "select", "option"):
            page.controls[-1] += 1
        stack.append((name, len(page.tag) - 1))
    return page


def joined(page: Page, keep: list[bool]) -> str:
    """Text of the kept nodes: white space inside a block is one blank, blocks are joined by one."""
    blocks, block = [], []
    for run in [*page.runs, None]:
        if run is None:
            if block and (text := " ".join("".join(block).split())):
                blocks.append(text)
            block = []
        elif keep[run[0]]:
            block.append(run[1])
    return " ".join(blocks)
