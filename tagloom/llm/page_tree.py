"""A web page as a tree of block elements and blocks of text.

Inline markup melts into the block around it; scripts, styles, comments and other text that no reader sees are left out.
Unclosed paragraphs, items and cells end where HTML ends them.  Any text gives a tree: what is no tag is text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_NAME = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")

# Elements of HTML by how they are read.
UNSEEN = frozenset("script style noscript template title iframe object noembed noframes textarea svg math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp
    small span strike strong sub sup time tt u var""".split())
FRAME = frozenset("html head body".split())  # the root stands for them
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An element of the first kind ends an open one of these kinds, unless one of the walls stands between.
_CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "option": (frozenset({"option"}), frozenset({"select"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})), "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
}


@dataclass
class Page:
    """Nodes in page order, the root first; a node is a block of text where ``text`` is not None."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])
    mark: list[str | None] = field(default_factory=lambda: [None])

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), text: str | None = None, linked: int = 0, mark: str | None = None) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.text, text),
                              (self.linked, linked), (self.mark, mark)):
            column.append(value)
        return len(self.parent) - 1


def _attributes(rest: str) -> tuple[tuple[str, ...], str | None]:
    """The words in class, id and role, and the label of a labelled page."""
    names, mark = [], None
    for name, value in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if name in ("class", "id", "role"):
            names += [w.lower() for w in _NAME.findall(value)]
        elif name == "data-main":
            mark = value.strip("\"'")
    return tuple(dict.fromkeys(names)), mark


def parse(source: str) -> Page:
    """The tree of a page."""
    page, open_nodes = Page(), [0]
    pieces: list[tuple[str, bool]] = []
    in_link, at = False, 0

    def end_block() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                page.add(open_nodes[-1], "", (), text, min(len(text), sum(len(p.strip()) for p, link in pieces if link)))
            pieces.clear()

    def say(text: str) -> None:
        if text:
            pieces.append((html.unescape(text) if "&" in text else text, in_link))

    while match := _TOKEN.search(source, at):
        say(source[at:match.start()])
        at = match.end()
        tag = match["tag"] or match["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"] or match["end2"]:
            if tag == "a":
                in_link = False
            elif tag == "br":
                end_block()
            elif tag not in INLINE and tag not in FRAME:
                end_block()
                above = next((i for i in range(len(open_nodes) - 1, 0, -1) if page.tag[open_nodes[i]] == tag), None)
                if above is not None:
                    del open_nodes[above:]
            continue
        rest = match["rest"] if match["tag"] else match["rest2"]
        if tag in UNSEEN:
            if not rest.endswith("/"):
                close = re.compile(f"</{tag}", re.I).search(source, at)
                at = close.start() if close else len(source)
            continue
        if tag in INLINE:
            in_link = in_link if tag != "a" else True
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                end_block()
            continue
        end_block()
        if tag in FRAME:
            continue
        if page.tag[open_nodes[-1]] == "p" or (tag in HEADINGS and page.tag[open_nodes[-1]] in HEADINGS):
            open_nodes.pop()
        kinds, walls = _CLOSES.get(tag, (frozenset(), frozenset()))
        for i in range(len(open_nodes) - 1, 0, -1):
            if not kinds or page.tag[open_nodes[i]] in walls:
                break
            if page.tag[open_nodes[i]] in kinds:
                del open_nodes[i:]
                break
        names, mark = _attributes(rest) if rest else ((), None)
        open_nodes.append(page.add(open_nodes[-1], tag, names, mark=mark))
    say(source[at:])
    end_block()
    return page
