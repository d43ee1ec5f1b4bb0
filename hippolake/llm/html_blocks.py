"""Pages as text blocks with their place in the page's tree: the small reader under main_text.py.

Reads markup as browsers do where it matters for text: comments, raw elements (scripts, styles),
attributes in any quotes, tags that close others (paragraphs, items, cells), stray and missing end
tags. Every step moves forward or takes an open element off the stack, so work grows with the page.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass

#: Elements that end a line of text; all others are inline.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without a content of their own.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup, and ends at their own end tag only.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
#: Elements whose text isn't part of any text.
UNREAD = {"noscript", "template", "svg", "math", "select", "datalist", "button", "canvas", "audio", "video", "object", "map"}
#: Block elements that a paragraph can hold, so that they don't end it.
IN_PARAGRAPH = {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TABLE = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
#: What starts ends what of these is open in the same list or table.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption"}, "td": {"td", "th", "caption"}, "th": {"td", "th", "caption"}, "tbody": {"tbody", "thead", "tfoot", "tr", "caption"}, "tfoot": {"tbody", "thead", "tr", "caption"}, "thead": {"caption"}}
LISTS = {"ul", "ol", "menu", "dl", "dir", "table"}
#: End tags don't reach out of these.
SCOPES = {"td", "th", "caption", "table", "template"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]*)))?""")
_UNCLOSED = re.compile(r"\s*=\s*[\"']")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass(slots=True)
class Node:
    """An open element: its parent's number, what its place says of texts in it, whether they are read."""

    tag: str
    number: int
    place: object
    unread: bool


@dataclass(slots=True)
class Block:
    """A run of text between two block boundaries, decoded, blanks folded."""

    text: str
    words: int
    link_share: float
    tag: str
    container: int
    place: object


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of the tag whose name ends at `at`, and where the tag ends; the page's end for a tag that doesn't."""
    found: dict[str, str] = {}
    end = len(page)
    while True:
        at = _SPACE.match(page, at).end()
        if at >= end:
            return found, end
        if page[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(page, at)
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        if value is None and _UNCLOSED.match(page, m.end()):
            return found, end  # quotes that never close
        found.setdefault(m[1].lower(), references.unescape(value) if value and "&" in value else value or "")
        at = m.end()


class Reader:
    """Reads one page; place(parent's place, tag, attributes) says what an element says of its texts."""

    def __init__(self, place):
        self.place = place
        self.blocks: list[Block] = []
        self.parents: list[int] = []
        self.stack: list[Node] = []
        self.scopes: list[Counter] = [Counter()]
        self.lists: list[Counter] = [Counter()]
        self.tables = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.link_depth = 0
        self._push("", {})

    def _push(self, tag: str, found: dict[str, str]) -> None:
        above = self.stack[-1] if self.stack else None
        number = len(self.parents)
        self.parents.append(above.number if above else -1)
        self.stack.append(Node(tag, number, self.place(above.place if above else None, tag, found), tag in UNREAD or bool(above and above.unread)))
        self.scopes[-1][tag] += 1
        self.lists[-1][tag] += 1
        if tag in TABLE:
            self.tables[tag] += 1
        if tag in SCOPES:
            self.scopes.append(Counter())
        if tag in LISTS:
            self.lists.append(Counter())

    def _pop(self) -> str:
        tag = self.stack.pop().tag
        if tag in SCOPES:
            self.scopes.pop()
        if tag in LISTS:
            self.lists.pop()
        if tag in TABLE:
            self.tables[tag] -= 1
        self.scopes[-1][tag] -= 1
        self.lists[-1][tag] -= 1
        if len(self.stack) < self.link_depth:
            self.link_depth = 0
        return tag

    def _flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                node, text = self.stack[-1], " ".join(words)
                self.blocks.append(Block(text, len(words), min(1.0, self.linked / len(text)), node.tag, node.number, node.place))
            self.parts, self.linked = [], 0

    def _text(self, text: str) -> None:
        if self.stack[-1].unread or not text:
            return
        if "&" in text:
            text = references.unescape(text)
        self.parts.append(text)
        if self.link_depth:
            self.linked += sum(map(len, text.split()))

    def _start(self, tag: str, page: str, at: int) -> int:
        found, at = attributes(page, at) if page[at : at + 1] != ">" else ({}, at + 1)
        if tag in RAW:
            m = _RAW_ENDS[tag].search(page, at)
            if m is None:
                return len(page)
            return attributes(page, m.end())[1]
        if tag == "br":
            self._text(" ")
        elif tag == "a":
            self.link_depth = len(self.stack)
        if tag not in BLOCK and tag not in UNREAD:
            return at
        if tag in BLOCK:
            self._flush()
            if tag not in IN_PARAGRAPH and self.scopes[-1]["p"]:
                while self._pop() != "p":
                    pass
        ended = ENDS.get(tag, ())
        while any(self.lists[-1][e] for e in ended):
            self._pop()
        if tag not in VOID and not (tag in UNREAD and page[at - 2] == "/"):
            self._push(tag, found)
        return at

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
        if tag not in BLOCK and tag not in UNREAD or tag in ("body", "html"):
            return
        if tag in BLOCK:
            self._flush()
        if (self.tables if tag in TABLE else self.scopes[-1])[tag]:
            while self._pop() != tag:
                pass

    def read(self, page: str) -> Reader:
        at, end = 0, len(page)
        while at < end:
            mark = page.find("<", at)
            if mark < 0:
                mark = end
            self._text(page[at:mark])
            if mark == end:
                break
            following = page[mark + 1 : mark + 2]
            if following.isascii() and following.isalpha():
                name = _NAME.match(page, mark + 1)
                at = self._start(name[0].lower(), page, name.end())
            elif following == "/" and (name := _NAME.match(page, mark + 2)):
                at = attributes(page, name.end())[1]
                self._end(name[0].lower())
            elif page.startswith("<!--", mark):
                close = page.find("-->", mark + 2)
                at = end if close < 0 else close + 3
            elif following and following in "!?/":
                close = page.find(">", mark + 2)
                at = end if close < 0 else close + 1
            else:
                self._text("<")
                at = mark + 1
        self._flush()
        return self
