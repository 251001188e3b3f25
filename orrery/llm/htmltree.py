"""Pages as trees of block elements and text blocks.

A block is a run of text with its inline markup between the starts and ends of block elements; a line
break inside it is white space. Elements that are no text for readers (scripts, styles, page titles, templates, frames,
drawings) and the fields of forms are left out with what they hold; all other text is kept, at any depth.

Reading takes time in proportion to the page, whatever it holds: ends of tags that never end are sought once,
and open elements are found by name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

_START = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile("[>\"']")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left out with what they hold.
SILENT = frozenset("script style noscript template svg iframe head title select textarea option datalist".split())
RAW = frozenset("script style title textarea noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big button canvas cite code data del dfn em font i ins kbd label mark nobr object output q rp rt ruby s samp small span strike strong sub sup time tt u var video "
    "annotation math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder semantics".split()
)
#: An open element of the key's kind ends where one of the named starts.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
#: An end is not looked for beyond these.
SCOPES = frozenset("table ul ol dl article section main body html".split())


class TagEnds:
    """Where tags end: at the first > outside quotes, or, if there is none, at the first >.

    A search that reaches the page's end in vain is kept as its quoted stretches. A later one that starts outside of
    them would run into the same end. Each quote mark permutes the three states a reader can be in (outside, in either kind of
    quotes), so readers never meet: at most three different searches fail.
    """

    def __init__(self, page: str):
        self.page, self.failed = page, []

    def find(self, at: int) -> int:
        """The place of the > that ends a tag with something at `at`; -1 if no > follows."""
        for opened, closed in self.failed:
            i = bisect_left(opened, at) - 1
            if i < 0 or at > closed[i]:
                return self.page.find(">", at)
        opened, closed, pos = [], [], at
        while m := _QUOTE.search(self.page, pos):
            if m[0] == ">":
                return m.start()
            end = self.page.find(m[0], m.end())
            opened.append(m.start())
            closed.append(end if end >= 0 else len(self.page))
            if end < 0:
                break
            pos = end + 1
        self.failed.append((opened, closed))
        return self.page.find(">", at)


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Start and end of each tag, comment and declaration, with name, whether it closes, and attributes of tags; the name of
    a CDATA section is '['; other markup has none. A reader may send the place from where to go on."""
    ends, pos = TagEnds(page), 0
    while m := _START.search(page, pos):
        at = m.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            found = (at, end + 3 if end >= 0 else len(page), None, False, "")
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            found = (at, end + 3 if end >= 0 else len(page), "[", False, page[at + 9 : end if end >= 0 else len(page)])
        elif page[at + 1] in "!?":
            end = page.find(">", at)
            found = (at, end + 1 if end >= 0 else len(page), None, False, "")
        else:
            end = ends.find(at + 1)
            if end < 0:
                return  # no tag ends any more: the rest is text
            name = _NAME.match(page, at, end + 1)
            found = (at, end + 1, name[1].lower(), page[at + 1] == "/", page[name.end() : end])
        sent = yield found
        pos = found[1] if sent is None else sent


class Open:
    """The open block elements, found by name and by the last scope."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []  # name, place in the tree
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, name: str, node: int) -> None:
        self.places[name].append(len(self.stack))
        if name in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((name, node))

    def cut(self, at: int) -> None:
        """Ends all elements from the place on."""
        while len(self.stack) > at:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if name in SCOPES:
                self.scopes.pop()

    def close(self, name: str) -> None:
        """Ends the last element of the name, unless it is beyond a scope. The page and its body stay open."""
        if (own := self.places[name]) and own[-1] > 1 and (name in SCOPES or own[-1] > self.scopes[-1]):
            self.cut(own[-1])

    def give_way(self, name: str) -> None:
        """Ends what does not go on where an element of the name starts."""
        for i in range(len(self.stack) - 1, 1, -1):
            inner = self.stack[i][0]
            if inner in ENDS and (ENDS[inner] is None or name in ENDS[inner]):
                self.cut(i)
                if inner not in ("p", "td", "th"):
                    break
            elif inner != "p" and (inner in SCOPES or inner not in ENDS):
                break


class Element:
    __slots__ = ("parent", "depth", "name", "attrs", "text", "linked", "chars")

    def __init__(self, parent: int, depth: int, name: str, attrs: str, text: str | None = None, linked: int = 0):
        self.parent, self.depth, self.name, self.attrs, self.text, self.linked = parent, depth, name, attrs, text, linked
        self.chars = 0


def parse(page: str) -> list[Element]:
    """Elements and blocks in page order, parents first; blocks have the name '' and a text. The first two are the page and its body."""
    out = [Element(-1, 0, "html", ""), Element(0, 1, "body", "")]
    open_ = Open()  # block elements; every page has the first two, as in browsers
    open_.push("html", 0)
    open_.push("body", 1)
    links, parts, linked, silent, depth_of_silent = 0, [], 0, None, 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and silent is None:
            if "&" in raw:
                raw = unescape(raw)
            parts.append(raw)
            if links:
                linked += len(raw.strip())

    def flush() -> None:
        nonlocal linked
        if parts:
            if block := " ".join("".join(parts).split()):
                parent = open_.stack[-1][1]
                out.append(Element(parent, out[parent].depth + 1, "", "", block, min(linked, len(block))))
            parts.clear()
            linked = 0

    reader, sent, pos = tokens(page), None, 0
    while True:
        try:
            start, end, name, close, attrs = reader.send(sent)
        except StopIteration:
            text(page[pos:])
            break
        text(page[pos:start])
        pos, sent = end, end
        if name == "[":
            text(attrs.replace("&", "&amp;"))
            continue
        if name is None:
            continue
        if silent is not None:
            if name == silent:
                depth_of_silent += -1 if close else not attrs.endswith("/")
                if depth_of_silent == 0:
                    silent = None
            elif name == "body" and silent == "head":
                silent = None
            if silent is not None:
                continue
            if close:
                continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                text(" ")
            continue
        if name in SILENT:
            if close:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
                pos = sent = len(page) if end is None else end.end()
                text(" ")
            elif not attrs.endswith("/"):
                silent, depth_of_silent = name, 1
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if close else 1))
            continue
        flush()
        links = 0
        if close:
            open_.close(name)
            continue
        open_.give_way(name)
        if name in ("html", "body"):
            continue
        parent = open_.stack[-1][1]
        about = " ".join(f"{a.lower()}={v.strip(chr(34) + chr(39))}" for a, v in _ATTR.findall(attrs)) if attrs else ""
        out.append(Element(parent, out[parent].depth + 1, name, about))
        if not attrs.endswith("/"):
            open_.push(name, len(out) - 1)
    flush()
    for x in reversed(out):
        if x.text is not None:
            x.chars = len(x.text)
        if x.parent >= 0:
            out[x.parent].chars += x.chars
            out[x.parent].linked += x.linked
    return out
