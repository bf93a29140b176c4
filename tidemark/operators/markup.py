"""HTML as browsers mend it: elements in document order over one text buffer, in time linear in the page.

Not a full tree builder. It knows which start tags end open elements (a new li
ends the li before it, a block ends an open p), which elements end tags can't
reach through (a cell's tags leave its table alone), void and raw-text elements,
and that a head ends with the first thing that can't be in one. Formatting
elements that are closed out of order aren't reopened.

Text is kept once, in pieces; an element holds the range of pieces below it. Open
elements are found by name, so neither depth nor unclosed tags add up.
"""

import re
from collections.abc import Iterator
from html import unescape

# fixed values: what HTML says of elements
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW, ESCAPABLE = frozenset("script style xmp iframe noembed noframes".split()), frozenset(("title", "textarea"))
SILENT = frozenset("script style noscript template svg head".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_CELLS, _TABLE = ("td", "th", "caption", "template", "object"), ("table", "template")
#: Start tag: the open elements that it ends, and the ones that shelter those from it.
ENDS = (
    {t: (("p",), ("button", *_CELLS)) for t in ENDS_P} | {h: (("p", *HEADINGS), ("button", "div", "section", "article", "li", *_CELLS)) for h in HEADINGS}
    | {"li": (("p", "li"), ("ul", "ol", "menu", *_CELLS)), "dt": (("p", "dt", "dd"), ("dl", *_CELLS)), "dd": (("p", "dt", "dd"), ("dl", *_CELLS))}
    | {"option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)), "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",))}
    | {"td": (("td", "th", "caption"), ("tr", *_TABLE)), "th": (("td", "th", "caption"), ("tr", *_TABLE)), "tr": (("td", "th", "tr", "caption", "colgroup"), _TABLE)}
    | {t: (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), _TABLE) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")}
    | {"a": (("a",), _CELLS), "button": (("button",), _CELLS), "body": (("head",), ())}
)
#: End tags of other elements don't reach beyond these.
SPECIAL = ENDS_P | frozenset("body html ul ol dl li td th tr tbody thead tfoot caption table button select template object".split())
WALLS = frozenset(("td", "th", "caption", "table", "template", "object"))
TABLES = frozenset("table tr td th tbody thead tfoot caption template object body html".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORD = re.compile(r"\S{1,80}")
_GAP = re.compile(r"[\s/]*")


class Element:
    """tag, attrs, parent (None at the top), and the range of text pieces below it."""

    __slots__ = ("attrs", "end", "form", "labelled", "parent", "place", "start", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None", place: int, start: int):
        self.tag, self.attrs, self.parent, self.place, self.start, self.end = tag, attrs, parent, place, start, start
        self.form, self.labelled = None, False


class Page:
    """elements in order, comments, pieces of text (blanks collapsed; none of silent elements) and scripts: (type, text)."""

    def __init__(self, html: str):
        self.elements: list[Element] = []
        self.comments: list[str] = []
        self.pieces: list[str] = []
        self.scripts: list[tuple[str, str]] = []
        self._open: list[Element] = []
        self._at: dict[str, list[int]] = {}
        self._special: list[int] = []
        self._walls: list[int] = []
        self._silent = 0
        self._read(html)
        self._pop(0)

    def text(self, e: Element | None = None, most: int | None = None) -> str:
        """The text of the page or below an element, its first characters only if asked."""
        first, last = (0, len(self.pieces)) if e is None else (e.start, e.end)
        if most is None:
            return " ".join(self.pieces[first:last])
        end, size = first, 0
        while end < last and size < most:
            size += len(self.pieces[end]) + 1
            end += 1
        return " ".join(self.pieces[first:end])[:most]

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            i = html.find("<", at)
            if i < 0:
                i = n
            if i > at:
                self._text(html[at:i])
            if i + 1 >= n:
                if i < n:
                    self._text("<")
                return
            c = html[i + 1]
            if c.isascii() and c.isalpha():
                at = self._start(html, i)
            elif c == "/" and (m := _NAME.match(html, i + 2)):
                end = html.find(">", m.end())
                self._close(m.group().lower())
                at = n if end < 0 else end + 1
            elif html.startswith("<!--", i):
                if html.startswith(">", i + 4) or html.startswith("->", i + 4):
                    at = html.index(">", i + 4) + 1
                else:
                    end = html.find("-->", i + 4)
                    self.comments.append(html[i + 4 : n if end < 0 else end])
                    at = n if end < 0 else end + 3
            elif c in "!?/":
                end = html.find(">", i + 2)
                inside = html[i + 2 : n if end < 0 else end]
                if c == "/" or not inside[:7].lower() == "doctype":
                    self.comments.append(inside)
                at = n if end < 0 else end + 1
            else:
                self._text("<")
                at = i + 1

    def _start(self, html: str, i: int) -> int:
        m = _NAME.match(html, i + 1)
        tag, at, n = m.group().lower(), m.end(), len(html)
        attrs: dict[str, str] = {}
        while True:
            gap = _GAP.match(html, at)
            at = gap.end()
            if at >= n or html[at] == ">":
                break
            m = _ATTRIBUTE.match(html, at)
            value = next((v for v in m.groups()[1:] if v is not None), "")
            attrs.setdefault(m.group(1).lower(), unescape(value) if "&" in value else value)
            at = m.end()
        if at >= n:
            return n  # a tag that the page breaks off is no tag
        closed = gap.group().endswith("/")
        e = self._element(tag, attrs)
        at += 1
        if tag in VOID or closed:
            return at
        if tag in RAW or tag in ESCAPABLE:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            end = m.start() if m else n
            if tag == "script":
                self.scripts.append((attrs.get("type", ""), html[at:end]))
            elif tag in ESCAPABLE:
                self._push(e)
                self._text(html[at:end])
                self._pop(len(self._open) - 1)
            after = html.find(">", end)
            return n if after < 0 else after + 1
        self._push(e)
        return at

    def _element(self, tag: str, attrs: dict[str, str]) -> Element:
        if tag not in IN_HEAD and tag != "html" and self._at.get("head"):
            self._pop(self._at["head"][-1])
        if tag in ENDS:
            targets, shelters = ENDS[tag]
            wall = max((self._at[s][-1] for s in shelters if self._at.get(s)), default=-1)
            least = min((self._first_above(t, wall) for t in targets), default=len(self._open))
            if least < len(self._open):
                self._pop(least)
        e = Element(tag, attrs, self._open[-1] if self._open else None, len(self.elements), len(self.pieces))
        forms = self._at.get("form")
        e.form = self._open[forms[-1]] if forms else None
        e.labelled = bool(self._at.get("label"))
        self.elements.append(e)
        return e

    def _first_above(self, tag: str, wall: int) -> int:
        """The lowest open element of that name above a wall: of each name few are, as a new one ends the one before."""
        places = self._at.get(tag)
        if not places or places[-1] <= wall:
            return len(self._open)
        i = len(places) - 1
        while i and places[i - 1] > wall:
            i -= 1
        return places[i]

    def _push(self, e: Element) -> None:
        place = len(self._open)
        self._open.append(e)
        self._at.setdefault(e.tag, []).append(place)
        if e.tag in SPECIAL:
            self._special.append(place)
        if e.tag in WALLS:
            self._walls.append(place)
        self._silent += e.tag in SILENT

    def _pop(self, to: int) -> None:
        while len(self._open) > to:
            e = self._open.pop()
            e.end = len(self.pieces)
            self._at[e.tag].pop()
            if e.tag in SPECIAL:
                self._special.pop()
            if e.tag in WALLS:
                self._walls.pop()
            self._silent -= e.tag in SILENT

    def _close(self, tag: str) -> None:
        places = self._at.get(tag)
        if not places:
            return
        place = places[-1]
        if tag not in TABLES and self._walls and self._walls[-1] > place:
            return
        if tag not in SPECIAL and self._special and self._special[-1] > place:
            return
        self._pop(place)

    def _text(self, data: str) -> None:
        data = " ".join((unescape(data) if "&" in data else data).split())
        if not data:
            return
        if self._open and self._open[-1].tag == "head":
            self._pop(len(self._open) - 1)
        if not self._silent:
            self.pieces.append(data)


def up(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def path(e: Element) -> str:
    """The last four elements down to this one, with an id or the first class, of 80 characters at most."""
    parts = []
    for x in up(e):
        name, first = x.attrs.get("id", ""), _WORD.search(x.attrs.get("class", ""))
        parts.append(x.tag + (f"#{name[:80]}" if name else f".{first.group()}" if first else ""))
        if len(parts) == 4:
            break
    return " > ".join(reversed(parts))
