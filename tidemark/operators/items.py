"""Microdata and RDFa as trees of items: types and properties, with items as values of properties."""

from .markup import Element, Page

# fixed values: attributes that hold the value of a microdata property
LINKS = {"a": "href", "area": "href", "link": "href", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src", "object": "data", "data": "value", "meter": "value", "time": "datetime", "meta": "content"}
#: Levels of nested items that are walked; nested items that a node shows, others are null in it; characters of a text value.
DEPTH, SHOWN, TEXT = 6, 100, 1500

Item = tuple[list[str], dict]


def bare(name: str) -> str:
    """A type or property without its vocabulary."""
    for mark in "/#:":
        name = name.rstrip(mark).rsplit(mark, 1)[-1]
    return name


class _Item:
    __slots__ = ("element", "props", "types")

    def __init__(self, element: Element | None, types: list[str]):
        self.element, self.types, self.props = element, types, {}

    def add(self, name: str, value) -> None:
        self.props.setdefault(name, []).append(value)

    def node(self) -> dict:
        """The item as JSON has it, breadth first; an item inside itself is null."""
        top, left = {}, SHOWN
        todo = [(self, top, (self,))]
        for x, out, above in todo:
            if x.types:
                out["@type"] = x.types[0] if len(x.types) == 1 else x.types
            for name, values in x.props.items():
                shown = []
                for v in values:
                    if isinstance(v, _Item):
                        inner = {} if left > 0 and v not in above else None
                        if inner is not None:
                            left -= 1
                            todo.append((v, inner, (*above, v)))
                        v = inner
                    shown.append(v)
                out[name] = shown[0] if len(shown) == 1 else shown
        return top


def _walked(tops: list[_Item]) -> list[Item]:
    """Items from the top down to DEPTH, each once and before those inside it. A list of values is a level of its own."""
    out: list[Item] = []
    seen, stack = set(), [(x, 0) for x in reversed(tops)]
    while stack:
        x, depth = stack.pop()
        if depth > DEPTH or x in seen:
            continue
        seen.add(x)
        out.append((x.types, x.node()))
        inner = [(v, depth + (2 if len(values) > 1 else 1)) for values in x.props.values() for v in values if isinstance(v, _Item)]
        stack += reversed(inner)
    return out


def microdata(page: Page) -> list[Item]:
    """Types and nodes of all items, outer ones first. itemref adds the properties below the elements it names; an item never holds itself."""
    made = {e.place: _Item(e, [bare(t) for t in e.attrs.get("itemtype", "").split()]) for e in page.elements if "itemscope" in e.attrs}
    if not made:
        return []
    named: dict[str, list[_Item]] = {}
    for x in made.values():
        for name in dict.fromkeys(x.element.attrs.get("itemref", "").split()):
            named.setdefault(name, []).append(x)
    seen, scope, referred, inside = set(), {}, {}, set()
    for e in page.elements:
        p = e.parent
        owner = made.get(p.place) or scope.get(p.place) if p else None
        far = referred.get(p.place, ()) if p and p.place not in made else ()
        name = e.attrs.get("id")
        if named and name in named and name not in seen:  # of elements with the same id the first counts
            seen.add(name)
            far = tuple(dict.fromkeys((*far, *named[name])))
        if owner:
            scope[e.place] = owner
        if far:
            referred[e.place] = far
        props = e.attrs.get("itemprop", "").split()
        own = made.get(e.place)
        if props:
            value = own
            if own is None:
                kind = LINKS.get(e.tag)
                value = e.attrs.get("content") or (e.attrs.get(kind) if kind else None)
                value = page.text(e, TEXT) if value is None else value
            for holder in dict.fromkeys((*((owner,) if owner else ()), *far)):
                if holder is own:
                    continue
                if own:
                    inside.add(e.place)
                for prop in props:
                    holder.add(bare(prop), value)
    return _walked([x for place, x in made.items() if place not in inside])


def rdfa(page: Page) -> list[Item]:
    """Types and nodes of typed resources, outer ones first. Where no resource has a type, the page's properties are one untyped node."""
    made: dict[int, _Item] = {}
    scope: dict[int, _Item] = {}
    loose, tops, some = _Item(None, []), [], False
    for e in page.elements:
        p = e.parent
        owner = made.get(p.place) or scope.get(p.place) if p else None
        if owner:
            scope[e.place] = owner
        props, own = e.attrs.get("property", "").split(), None
        if "typeof" in e.attrs:
            own = made[e.place] = _Item(e, [bare(t) for t in e.attrs["typeof"].split()])
            some = some or bool(own.types)
            if not (owner and props):
                tops.append(own)
        if props:
            value = own
            if own is None:
                value = next((e.attrs[k] for k in ("content", "href", "src", "resource", "datetime") if k in e.attrs), None)
                value = page.text(e, TEXT) if value is None else value
            if owner or own is None:
                for prop in props:
                    (owner or loose).add(bare(prop) if owner else prop, value)
    if loose.props and not some:
        tops.append(loose)
    return _walked(tops)
