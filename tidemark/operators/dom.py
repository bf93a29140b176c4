"""Detectors that need document structure: one parse of each page, all findings at once."""

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import items, markup
from .structured import json_nodes

# fixed values: hints of form purposes and of decorative images
SEARCH_HINTS = ("search", "query", "q", "keyword", "term", "find", "lookup")
CONTACT_HINTS = ("contact", "enquiry", "inquiry", "message", "feedback", "support", "quote")
DECORATIVE = ("icon", "logo", "sprite", "spacer", "pixel", "avatar", "bullet", "arrow")
IGNORED_INPUTS = {"submit", "button", "reset", "image", "hidden"}
_STYLE = re.compile(P.HIDDEN_STYLE)
#: Characters of a hidden element inside another one that are a block of their own; what follows is scanned with the outer one.
INNER = 100
#: Bytes of html that are parsed before their rows leave a worker, and bytes of an Arrow batch that comes in.
SLICE, BATCH = 1 << 20, 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
KIND = (
    "forms array<struct<selector:string,method:string,purpose:string,fields:int,named:int,labelled:int,coverage:int>>, "
    "images int, content_images int, with_alt int, empty_alt int, text_chars int, blocks array<struct<location:string,selector:string,text:string>>, "
    "entities array<struct<syntax:string,type:string,node:string>>, nodes array<struct<syntax:string,types:array<string>,node:string>>, errors array<string>"
)


def hidden(e: markup.Element) -> bool:
    a = e.attrs
    if "hidden" in a or a.get("aria-hidden") == "true" or _STYLE.search(a.get("style", "")):
        return True
    joined = a.get("class", "").lower()
    return any(t in joined for t in P.HIDDEN_CLASSES)


def _forms(page: markup.Page) -> list[tuple]:
    labels = {e.attrs.get("for") for e in page.elements if e.tag == "label"}
    forms = [e for e in page.elements if e.tag == "form"][:20]
    inside: dict[int, list[markup.Element]] = {f.place: [] for f in forms}
    for e in page.elements:
        if e.tag in ("input", "select", "textarea") and e.form and e.form.place in inside and not (e.tag == "input" and e.attrs.get("type", "text").lower() in IGNORED_INPUTS):
            inside[e.form.place].append(e)
    out = []
    for i, form in enumerate(forms):
        fields = inside[form.place]
        if not fields:
            continue
        a = form.attrs
        words = [a.get("id"), a.get("name"), a.get("class"), a.get("action"), *(f.attrs.get("name") for f in fields), *(f.attrs.get("placeholder") for f in fields)]
        hay = " ".join(w.lower() for w in words if w)
        purpose = "search" if any(h in hay for h in SEARCH_HINTS) else "contact" if any(h in hay for h in CONTACT_HINTS) else "other"
        method = (a.get("method") or "get").lower()
        named = sum(bool(f.attrs.get("name")) for f in fields)
        labelled = sum(bool(f.labelled or f.attrs.get("aria-label") or f.attrs.get("aria-labelledby") or f.attrs.get("title") or (f.attrs.get("id") and f.attrs["id"] in labels)) for f in fields)
        name = a.get("id") or a.get("name") or f"form:nth-of-type({i + 1})"
        out.append((f"form#{name}#{method}#{purpose}", method, purpose, len(fields), named, labelled, round(100 * labelled / len(fields))))
    return out


def _images(page: markup.Page) -> tuple[int, int, int, int]:
    images = [e.attrs for e in page.elements if e.tag == "img"]

    def small(value: str) -> bool:
        return value.isdecimal() and value.isascii() and (len(value) < 9 and int(value) < 100)

    def content(a: dict) -> bool:
        if any(small(a.get(k, "").strip()) for k in ("width", "height")):
            return False
        hay = " ".join(a.get(k, "") for k in ("src", "class", "id", "alt", "role")).lower()
        return not (any(h in hay for h in DECORATIVE) or a.get("role") == "presentation" or a.get("aria-hidden") == "true")

    kept = [a for a in images if content(a)]
    return len(images), len(kept), sum(bool(a.get("alt", "").strip()) for a in kept), sum("alt" in a and not a["alt"].strip() for a in kept)


def _blocks(page: markup.Page) -> list[tuple]:
    out = [("html_comment", "<!-- -->", c) for c in page.comments]
    covered = 0  # pieces that an outer hidden element holds
    for e in page.elements:
        if e.end > e.start and hidden(e):
            if e.start >= covered:
                out.append(("hidden_element", markup.path(e), page.text(e)))
                covered = e.end
            else:
                out.append(("hidden_element", markup.path(e), page.text(e, INNER)))
        if e.attrs:
            out += [("attribute", f"{markup.path(e)}[{k}]", e.attrs[k]) for k in P.SUSPICIOUS_ATTRIBUTES if e.attrs.get(k, "").strip()]
    out.append(("visible_text", "body", page.text()))
    return out


def _nodes(page: markup.Page) -> list[tuple]:
    """All nodes of structured data: syntax, types and JSON, in order of syntaxes and of the page."""
    out = [("json-ld", types, node) for kind, text in page.scripts if "ld+json" in kind.lower() for types, node in json_nodes(text)]
    for syntax, trees in (("microdata", items.microdata(page)), ("rdfa", items.rdfa(page))):
        out += [(syntax, types or ["untyped"], json.dumps(node, indent=2, ensure_ascii=False)) for types, node in trees]
    return out


def _entities(nodes: list[tuple]) -> list[tuple]:
    """The first node of each syntax and type; untyped ones only where a syntax has no others."""
    first: dict[str, dict[str, str]] = {}
    for syntax, types, node in nodes:
        for t in types:
            first.setdefault(syntax, {}).setdefault(t, node)
    return [(syntax, t, node) for syntax, found in first.items() for t, node in found.items() if t != "untyped" or len(found) == 1]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of at most SLICE bytes of a column, or of one row that is longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > SLICE:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def parsed(captures: DataFrame, html: str = "html") -> DataFrame:
    """Adds what the structure of each page shows: forms, image counts, text blocks for injection scans, structured data.

    Workers hold SLICE bytes of pages and what was found on them at a time,
    however many pages there are. Pages over the size limit get nulls. A part that fails on a page is null
    there and named in errors; the others are not touched by it.
    """
    spark = captures.sparkSession
    now = spark.conf.get(_BYTES, None)
    if not (now and now.rstrip("b").isdigit() and int(now.rstrip("b")) <= BATCH):
        spark.conf.set(_BYTES, str(BATCH))
    names = captures.columns
    kept = captures.withColumn("_html", F.when(F.coalesce(F.length(html), F.lit(0)) <= P.MAX_HTML, F.coalesce(F.col(html), F.lit(""))))
    fields = spark.createDataFrame([], KIND).schema
    parts = (("forms", _forms, 1), ("media", _images, 4), ("text", lambda page: len(page.text()), 1), ("injection", _blocks, 1), ("jsonld", _nodes, 1))

    def findings(text: str) -> tuple:
        errors, out = [], []
        try:
            page = markup.Page(text)
        except Exception:  # one page must not end the job; it is named
            return (*(None for _ in range(len(fields) - 1)), ["parse"])
        for name, find, width in parts:
            try:
                found = find(page)
            except Exception:  # a failing detector loses its own rows only
                errors.append(name)
                found = (None,) * width if width > 1 else None
            out += found if width > 1 else [found]
        nodes = out.pop()
        return (*out, None if nodes is None else _entities(nodes), nodes, errors)

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in (part for whole in batches for part in _slices(whole, len(names))):
            out = [(None,) * len(fields) if text is None else findings(text) for text in batch.column(len(names)).to_pylist()]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(fields)
            shaped = []
            for f, c in zip(fields, cols, strict=True):
                kind = to_arrow_type(f.dataType)
                if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
                    keys = [x.name for x in kind.value_type]
                    c = [None if v is None else [dict(zip(keys, t, strict=True)) for t in v] for v in c]
                shaped.append(pa.array(c, kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *shaped], [*names, *fields.names])

    schema = captures.schema
    for f in fields:
        schema = schema.add(f)
    return kept.mapInArrow(read, schema)


def media_verdict(content: str = "content_images", alt: str = "with_alt", chars: str = "text_chars"):
    """The verdict on images against text."""
    density = F.col(content) / F.greatest(F.col(chars) / 1000.0, F.lit(0.1))
    described = F.when(F.col(content) > 0, F.col(alt) / F.col(content)).otherwise(1.0)
    return F.when((density >= 4) & (F.col(chars) < 1500), "image-dominant").when((described < 0.5) & (F.col(content) >= 5), "imagery is largely undescribed").otherwise("text-dominant or adequately described")
