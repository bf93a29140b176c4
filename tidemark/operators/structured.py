"""Structured data: walks of JSON-LD, types, identifiers, prices and required properties."""

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

# fixed values: required properties by type; types that coverage counts
REQUIRED = {
    "Organization": ("name",),
    "LocalBusiness": ("name", "address"),
    "Product": ("name",),
    "Offer": ("price", "priceCurrency"),
    "Service": ("name",),
    "Event": ("name", "startDate"),
    "FAQPage": ("mainEntity",),
    "Question": ("name", "acceptedAnswer"),
    "OpeningHoursSpecification": ("dayOfWeek",),
    "PostalAddress": ("addressLocality",),
    "BreadcrumbList": ("itemListElement",),
    "WebSite": ("url",),
}
COVERAGE_TYPES = ("Product", "Service", "Offer", "Event", "FAQPage", "OpeningHoursSpecification")
DEPTH = 6


def bare_type(x: Column) -> Column:
    return F.substring_index(F.substring_index(x, "/", -1), "#", -1)


def json_nodes(text: str | None) -> list[tuple[list[str], str]]:
    """Bare types and JSON (two blanks of indent) of every object of a JSON document to DEPTH, in order; none if it doesn't parse."""
    try:
        root = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return []
    out = []

    def visit(x, depth):
        if depth > DEPTH:
            return
        if isinstance(x, dict):
            t = x.get("@type")
            names = [str(y).rsplit("/", 1)[-1].rsplit("#", 1)[-1] for y in (t if isinstance(t, list) else [t]) if y]
            out.append((names or ["untyped"], json.dumps(x, indent=2, ensure_ascii=False)))
            for k, y in x.items():
                if k != "@context":
                    visit(y, depth + 1)
        elif isinstance(x, list):
            for y in x:
                visit(y, depth + 1)

    try:
        visit(root, 0)
    except RecursionError:
        return []
    return out


def walk(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Every object of a JSON document to depth 6, document order kept: adds depth_ord, types (bare), node (JSON text, two blanks of indent).

    Documents that don't parse give nothing. Objects without @type have the
    one type "untyped". Documents are read in Arrow batches.
    """
    names = payloads.columns
    added = payloads.sparkSession.createDataFrame([], "depth_ord int, types array<string>, node string").schema

    def read(batches):
        for batch in batches:
            found = [json_nodes(t) for t in batch.column(len(names)).to_pylist()]
            row = pa.array([i for i, nodes in enumerate(found) for _ in nodes], pa.int32())
            place = pa.array([k for nodes in found for k in range(len(nodes))], pa.int32())
            types = pa.array([n[0] for nodes in found for n in nodes], pa.list_(pa.string()))
            node = pa.array([n[1] for nodes in found for n in nodes], pa.string())
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns[:-1]), place, types, node], [*names, *added.names])

    schema = payloads.schema
    for f in added:
        schema = schema.add(f)
    return payloads.withColumn("_payload", F.col(payload)).mapInArrow(read, schema)


def members(payload: Column) -> Column:
    """Properties of a JSON object that aren't empty, as a map to their texts."""
    kept = F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: v.isNotNull() & ~v.isin("", "0", "0.0", "false", "null", "[]", "{}"))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def required_violations(entities: DataFrame) -> DataFrame:
    """(…, type, payload) become (…, type, missing): required properties an entity lacks. Payloads that don't parse are passed over."""
    table = entities.sparkSession.createDataFrame([(t, p) for t, props in REQUIRED.items() for p in props], "type string, missing string")
    parsed = entities.where(F.try_parse_json("payload").isNotNull()).withColumn("_have", F.map_keys(members(F.col("payload"))))
    return parsed.join(F.broadcast(table), "type").where(~F.array_contains("_have", F.col("missing"))).drop("payload", "_have")  # a table of fixed size


def keyed_values(payload: Column, keys: tuple[str, ...]) -> Column:
    """Type.key = value for each of the keys that the object has, in the order of the keys."""
    have = F.from_json(payload, "map<string,string>")
    kind = F.coalesce(F.try_element_at(have, F.lit("@type")), F.lit("?"))
    found = F.filter(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(have, k))
    return F.transform(found, lambda k: F.concat(kind, F.lit("."), k, F.lit(" = "), F.element_at(have, k)))


def prices(payload: Column) -> Column:
    return keyed_values(payload, P.PRICE_KEYS)


def availability(payload: Column) -> Column:
    return keyed_values(payload, P.AVAILABILITY_KEYS)


def identifiers(payload: Column) -> Column:
    return keyed_values(payload, P.ID_PROPERTIES)


def entity_text(node: Column) -> Column:
    """What evidence keeps of an entity."""
    return F.left(T.stripped(node), F.lit(1500))
