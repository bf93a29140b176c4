"""Capabilities: review by rule, referential integrity, emission and record search."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def implies_state_change(name: Column, verb: Column, flag: Column) -> Column:
    markers = F.array(*map(F.lit, P.STATE_CHANGING))
    return F.coalesce(flag, F.lit(False)) | F.lower(verb).isin(*P.STATE_CHANGING) | F.arrays_overlap(F.split(F.lower(name), "_"), markers)


def state_changing_rate(capabilities: DataFrame) -> DataFrame:
    """tools, changing and rate over accepted capabilities that have a tool; the rate is 0 where there are none."""
    used = capabilities.where(F.col("accepted") & F.col("has_tool"))
    changes = implies_state_change(F.col("name"), F.col("verb"), F.col("state_changing"))
    out = used.agg(F.count("*").alias("tools"), F.count_if(changes).alias("changing"))
    return out.withColumn("rate", F.when(F.col("tools") > 0, F.col("changing") / F.col("tools")).otherwise(0.0))


def cited_rows(cited: DataFrame, evidence: DataFrame, most: int = 8) -> DataFrame:
    """The first evidence rows that a capability cites, in the order of the store: cap_id, position, id."""
    order = Window.partitionBy("cap_id").orderBy("ord", "id")
    found = cited.select("cap_id", "id").distinct().join(evidence.select("id", "ord"), "id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("cap_id", "position", "id")


def induced(proposals: DataFrame, shown: DataFrame, most: int = 12) -> DataFrame:
    """Proposals (site, place, name, evidence_ids) after validation: the first of a site, with the ids that were shown to the model.

    kept: shown ids in the given order; hallucinated: the others; status: ok,
    reported (some were not shown) or dropped (none was). Ids are looked up in a
    join, so what was shown may be large. Empty ids and null lists count as none.
    """
    first = proposals.withColumn("_i", F.row_number().over(Window.partitionBy("site").orderBy("place"))).where(F.col("_i") <= most).drop("_i")
    given = first.select("site", "place", F.posexplode("evidence_ids").alias("at", "id")).where("id <> ''")
    seen = given.join(shown.select("site", "id", F.lit(True).alias("seen")).distinct(), ["site", "id"], "left")
    listed = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("at", "id")))), lambda x: x["id"])
    judged = seen.groupBy("site", "place").agg(listed(F.col("seen").isNotNull()).alias("kept"), listed(F.col("seen").isNull()).alias("hallucinated"))
    none = F.array().cast("array<string>")
    out = first.drop("evidence_ids").join(judged, ["site", "place"], "left").withColumns({c: F.coalesce(c, none) for c in ("kept", "hallucinated")})
    return out.withColumn("status", F.when(F.size("kept") == 0, "dropped").when(F.size("hallucinated") > 0, "reported").otherwise("ok"))


def snake_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " -", "__")


def unbounded_parameters(parameters: Column) -> Column:
    """Names in a map of name to JSON spec that are free text without description or bound; what is no object offends too."""

    def bad(_: Column, spec: Column) -> Column:
        get = lambda k: F.get_json_object(spec, f"$.{k}")
        free = get("maxLength").isNull() & get("enum").isNull() & get("pattern").isNull()
        blank = F.trim(F.coalesce(get("description"), F.lit(""))) == ""
        return ~F.coalesce(F.trim(spec).startswith("{"), F.lit(False)) | ((get("type") == "string") & (blank | free))

    return F.map_keys(F.map_filter(parameters, bad))


def review(capabilities: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds rule: the first of no_evidence, state_changing, unbounded_param, injection_detected; null if none holds.

    capabilities: cap_id, name, verb, state_changing, parameters; cited: cap_id,
    id; evidence: id, kind, selector.
    """
    known = evidence.groupBy("id").agg(F.max((F.col("kind") == "injection") & (F.col("selector") != "injection#clean")).alias("tainted"))
    joined = cited.join(known, "id", "left").groupBy("cap_id").agg(F.count_if(F.col("tainted").isNull()).alias("missing"), F.count_if("tainted").alias("tainted"), F.count("*").alias("cited"))
    out = capabilities.join(joined, "cap_id", "left")
    rule = (
        F.when(F.coalesce("cited", F.lit(0)) == 0, "no_evidence").when(F.col("missing") > 0, "no_evidence")
        .when(implies_state_change(F.col("name"), F.col("verb"), F.col("state_changing")), "state_changing")
        .when(F.size(unbounded_parameters(F.col("parameters"))) > 0, "unbounded_param").when(F.col("tainted") > 0, "injection_detected")
    )
    return out.withColumn("rule", rule).drop("missing", "tainted", "cited")


def verdicts(reviewed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Adds accepted and rule from a model's recorded answers (cap_id, verdict, model_rule); without an answer it is rejected."""
    rules = ("no_evidence", "evidence_mismatch", "unbounded_param", "state_changing", "injection_detected")
    out = reviewed.join(recorded, "cap_id", "left")
    answer = F.when(F.col("verdict") == "accept", None).otherwise(F.when(F.col("model_rule").isin(*rules), F.col("model_rule")).otherwise("evidence_mismatch"))
    return out.withColumn("rule", F.coalesce("rule", answer)).withColumn("accepted", F.col("rule").isNull()).drop("verdict", "model_rule")


def emitted(capabilities: DataFrame) -> DataFrame:
    """What becomes a tool: accepted, with parameters, changing nothing; standard paging parameters are added."""
    keep = F.col("accepted") & F.col("parameters").isNotNull() & ~implies_state_change(F.col("name"), F.col("verb"), F.col("state_changing"))
    return capabilities.where(keep).withColumn("parameter_names", F.array_union(F.map_keys("parameters"), F.array(*map(F.lit, ("limit", "offset", "response_format")))))


def citation_validity(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """cited, resolved and their ratio; 1 where nothing is cited."""
    found = cited.join(evidence.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    return found.agg(F.count("*").alias("cited"), F.count("hit").alias("resolved")).withColumn("validity", F.when(F.col("cited") == 0, 1.0).otherwise(F.col("resolved") / F.col("cited")))


def search(records: DataFrame, query: str, columns: list[str], order: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Records whose values contain the query, with an envelope: total, position, has_more, next_offset."""
    hay = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))
    hits = records.where(F.contains(hay, F.lit(query.lower())))
    total = hits.agg(F.count("*").alias("total"))
    page = hits.orderBy(order).offset(offset).limit(limit)
    page = page.withColumn("position", F.row_number().over(Window.orderBy(order)) + offset)  # at most limit rows
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit).withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit)))  # total is one row


def graph_edges(capabilities: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """page -> evidence -> capability -> tool edges of accepted capabilities.

    Citations are read once, and pairs of evidence and name that many
    capabilities share are dropped before addresses are joined to them.
    """
    linked = cited.join(capabilities.where("accepted").select("cap_id", "name"), "cap_id").select("id", "name").distinct()
    used = linked.join(evidence.select("id", "source_url"), "id")

    def edge(source: Column, target: Column, kind: str) -> Column:
        return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge"))

    url, id_, name = F.col("source_url"), F.col("id"), F.col("name")
    return used.select(F.inline(F.array(edge(url, id_, "page-evidence"), edge(id_, name, "evidence-capability"), edge(name, F.concat(F.lit("tool:"), name), "capability-tool")))).distinct()
