"""What models and users hand in, as tables: requests, proposed capabilities, tool schemas. Each row ends in one outcome, with a reason if it is refused."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import capabilities as C

#: Proposals of an answer that are looked at, and keys of a request.
MOST, REQUEST_KEYS = 12, ("url", "fixture", "acknowledge_generation")


def _kind(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(x)), F.lit(""))


def _object(x: Column) -> Column:
    return _kind(x).startswith("OBJECT")


def requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds status (202 or 422), source, target and reason to JSON bodies of scan requests.

    A fixture wins over a url; a url is https; other keys are refused, as are
    values of other types. Bodies that are no objects are refused.
    """
    x = F.col(body)
    keys = F.when(_object(x), F.json_object_keys(x))
    field = lambda k: F.get_json_object(x, f"$.{k}")
    typed = lambda k, *kinds: F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), f"$.{k}", "variant")).isin("VOID", *kinds), F.lit(True))
    url, fixture = F.coalesce(field("url"), F.lit("")), F.coalesce(field("fixture"), F.lit(""))
    reason = (
        F.when(~_object(x), "not_an_object").when(F.size(F.array_except(keys, F.array(*map(F.lit, REQUEST_KEYS)))) > 0, "unknown_key")
        .when(~(typed("url", "STRING") & typed("fixture", "STRING") & typed("acknowledge_generation", "BOOLEAN")), "wrong_type")
        .when((url != "") & ~url.startswith("https://"), "not_https").when((url == "") & (fixture == ""), "nothing_to_scan")
    )
    out = bodies.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.withColumns({"status": F.when(ok, 202).otherwise(422), "source": F.when(ok, F.when(fixture != "", "fixture").otherwise("live")), "target": F.when(ok, F.when(fixture != "", fixture).otherwise(url))})


def proposed(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """site, place, name, verb, noun, description, reasoning, state_changing, evidence_ids, hallucinated, reason of the first MOST entries of recorded answers.

    answers: site, answer (a model's text with an object that has a list
    capabilities). shown: site, id of the evidence it saw. reason is null for a
    proposal that stands: else not_an_object, ungrounded (it cites nothing that
    was shown) or no_name. Ids that weren't shown are taken out and listed.
    """
    listed = F.from_json(F.get_json_object(T.repaired_json(F.col("answer")), "$.capabilities"), "array<string>")
    entries = answers.select("site", F.posexplode(F.slice(listed, 1, MOST)).alias("place", "entry"))
    text = lambda k: F.coalesce(T.stripped(F.get_json_object("entry", f"$.{k}")), F.lit(""))
    ids = F.filter(F.from_json(F.get_json_object("entry", "$.evidence_ids"), "array<string>"), lambda x: x.isNotNull() & (x != ""))
    flag = ~F.coalesce(F.get_json_object("entry", "$.state_changing"), F.lit("false")).isin("false", "", "0", "0.0", "[]", "{}")
    rows = entries.select("site", "place", _object(F.col("entry")).alias("whole"), C.snake_name(text("name")).alias("name"), F.lower(text("verb")).alias("verb"), F.lower(text("noun")).alias("noun"), text("description").alias("description"), text("reasoning").alias("reasoning"), flag.alias("state_changing"), F.coalesce(ids, F.array().cast("array<string>")).alias("evidence_ids"))
    grounded = C.induced(rows, shown, MOST).withColumnRenamed("kept", "evidence_ids")
    reason = F.when(~F.coalesce("whole", F.lit(False)), "not_an_object").when(F.col("status") == "dropped", "ungrounded").when(F.col("name") == "", "no_name")
    return grounded.withColumn("reason", reason).drop("whole", "status")


def bounded(spec: Column) -> Column:
    """type, description, maximum and maxLength of a parameter's JSON: numbers up to 100, texts up to 500 code points, also where it says nothing."""
    get = lambda k: F.get_json_object(spec, f"$.{k}")
    kind = F.coalesce(get("type"), F.lit("string"))
    limit = lambda k: F.try_to_number(get(k), F.lit("999999999")).cast("int")
    numeric = kind.isin("integer", "number")
    return F.struct(kind.alias("type"), F.coalesce(T.stripped(get("description")), F.lit("")).alias("description"), F.when(numeric, T.bounded_number(limit("maximum"))).alias("maximum"), F.when(kind == "string", T.bounded_length(limit("maxLength"))).alias("max_length"))


def synthesized(capabilities: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds tool (name, description, parameters with their bounds, returns), offenders and outcome to capabilities (site, cap_id, domain, name, verb, noun, state_changing).

    answers: cap_id, answer: a model's text with an object that has an object
    tool. outcome: state_changing (never asked), no_answer, no_tool, or tool.
    offenders: parameters that the reviewer will refuse, as given: free texts
    without a bound, and what is no object, which the tool leaves out.
    """
    joined = capabilities.join(answers, "cap_id", "left").withColumn("_tool", F.get_json_object(T.repaired_json(F.col("answer")), "$.tool"))
    changes = C.implies_state_change(F.col("name"), F.col("verb"), F.col("state_changing"))
    outcome = F.when(changes, "state_changing").when(F.col("answer").isNull(), "no_answer").when(~_object(F.col("_tool")), "no_tool").otherwise("tool")
    given = F.coalesce(F.from_json(F.get_json_object("_tool", "$.parameters"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    text = lambda k: F.coalesce(T.stripped(F.get_json_object("_tool", f"$.{k}")), F.lit(""))
    own = F.concat_ws("_", T.tool_prefix(F.col("domain")), "verb", "noun")
    joined = joined.withColumn("outcome", outcome).withColumn("_given", F.when(F.col("outcome") == "tool", given))
    kept = F.map_filter("_given", lambda k, v: _object(v))
    tool = F.struct(F.when(text("name") == "", own).otherwise(text("name")).alias("name"), text("description").alias("description"), F.transform_values(kept, lambda k, v: bounded(v)).alias("parameters"), text("returns").alias("returns"))
    out = joined.withColumns({"tool": F.when(F.col("outcome") == "tool", tool), "offenders": F.array_sort(C.unbounded_parameters(F.col("_given")))})
    return out.drop("_tool", "_given", "answer")
