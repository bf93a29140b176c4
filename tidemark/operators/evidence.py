"""Evidence rows: identity, truncation, keep-first deduplication and references."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

SCHEMA = "site string, ord long, id string, source_url string, kind string, selector string, raw string, phase string"


def identified(rows: DataFrame) -> DataFrame:
    """Truncates raw, drops blank rows and adds id; rows have site, ord, source_url, kind, selector, raw, phase."""
    # each column is used more than once below, so every step is a projection of its own; the filter comes first, as Spark would move it there with all of them inside
    cut = rows.where(T.stripped(F.col("raw")) != "").withColumn("raw", T.stripped(F.col("raw"))).withColumn("raw", T.cut_raw(F.col("raw")))
    return cut.withColumn("id", T.evidence_id(F.col("source_url"), F.col("kind"), F.col("selector"), F.col("raw")))


def keep_first(rows: DataFrame) -> DataFrame:
    """One row for each id of a site, the first by ord."""
    first = Window.partitionBy("site", "id").orderBy("ord")
    return rows.withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i")


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def dangling(cited: DataFrame, rows: DataFrame) -> DataFrame:
    """Citations (site, id) that resolve to no evidence."""
    return cited.join(rows.select("site", "id").distinct(), ["site", "id"], "left_anti")


def induced(rows: DataFrame) -> DataFrame:
    """Rows shown to a model: kinds that carry capabilities, no absences, longest first, within row and character budgets."""
    absent = F.lit(False)
    for marker in P.ABSENCE_MARKERS:
        absent = absent | F.contains(F.coalesce("selector", F.lit("")), F.lit(marker))
    order = Window.partitionBy("site").orderBy(F.desc(F.length("raw")), "ord")
    shown = F.least(F.length("raw"), F.lit(P.MAX_INDUCED_ROW))
    out = rows.where(F.col("kind").isin(*P.CAPABILITY_KINDS) & ~absent)
    out = out.withColumn("position", F.row_number().over(order)).withColumn("spent", F.coalesce(F.sum(shown).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.where((F.col("position") <= P.MAX_INDUCED_ROWS) & (F.col("spent") < P.MAX_INDUCED_CHARS)).withColumn("raw", F.left("raw", F.lit(P.MAX_INDUCED_ROW)))


def snapshot(rows: DataFrame) -> DataFrame:
    """Evidence handed on to generated tools: content cut at 2000, without what only scoring reads."""
    return rows.where(~F.col("kind").isin("rendering", "media", "injection", "header")).withColumn("content", F.left("raw", F.lit(2000)))


def ordered_references(references: DataFrame) -> DataFrame:
    """Every evidence id that the checks of a site cite, once, in the order of checks and places: site, position, id from (site, check, place, id)."""
    first = references.groupBy("site", "id").agg(F.min(F.struct("check", "place")).alias("at"))
    order = Window.partitionBy("site").orderBy("at", "id")
    return first.select("site", F.row_number().over(order).alias("position"), "id")


def drawer(references: DataFrame, rows: DataFrame) -> DataFrame:
    """The evidence rows behind each reference of a check; references that nothing stands for drop out."""
    return references.select("site", "check", "place", "id").join(rows, ["site", "id"])


def injection_findings(rows: DataFrame, *keys: str) -> DataFrame:
    """Injection evidence as findings: id, category, severity, description, read from the lines of raw; rows that only say that a scan was clean are none. keys are columns that go with them."""
    found = rows.where((F.col("kind") == "injection") & (F.coalesce("selector", F.lit("")) != "injection#clean"))
    lines = F.split(F.regexp_replace("raw", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    found = found.withColumn("_lines", lines)
    head, level = "category: ", "severity "
    category = F.get(F.filter("_lines", lambda x: x.startswith(head)), F.lit(0))
    severity = F.rtrim(F.regexp_extract(F.get(F.filter("_lines", lambda x: F.contains(x, F.lit(level))), F.lit(0)), level + "(.*)$", 1), F.lit(")"))
    return found.select(*keys, "id", F.coalesce(F.substring(category, len(head) + 1, F.length(category)), F.lit("unknown")).alias("category"), F.when(severity.isin("info", "low", "medium", "high"), severity).otherwise("medium").alias("severity"), F.left(F.element_at("_lines", -1), F.lit(400)).alias("description"))
