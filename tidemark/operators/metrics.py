"""Evaluation metrics against labelled sites, and their status."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

MIN_SAMPLES = 10


def normalised_names(names: Column) -> Column:
    cleaned = F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), lambda n: T.collapsed(F.translate(F.lower(n), "_", " ")))
    return F.array_distinct(cleaned)


def precision_recall(predicted: Column, labelled: Column) -> Column:
    got, want = normalised_names(F.coalesce(predicted, F.array().cast("array<string>"))), normalised_names(F.coalesce(labelled, F.array().cast("array<string>")))
    hit = F.size(F.array_intersect(got, want))
    neither = (F.size(got) == 0) & (F.size(want) == 0)
    p = F.when(neither, 1.0).when(F.size(got) > 0, hit / F.size(got)).otherwise(0.0)
    r = F.when(neither | (F.size(want) == 0), 1.0).otherwise(hit / F.size(want))
    return F.struct(p.alias("precision"), r.alias("recall"))


def band_distance(predicted: Column, labelled: Column) -> Column:
    """Steps between bands; null if either is missing or unknown."""
    order = F.array(*map(F.lit, P.BANDS))
    a, b = F.array_position(order, predicted), F.array_position(order, labelled)
    return F.when((a > 0) & (b > 0), F.abs(a - b).cast("int"))


def golden(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Per compared site: precision, recall, distance. Failed scans and sites without labelled capabilities drop out."""
    usable = results.where(F.col("error").isNull() & F.col("total").isNotNull())
    joined = usable.join(labels.where(F.size("capabilities") > 0).select("name", "capabilities", "expected_band"), "name")
    return joined.withColumn("pr", precision_recall(F.col("predicted_capabilities"), F.col("capabilities"))).select("name", "pr.precision", "pr.recall", band_distance(F.col("band"), F.col("expected_band")).alias("band_distance"))


def golden_summary(per_site: DataFrame) -> DataFrame:
    d = F.col("band_distance")
    return per_site.agg(
        F.count("*").alias("sites_compared"), F.count(d).alias("band_scored"), T.half_even(F.avg("precision"), 3).alias("capability_precision"), T.half_even(F.avg("recall"), 3).alias("capability_recall"),
        T.half_even(F.avg((d == 0).cast("double")), 3).alias("band_accuracy_exact"), T.half_even(F.avg((d <= 1).cast("double")), 3).alias("band_accuracy_within_1"),
    )


def metric_status(value: Column, samples: Column, metric_class: Column, target: Column, comparison: Column) -> Column:
    met = F.when(comparison == ">=", value >= target).when(comparison == "<=", value <= target).when(comparison == "==", F.abs(value - target) < 1e-9)
    return (
        F.when(value.isNull(), "BLOCKED").when((metric_class == "tuning") & (samples < MIN_SAMPLES), "THIN")
        .when(target.isNull() | (comparison == "info"), "PASS").when(met, "PASS").when(metric_class == "gate", "FAIL").otherwise("BELOW")
    )


def value_text(key: Column, value: Column) -> Column:
    one = F.format_string("%.1f", value)
    return F.when(value.isNull(), "—").when(key.endswith("_seconds") | key.endswith("_delta"), one).when(key.endswith("_usd"), F.format_string("%.2f", value)).otherwise(F.format_string("%.3f", value))


def target_text(target: Column, comparison: Column) -> Column:
    """The comparison and the target in its shortest form; a dash where there is nothing to reach."""
    short = F.regexp_replace(target.cast("string"), r"\.0$", "")
    return F.when(target.isNull() | (comparison == "info"), "—").otherwise(F.concat(comparison, short))


def with_specs(results: DataFrame, specs: DataFrame) -> DataFrame:
    """Measured values (key, value, samples) with their specs (key, class, target, comparison): status, value_text and target_text. A key without a spec drops out; specs are a small table."""
    joined = results.join(F.broadcast(specs), "key")
    status = metric_status(F.col("value"), F.col("samples"), F.col("class"), F.col("target"), F.col("comparison"))
    return joined.withColumns({"status": status, "value_text": value_text(F.col("key"), F.col("value")), "target_text": target_text(F.col("target"), F.col("comparison"))})


def gates(results: DataFrame, run: str = "run") -> DataFrame:
    """Per run: whether every gate passes (a blocked or thin one doesn't; without gates all do), and how many results are thin or blocked."""
    gate = F.when(F.col("class") == "gate", F.col("status") == "PASS")
    return results.groupBy(run).agg(F.coalesce(F.bool_and(gate), F.lit(True)).alias("gates_pass"), F.count_if(F.col("status") == "THIN").alias("thin"), F.count_if(F.col("status") == "BLOCKED").alias("blocked"))


def label_status(labels: DataFrame) -> DataFrame:
    """entries and labelled ones: those with a band and capabilities."""
    full = (F.coalesce("expected_band", F.lit("")) != "") & (F.coalesce(F.size("capabilities"), F.lit(0)) > 0)
    return labels.agg(F.count("*").alias("entries"), F.count_if(full).alias("labelled"))


def injection_recall(expected: Column, found: Column) -> Column:
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, found)) / F.size(want))


def stability(totals: Column) -> Column:
    return F.when(F.size(totals) > 0, (F.array_max(totals) - F.array_min(totals)).cast("double")).otherwise(0.0)
