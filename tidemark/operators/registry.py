"""Detectors and checks of users beside the built-in ones.

A detector is a Python function of a page that yields evidence. It runs as a
table function (Python UDTF) joined laterally to the captures, and can be called
from SQL by its name. A check is declared: a predicate on evidence rows, which
becomes a count and its first references by site, and an award of that count. So
checks are aggregated by Spark, whatever a site's number of rows.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, MapType, StringType, StructType

#: Of (url, html, headers) to (kind, selector, raw) of each finding.
Detector = Callable[[str, str, dict[str, str]], Iterable[tuple[str, str | None, str]]]
#: A detector that fails on a page gives one row of this kind, which no check counts.
FAILED = "detector_error"


@dataclass(frozen=True)
class UserCheck:
    """most points on an axis; points is a Column of n, the number of rows where the predicate holds; refs of them are cited."""

    id: str
    axis: int
    label: str
    most: int
    where: Column
    points: Callable[[Column], Column]
    refs: int = 8


def table_function(detect: Detector):
    """A UDTF of (url, html, headers) with rows seq, kind, selector, raw; analyze refuses arguments of other types."""

    class Detect:
        @staticmethod
        def analyze(url: AnalyzeArgument, html: AnalyzeArgument, headers: AnalyzeArgument) -> AnalyzeResult:
            for name, given, want in (("url", url, StringType), ("html", html, StringType), ("headers", headers, MapType)):
                if given.isTable or not isinstance(given.dataType, want):
                    raise ValueError(f"{name} is a column of type {want.__name__}")
            return AnalyzeResult(StructType().add("seq", IntegerType()).add("kind", StringType()).add("selector", StringType()).add("raw", StringType()))

        def eval(self, url, html, headers):
            try:
                found = list(detect(url or "", html or "", dict(headers or {})))
            except Exception as e:  # a failing detector loses its own rows of this page only
                found = [(FAILED, None, f"{type(e).__name__}: {e}")]
            for i, (kind, selector, raw) in enumerate(found):
                yield i, kind, selector, raw

    return udtf(Detect)


@dataclass
class Registry:
    """Detectors by name, in the order of their rows, and checks by id."""

    detectors: dict[str, Detector] = field(default_factory=dict)
    checks: dict[str, UserCheck] = field(default_factory=dict)

    def detector(self, name: str) -> Callable[[Detector], Detector]:
        """Registers a function; as a decorator."""

        def add(detect: Detector) -> Detector:
            if name in self.detectors:
                raise ValueError(f"{name} is registered")
            self.detectors[name] = detect
            return detect

        return add

    def check(self, check: UserCheck) -> None:
        if check.id in self.checks or check.most < 0:
            raise ValueError(f"{check.id} is registered or has negative points")
        self.checks[check.id] = check

    def for_sql(self, spark: SparkSession) -> None:
        """Makes every detector callable as LATERAL name(url, html, headers)."""
        for name, detect in self.detectors.items():
            spark.udtf.register(name, table_function(detect))

    def evidence(self, captures: DataFrame) -> DataFrame:
        """site, page_ord, detector (a number), seq, source_url, kind, selector, raw of captures with site, page_ord, final_url, html, headers."""
        out = None
        for i, detect in enumerate(self.detectors.values()):
            found = table_function(detect)(F.col("final_url").outer(), F.col("html").outer(), F.col("headers").outer())
            rows = captures.select("site", "page_ord", "final_url", "html", "headers").lateralJoin(found)
            rows = rows.select("site", "page_ord", F.lit(i).alias("detector"), "seq", F.col("final_url").alias("source_url"), "kind", "selector", "raw")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = captures.sparkSession.createDataFrame([], "site string, page_ord long, detector int, seq int, source_url string, kind string, selector string, raw string")
        return out

    def results(self, evidence: DataFrame, sites: DataFrame) -> DataFrame:
        """Results of the checks for every site, with the columns of rubric.check_results."""
        from .rubric import first_references

        checks = list(self.checks.values())
        if not checks:
            return sites.sparkSession.createDataFrame([], "site string, axis int, check_id string, label string, points int, max_points int, suppressed boolean, reason string, evidence_refs array<string>")
        carried = F.array_compact(F.array(*(F.when(c.where, F.lit(c.id)) for c in checks)))
        rows = evidence.select("site", "ord", "id", F.explode(carried).alias("signal"))
        counts = rows.groupBy("site", "signal").agg(F.count("*").alias("n"))
        refs = first_references(rows, max(c.refs for c in checks))
        table = sites.select("site").crossJoin(F.broadcast(sites.sparkSession.createDataFrame([(c.axis, c.id, c.label, c.most, c.refs) for c in checks], "axis int, check_id string, label string, max_points int, k int")))  # a row for each check
        joined = table.join(counts.withColumnRenamed("signal", "check_id"), ["site", "check_id"], "left").join(refs.withColumnRenamed("signal", "check_id"), ["site", "check_id"], "left")
        n = F.coalesce("n", F.lit(0))
        award = F.lit(0)
        for c in checks:
            award = F.when(F.col("check_id") == c.id, F.greatest(F.lit(0), F.least(F.lit(c.most), c.points(n).cast("int")))).otherwise(award)
        cited = F.slice(F.coalesce("refs", F.array().cast("array<string>")), F.lit(1), F.col("k"))
        return joined.select("site", "axis", "check_id", "label", F.coalesce(award, F.lit(0)).cast("int").alias("points"), "max_points", F.lit(False).alias("suppressed"), F.lit(None).cast("string").alias("reason"), cited.alias("evidence_refs"))
