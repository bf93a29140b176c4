"""A run of stages that are written once: a run that failed goes on from what is there.

A stage is known by a fingerprint of its name, its parameters and what it reads.
Its table is written to a folder of that name; Spark's mark of success commits
it. A stage that is committed is read, one that isn't is made anew, whatever a
failed attempt left. So a change in an input makes what depends on it anew, too.
"""

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rubric
from ..operators.registry import Registry
from ..sources import captures
from . import legibility


@dataclass(frozen=True)
class Stage:
    name: str
    fingerprint: str
    path: str
    table: DataFrame
    made: bool


class Lifecycle:
    """Stages under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def source(self, table: DataFrame, name: str) -> Stage:
        """A table of files as it is: its fingerprint is of their paths, sizes and times, summed by Spark."""
        files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        mark = files.agg(F.count("*"), F.bit_xor(F.xxhash64(*files.columns)), F.bit_xor(F.xxhash64(F.lit(1), *files.columns))).first()
        return Stage(name, self._mark(name, *map(str, mark)), "", table, False)

    def stage(self, name: str, make: Callable[..., DataFrame], *inputs: Stage, parameters: str = "") -> Stage:
        """The table that make gives of the inputs' tables, written once."""
        mark = self._mark(name, parameters, *(s.fingerprint for s in inputs))
        path = f"{self.at}/{name}-{mark[:16]}"
        done = self._exists(f"{path}/_SUCCESS")
        if not done:
            make(*(s.table for s in inputs)).write.mode("overwrite").parquet(path)
        return Stage(name, mark, path, self.spark.read.parquet(path), not done)

    @staticmethod
    def _mark(*parts: str) -> str:
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def manifest(self, *stages: Stage) -> DataFrame:
        """name, fingerprint, path, made (in this run)."""
        return self.spark.createDataFrame([(s.name, s.fingerprint, s.path, s.made) for s in stages], "name string, fingerprint string, path string, made boolean")


def score_run(spark: SparkSession, pages: DataFrame, at: str, resources: DataFrame | None = None, registry: Registry | None = None, parameters: str = "") -> list[Stage]:
    """Evidence, check results and site scores of a table of pages as stages; parameters name what else they depend on, as a version of users' detectors."""
    life = Lifecycle(spark, at)
    inputs = [life.source(pages, "pages"), *([life.source(resources, "resources")] if resources is not None else [])]
    evidence = life.stage("evidence", lambda p, *r: legibility.crawl_evidence(captures.from_pages(p), *(r or (None,)), registry), *inputs, parameters=parameters)
    counts = life.stage("inputs", lambda p: rubric.scoring_input(captures.from_pages(p)), inputs[0])

    def checked(rows: DataFrame, sites: DataFrame) -> DataFrame:
        out = rubric.check_results(rows, sites)
        return out.unionByName(registry.results(rows, sites)) if registry and registry.checks else out

    results = life.stage("results", checked, evidence, counts, parameters=parameters)
    return [evidence, counts, results, life.stage("scores", rubric.site_scores, results, counts, parameters=parameters)]
