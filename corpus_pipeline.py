"""The training-corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard_join, mixing, packing, quality, secrets

THRESHOLD = 0.3
#: No SQL states these stages; tests hold them against plain Python.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches THRESHOLD."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = common.Scratch(spark, "quality-stage").stage(quality.document_statistics(docs), "statistics")
    model = quality.fit(stats, labels)
    return docs.where(quality.score_texts(model, F.col("text")) >= THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of shingle links, that of the smallest id."""
    return jaccard_join.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mix),
    ("best_fit_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents in turn."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
