"""An event log that a stream appends to, each batch once, and that readers follow from its start.

A batch is written beside the log and moved into it under its number by one
rename. A batch that is there already isn't written again, so a stream that is
killed and restarted from its checkpoint adds no event twice, and readers see
whole batches only, which never change. (Where a folder can't be renamed in one
step, as in some object stores, a reader may see a batch in parts.)
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

BATCH = "batch"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_batch(batch: DataFrame, number: int, at: str) -> bool:
    """Adds a batch of events to the log at ``at``; False if the log has it."""
    spark = batch.sparkSession
    fs, target = _folder(spark, f"{at}/log/{BATCH}={number}")
    if fs.exists(target):
        return False
    beside = f"{at}/staging/{number}-{uuid.uuid4().hex}"
    batch.write.parquet(beside)
    _, written = _folder(spark, beside)
    fs.mkdirs(target.getParent())
    if not fs.rename(written, target):
        raise OSError(f"{target} can't be written")
    return True


def append(events: DataFrame, at: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream of events; start() it with a trigger of its own. The log belongs to one checkpoint."""
    return events.writeStream.foreachBatch(lambda batch, number: put_batch(batch, number, at) and None).option("checkpointLocation", checkpoint)


def history(spark: SparkSession, at: str, schema: StructType) -> DataFrame:
    """All events of the log so far, with their batch."""
    fs, log = _folder(spark, f"{at}/log")
    full = StructType([*schema.fields]).add(BATCH, "long")
    return spark.read.schema(full).parquet(f"{at}/log") if fs.exists(log) else spark.createDataFrame([], full)


def follow(spark: SparkSession, at: str, schema: StructType) -> DataFrame:
    """A stream of the log: its history first, then what comes, each event once."""
    fs, log = _folder(spark, f"{at}/log")
    fs.mkdirs(log)
    return spark.readStream.schema(StructType([*schema.fields]).add(BATCH, "long")).parquet(f"{at}/log")
