"""The folder that driver and executors share, for streams and staged tables."""

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and the master is local."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidemark.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", at)
    return at.rstrip("/")
