"""The folder that driver and executors share, and tables written there to end lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where it is unset, on one machine, a temporary one is made and set."""
    found = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(CHECKPOINT, found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under a fresh name in the shared folder, and read again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
