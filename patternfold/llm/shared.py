"""Places that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where it is unset (tests on one
    machine) a temporary one is made and set."""
    found = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(CHECKPOINT, found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of so many rows at most, so that a batch of long ones stays small on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))
