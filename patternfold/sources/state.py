"""An engine's tables in a folder: data first, then a manifest of a new number that names them. A reader takes the last manifest that was finished, so it never sees half a save, and a save that breaks off leaves the one before."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternfold.errors import PatternError
from patternfold.operators.memory import id_number

VERSION = 1


def save(tables: dict[str, DataFrame], path: str, settings: dict | None = None) -> None:
    """Writes each table as Parquet under a new name, then the manifest."""
    spark = next(iter(tables.values())).sparkSession
    stamp = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}-{stamp}")
    manifest = json.dumps({"version": VERSION, "tables": {n: f"{n}-{stamp}" for n in tables}, "settings": settings or {}}, default=str)
    number = max([n for n, _ in _manifests(spark, path, False)], default=0) + 1
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest-{number:09d}-{stamp}")


def _manifests(spark: SparkSession, path: str, finished: bool = True) -> list[tuple[int, str]]:
    """Numbers and folders of the manifests at ``path``, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*" + ("/_SUCCESS" if finished else ""))
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    folders = [f.getPath().getParent() if finished else f.getPath() for f in found]
    return sorted((int(f.getName().split("-")[1]), f.toString()) for f in folders)


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and settings. A version from the future is refused; without a version, tables have their plain names."""
    found = _manifests(spark, path)
    if not found:
        raise PatternError(f"nothing is saved at {path}")
    manifest = json.loads(spark.read.text(found[-1][1]).first().value)
    if manifest.get("version", 0) > VERSION:
        raise PatternError(f"version {manifest['version']} is newer than {VERSION}")
    return {n: spark.read.parquet(f"{path}/{f}") for n, f in manifest["tables"].items()}, manifest.get("settings", {})


def export_json(patterns: DataFrame, path: str) -> None:
    patterns.orderBy(id_number(F.col("id")), "id").write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """Patterns (unknown keys are ignored) and the next free number."""
    found = spark.read.schema(schema).json(path)
    top = found.agg(F.max(id_number(F.col("id")))).first()[0]
    return found, (top or 0) + 1


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
