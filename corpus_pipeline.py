"""A corpus from raw documents to packed windows, in stages that each call one operator of patternfold.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder as Parquet and
reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternfold.llm import jaccard_regions, language_bits, packing, shared, weak_rules

#: A text whose best language holds a smaller share of its n-grams is in none of the known languages.
LEAST_LANGUAGE_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no known language (null texts and texts without a letter among them)."""
    model = language_bits.learn(docs, F.col("doc_id").isNotNull() & ~language_bits.held_out())
    found = language_bits.predict(docs, model)
    return found.where((F.col("lang_pred") != language_bits.UNKNOWN) & (F.col("share") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base or that the rules' posterior calls bad; equal rows share a verdict."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"))
    return weak_rules.judge(rows, "_text", keep=("_doc",)).where("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: the one with the least doc_id (one without an id only where none has one), and one of rows that are equal in all columns.

    Rows go by a hash of all their columns, so those without an id count by themselves. Were two hashes ever to meet, a
    copy might stay; no group would lose its document.
    """
    rows = docs.withColumn("_row", F.xxhash64(*docs.columns))
    found = jaccard_regions.join_components(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    kept = found.join(rows.select("_row", "doc_id").distinct(), "_row").groupBy("component_id").agg(F.min(order).alias("best")).select("best._row").distinct()
    return rows.join(kept, "_row", "left_semi").select(*docs.columns).distinct()


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of related documents."""
    return packing.pack(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", windows)]

#: The language model, the votes' expectation-maximisation and the packing can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
