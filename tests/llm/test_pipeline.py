import corpus_pipeline
from patternfold.llm import jaccard_regions, language_bits, packing, queries, weak_rules


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "123", None, None, None)], docs.schema)
    first = corpus_pipeline.language(spark, docs.unionByName(odd), small)
    assert first.columns == docs.columns and first.where("doc_id >= 9001").count() == 0 and first.count() == docs.count()
    second = corpus_pipeline.quality(spark, first, small)
    want = {r.doc_id for r in weak_rules.judge(first).where("kept").collect()}
    assert {r.doc_id for r in second.collect()} == want and second.columns == docs.columns
    third = corpus_pipeline.near_duplicates(spark, second.unionByName(second.orderBy("doc_id").limit(1)), small)
    groups = {r.component_id for r in jaccard_regions.join_components(second).collect()}
    ids = [r.doc_id for r in third.collect()]
    assert sorted(ids) == sorted(groups) and third.columns == docs.columns
    last = corpus_pipeline.windows(spark, third, small)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(ids)
    assert last.count() == packing.pack(third).count()


def test_rows_without_ids(spark, small):
    """Copies go whether they have an id or not; texts of their own stay; very long texts and clashing columns pass through."""
    text = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"long{i % 9000}x{i}" for i in range(30000))
    rows = [(7, text), (3, text + " and more"), (None, text), (None, "only this one without an id at all here"), (None, None), (None, None), (9, ""), (5, long), (6, long), (5, long), (8, "x"), (8, "y")]
    docs = spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _doc string, component_id int")
    got = sorted(r.component_id for r in corpus_pipeline.near_duplicates(spark, docs, small).collect())
    assert got == [1, 3, 4, 5, 6, 7, 10, 11] or got == [1, 3, 4, 5, 6, 9, 10, 11]
    kept = corpus_pipeline.quality(spark, docs, small)
    assert kept.columns == docs.columns and {r.component_id for r in kept.collect()} <= set(range(12)) - {4, 5, 6, 10, 11}


def test_empty(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0, name


def test_registered():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and language_bits.UNKNOWN == "und"
