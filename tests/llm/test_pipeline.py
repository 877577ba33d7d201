from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from sparkloom.llm import quality

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    first = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialise(stage(spark, docs, SMALL), "test")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    found = quality.measured(first)
    good = quality.scores(found, quality.fit(found, spark.read.parquet(f"{SMALL}/labels.parquet"))).where(F.col("score") >= 0.7).count()
    assert sizes[1] == good
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    assert docs.select("doc_id").distinct().count() == sizes[-1]


def test_run_is_registered(spark):
    from sparkloom.llm import queries

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "repeats", "packing"]
    assert "pipeline" in queries.queries() and Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


def test_stages_take_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that operators use too."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "a" * 200_000, None, "s", 200_000), (10_004, " \n\t ", "de", None, 4)]
    long = docs.orderBy("doc_id").limit(3).selectExpr("doc_id + 20000 AS doc_id", "repeat(text, 40) AS text", "lang", "source", "n_chars * 40 AS n_chars")
    same = docs.orderBy("doc_id").limit(20).selectExpr("doc_id + 30000 AS doc_id", "text", "lang", "source", "n_chars")
    rows = docs.union(spark.createDataFrame(odd, docs.schema)).union(long).union(same)
    rows = rows.selectExpr("*", "doc_id AS _id", "'l' AS left", "1 AS h", "2L AS key", "'m' AS label", "0.5 AS score", "3 AS x", "4L AS component_id", "null AS marks")
    names, part = rows.columns, rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        part = corpus_pipeline.materialise(stage(spark, part, SMALL), "test")
        assert part.columns == names, name
    kept = {r.doc_id for r in part.select("doc_id").collect()}
    assert kept and not kept & {10_001, 10_002, 10_004}
    assert part.where("_id <> doc_id OR left <> 'l' OR h <> 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, part, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SMALL), "test")
        assert docs.count() == 0
