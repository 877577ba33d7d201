from sparkloom import plans
from sparkloom.plans import retrieval

PASSAGE = "alpha bravo charlie delta echo foxtrot"


def tables(spark, path):
    rows = [(1, "Alpha bravo_charlie deltaEcho", "en", "src0"), (2, "alpha bravo charlie delta", "en", "src1"), (3, "alpha bravo charlie", "de", "src0"), (3, "delta echo foxtrot alpha", "de", "src0"), (4, None, "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, PASSAGE), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_shared_words_are_counted_as_in_sql(spark, tmp_path, monkeypatch):
    """A document in two rows shares the words of both, as in the SQL, also if the words are too many for a broadcast."""
    tables(spark, f"file://{tmp_path}")
    for words in (retrieval.BROADCAST_WORDS, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_WORDS", words)
        found = plans.queries()["scope_score"](spark, f"file://{tmp_path}")
        assert sorted(map(tuple, found.collect())) == [(7, 1, 5, 95), (7, 3, 7, 32), (7, 3, 7, 32)]
