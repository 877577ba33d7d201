"""Neighbour search by an index: every fiftieth vector asks, all others are candidates, labels are the metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import neighbours as N

from .registry import Tables, query


def _rows(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))


GOOD = "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])"


def _recall_sql(filtered: bool) -> str:
    others = "(SELECT count(*) FROM g c WHERE c.vec_id <> q.vec_id AND c.label = q.label)" if filtered else "(SELECT count(*) - 1 FROM g)"
    return f"WITH g AS ({GOOD}), n AS (SELECT least(10, {others}) AS n FROM g q WHERE vec_id % 50 = 0) SELECT count(*) FILTER (n > 0) AS questions, CAST(coalesce(sum(n), 0) AS BIGINT) AS neighbours, true AS recall_reached FROM n"


def _recall(t: Tables, filtered: bool) -> DataFrame:
    rows = _rows(t)
    index, asked = N.built(rows), rows.where("id % 50 = 0")
    true = N.materialise(N.exact(index, asked, 10, filtered), "true")
    reached = N.recall(N.search(index, asked, 10, filtered), true) >= 0.9
    return true.agg(F.countDistinct("query_id").alias("questions"), F.count("*").alias("neighbours")).withColumn("recall_reached", F.lit(reached))


@query(_recall_sql(False))
def index_recall(t: Tables) -> DataFrame:
    """How many questions the index answers, how many true neighbours they have, and whether it finds nine in ten."""
    return _recall(t, False)


@query(_recall_sql(True))
def index_recall_filtered(t: Tables) -> DataFrame:
    """The same where only rows of the question's own label count."""
    return _recall(t, True)


@query(f"""WITH g AS (SELECT e.vec_id, e.label, [CAST(x AS DOUBLE) FOR x IN e.embedding] AS v FROM embeddings e JOIN ({GOOD}) USING (vec_id)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS item, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM g q JOIN g c ON q.label = c.label AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, item, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS INTEGER) AS position FROM s QUALIFY position <= 10""")
def index_exact_filtered(t: Tables) -> DataFrame:
    """The ten nearest vectors of the question's own label, by the index's exact way."""
    rows = _rows(t)
    return N.exact(N.built(rows), rows.where("id % 50 = 0"), 10, True).select("query_id", "item", F.round("score", 6).alias("score"), "position")


@query()
def index_filtered_afterwards(t: Tables) -> DataFrame:
    """What is left of the ten nearest vectors of any label when those of another label are dropped."""
    rows = _rows(t)
    return N.searched_then_filtered(N.built(rows), rows.where("id % 50 = 0"), rows).select("query_id", "item", F.round("score", 6).alias("score"), "position")
