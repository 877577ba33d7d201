"""Enrichment of requirements in two steps: a preview that changes nothing, and its application.

A requirement is enriched anew if it never was, if its source has another hash than the one it was enriched from, or if
another model did it. One without a source cannot be enriched. Applying checks the hash again: a requirement whose source
changed between the two steps is left as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "v1"


def preview(rows: DataFrame, model: str = MODEL, key: str = "doc_id", force: bool = False) -> DataFrame:
    """(key, source, now, state, action) of requirements (key, source, seen, now, model): `seen` is the source's hash when
    it was enriched, `now` its present one. With force those that are current are enriched too."""
    state = F.when(F.col("source").isNull() | F.col("now").isNull(), "UNUSABLE").when(F.col("seen").isNull(), "NEW").when(F.col("seen") != F.col("now"), "STALE_SOURCE").when(~F.col("model").eqNullSafe(F.lit(model)), "STALE_MODEL").otherwise("CURRENT")
    skip = F.lit("UNUSABLE") if force else F.col("state")
    action = F.when((F.col("state") == "UNUSABLE") | (skip == "CURRENT"), "SKIP").otherwise("ENRICH")
    return rows.select(key, "source", "now", state.alias("state")).withColumn("action", action)


def applied(rows: DataFrame, plan: DataFrame, model: str = MODEL, key: str = "doc_id") -> DataFrame:
    """rows with `seen` and `model` as an enrichment by plan (key, now, action) leaves them."""
    chosen = plan.where("action = 'ENRICH'").select(F.col(key).alias("_key"), F.col("now").alias("_now"))
    both = rows.join(chosen, (F.col(key) == F.col("_key")) & (F.col("now") == F.col("_now")), "left")
    done = F.col("_key").isNotNull()
    changed = {"seen": F.when(done, F.col("now")).otherwise(F.col("seen")), "model": F.when(done, F.lit(model)).otherwise(F.col("model"))}
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns])
