"""The numbered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, codes, ctw, html, langid, linededup, minhash, packing, quality, suffix, topk, vecdup
from .common import fold, materialise


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predictions(docs, langid.fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = materialise(quality.measured(docs), "statistics")
    scored = quality.scores(found, quality.fit(found, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(read(spark, sf_dir, "pages"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(read(spark, sf_dir, "documents"), k=4)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removals(read(spark, sf_dir, "documents"))


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.scored(read(spark, sf_dir, "documents"))
    held = (fold(F.col("doc_id"), 10) == 0).alias("held_out")
    return found.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op10_vecdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vecdup.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(read(spark, sf_dir, "embeddings"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(read(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.id, l.b FROM c JOIN l ON c.reach = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.component_id, m.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT id, min(reach) AS component_id FROM c GROUP BY id) m ON m.id = e.vec_id
"""

#: Division that rounds down, for whole numbers of any sign.
DOWN = "(({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b})"
USABLE = "embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])"


def _op11_sql() -> str:
    """Rounds of (part, entry, pos, x), one component a row, as tables that build on each other."""
    near = "SELECT vec_id, part, entry, d FROM (SELECT v.vec_id, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{n} c USING (part, pos) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1"
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings WHERE {USABLE})",
        "v AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(e) // 8) AS part, (i - 1) % (len(e) // 8) AS pos, e[i] AS x FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM k))",
        "c0 AS MATERIALIZED (SELECT part, nth - 1 AS entry, pos, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS nth FROM k QUALIFY nth <= 16) USING (vec_id))",
    ]
    for n in range(6):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        steps.append(f"m{n} AS MATERIALIZED (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM a{n} JOIN v USING (vec_id, part) GROUP BY ALL)")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT part, entry, pos, CAST(CASE WHEN m.n IS NULL THEN c.x ELSE {DOWN.format(a='m.s', b='m.n')} END AS BIGINT) AS x FROM c{n} c LEFT JOIN m{n} m USING (part, entry, pos))")
    steps.append(f"z AS MATERIALIZED ({near.format(n=6)})")
    steps.append("o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id)")
    steps.append("h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c6)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id) CROSS JOIN h"


OP12_SQL = """
WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS nth FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM p),
r AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, k.nth, k.line, r.low IS NOT NULL AND r.low <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""


def _op13_sql() -> str:
    """Rounds of (c, pos, x), one component a row, as tables that build on each other."""
    near = "SELECT vec_id, c, d FROM (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{n} c USING (pos) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings WHERE len(embedding) = 64 AND {USABLE})",
        "v AS MATERIALIZED (SELECT vec_id, i AS pos, e[i] AS x FROM (SELECT vec_id, e, unnest(range(1, 65)) AS i FROM k))",
        "c0 AS MATERIALIZED (SELECT nth - 1 AS c, pos, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) AS nth FROM k QUALIFY nth <= 8) USING (vec_id))",
    ]
    for n in range(10):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        steps.append(f"m{n} AS MATERIALIZED (SELECT c, pos, sum(x) AS s, count(*) AS n FROM a{n} JOIN v USING (vec_id) GROUP BY ALL)")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, pos, CAST(CASE WHEN m.n IS NULL THEN b.x ELSE {DOWN.format(a='m.s', b='m.n')} END AS BIGINT) AS x FROM c{n} b LEFT JOIN m{n} m USING (c, pos))")
    steps.append(f"z AS MATERIALIZED ({near.format(n=10)})")
    steps.append("h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c10 GROUP BY c)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM z JOIN h USING (c)"


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top, beside the package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_packing, op2_langid, op3_quality, op4_html, op5_minhash, op6_suffix, op7_ctw, op8_bpe, op9_topk, op10_vecdup, op11_codes, op12_lines, op13_clusters, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op9_topk": OP9_SQL, "op10_vecdup": OP10_SQL, "op11_codes": _op11_sql(), "op12_lines": OP12_SQL, "op13_clusters": _op13_sql()}
