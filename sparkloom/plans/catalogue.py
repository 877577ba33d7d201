"""Inventories of what a graph holds: chunks, mentions, evidence of edges, requirements with targets and support."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators.steps import growing, materialise

from .graph import requirement_hints
from .registry import Tables, query

#: Parts of mentions for each part of the table as it is read.
MENTION_PARTS = 8


@query("""WITH c AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS nth FROM documents QUALIFY nth <= 401)
SELECT c.doc_id, c.source, CAST(nth AS INTEGER) AS nth, (SELECT max(nth) > 400 FROM c) AS truncated, count(l.doc_id) AS mentions, bool_or(coalesce(l.toxic = 1, false)) AS flagged FROM c LEFT JOIN labels l ON l.doc_id = c.doc_id WHERE nth <= 400 GROUP BY ALL""")
def chunk_inventory(t: Tables) -> DataFrame:
    """The first 400 chunks by source and id, whether there are more, and what is said of each: the bound comes first."""
    head = G.bounded(t.documents.select("doc_id", "source"), [F.asc_nulls_first("source"), F.asc("doc_id")], 400)
    said = t.labels.select(F.col("doc_id").alias("of"), (F.col("toxic") == 1).alias("toxic"))
    rows = head.join(said, head.doc_id == said.of, "left")
    return rows.groupBy("doc_id", "source", "nth", "truncated").agg(F.count("of").alias("mentions"), F.bool_or(F.coalesce("toxic", F.lit(False))).alias("flagged"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS entity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey), k AS (SELECT *, row_number() OVER (ORDER BY chunk, entity) AS nth FROM m QUALIFY nth <= 2001)
SELECT chunk, entity, CAST(nth AS INTEGER) AS nth, (SELECT max(nth) > 2000 FROM k) AS truncated FROM k WHERE nth <= 2000""")
def mention_inventory(t: Tables) -> DataFrame:
    """The first 2,000 mentions whose chunk and entity are both there, and whether there are more."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    # Parts follow the table's size, so that what a task holds does not: mentions meet both tables in as many. What meets by entity is told apart there, too.
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), MENTION_PARTS * rows.rdd.getNumPartitions())
    dealt = lambda df, key: growing(df.repartition(parts, key))
    rows = rows.join(dealt(t.orders.select(F.col("o_orderkey").alias("chunk")), "chunk"), "chunk", "left_semi")
    rows = rows.join(dealt(t.part.select(F.col("p_partkey").alias("entity")), "entity"), "entity", "left_semi")
    return G.bounded(rows.select("chunk", "entity").distinct(), [F.asc("chunk"), F.asc("entity")], 2000).select("chunk", "entity", "nth", "truncated")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_orderkey AS evidence FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT DISTINCT a.l_partkey AS src, b.l_suppkey AS dst, a.l_orderkey AS evidence FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE (a.l_partkey, b.l_suppkey) IN (SELECT (src, dst) FROM e)),
u AS (SELECT src, dst, evidence, true AS own, false AS said FROM e UNION ALL SELECT src, dst, evidence, false, true FROM p)
SELECT src, dst, evidence, bool_or(own) AS own, bool_or(said) AS said FROM u GROUP BY ALL""")
def edge_evidence(t: Tables) -> DataFrame:
    """Evidence of each returned part and supplier: the chunks that the edge names itself, and those that mention both
    its ends, a row for each."""
    edges = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("evidence")).distinct()
    pairs = materialise(edges.select("src", "dst").distinct(), "pairs")
    said = t.lineitem.select(F.col("l_orderkey").alias("evidence"), F.col("l_partkey").alias("src")).distinct().join(t.lineitem.select(F.col("l_orderkey").alias("evidence"), F.col("l_suppkey").alias("dst")).distinct(), "evidence")
    said = said.join(pairs, ["src", "dst"], "left_semi").select("src", "dst", "evidence")
    mark = lambda rows, own: rows.select("src", "dst", "evidence", F.lit(own).alias("own"), F.lit(not own).alias("said"))
    return mark(edges, True).union(mark(said, False)).groupBy("src", "dst", "evidence").agg(F.bool_or("own").alias("own"), F.bool_or("said").alias("said"))


HINTS = """h AS (SELECT c_custkey, score FROM (SELECT c_custkey, CAST((CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') THEN 8 ELSE 0 END) + (CASE WHEN n_regionkey = 1 THEN 4 ELSE 0 END) + (CASE WHEN c_acctbal > 5000 THEN 3 ELSE 0 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END) + (CASE WHEN c_name LIKE '%1' THEN 1 ELSE 0 END) AS INTEGER) AS score FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE score > 0 ORDER BY score DESC, c_custkey LIMIT 500)"""


@query(f"""WITH {HINTS}, l AS (SELECT DISTINCT c_custkey, l_partkey, o_orderkey FROM h JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey),
g AS (SELECT c_custkey, l_partkey AS target, count(*) AS support FROM l GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY support DESC, target) AS nth FROM g),
s AS (SELECT c_custkey, count(DISTINCT l_partkey) AS n, count(DISTINCT o_orderkey) AS m FROM l GROUP BY 1),
b AS (SELECT c_custkey, string_agg(target || 'x' || support, ',' ORDER BY nth) AS best FROM t WHERE nth <= 8 GROUP BY 1)
SELECT h.c_custkey, score, coalesce(n, 0) AS targets, coalesce(m, 0) AS supports, coalesce(best, '') AS first_targets FROM h LEFT JOIN s ON s.c_custkey = h.c_custkey LEFT JOIN b ON b.c_custkey = h.c_custkey""")
def requirement_targets(t: Tables) -> DataFrame:
    """The hinted requirements with how many targets and supporting chunks each has, and its eight best supported targets."""
    hints = materialise(requirement_hints(t), "hints")
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey")).join(hints.select("c_custkey"), "c_custkey", "left_semi")
    lines = materialise(orders.join(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey").distinct(), "lines")
    per = lines.groupBy("c_custkey").agg(F.countDistinct("l_partkey").alias("targets"), F.countDistinct("l_orderkey").alias("supports"))
    best = lines.groupBy("c_custkey", "l_partkey").agg(F.count("*").alias("support"))
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("support"), "l_partkey"))).where("nth <= 8")
    text = F.concat(F.col("l_partkey").cast("string"), F.lit("x"), F.col("support").cast("string"))
    first = best.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", text.alias("s")))), lambda x: x["s"]), ",").alias("first_targets"))  # eight each
    out = hints.join(per, "c_custkey", "left").join(first, "c_custkey", "left")
    return out.select("c_custkey", "score", F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("supports", F.lit(0)).alias("supports"), F.coalesce("first_targets", F.lit("")).alias("first_targets"))
