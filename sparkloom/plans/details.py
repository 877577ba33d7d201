"""Details of records: blobs, lists, rollups, filtered neighbours, scopes, batches and comparisons of revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import classify as C
from sparkloom.functions import identity as I
from sparkloom.operators import evidence as E
from sparkloom.operators import retrieval as R

from .registry import Tables, query


@query("""WITH w AS (SELECT DISTINCT l_orderkey AS sha, l_linenumber AS path FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS sha, l_linenumber AS path, max(l_extendedprice) AS size FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT w.sha, w.path, CASE WHEN b.size IS NULL THEN 'ABSENT' WHEN b.size > 90000 THEN 'TOO_LARGE' ELSE 'PRESENT' END AS status FROM w LEFT JOIN b ON b.sha = w.sha AND b.path = w.path""")
def blob_reads(t: Tables) -> DataFrame:
    """Files asked for by revision and path, with what a read of each finds."""
    key = [F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("path")]
    wanted = t.lineitem.where("l_returnflag = 'R'").select(*key).distinct()
    blobs = t.lineitem.where("l_linestatus = 'F'").groupBy(*key).agg(F.max("l_extendedprice").alias("size"))
    status = C.first_match([(F.col("size").isNull(), "ABSENT"), (F.col("size") > 90_000, "TOO_LARGE")], "PRESENT")
    return wanted.join(blobs, ["sha", "path"], "left").select("sha", "path", status.alias("status"))


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT id, o_orderkey, c_name FROM r JOIN customer ON c_custkey = id WHERE n = 1 AND o_orderstatus = 'F' AND contains(lower(c_name), '7')""")
def repository_list(t: Tables) -> DataFrame:
    """The first row of each repository, of one state and with the searched text in its name."""
    first = E.preferred(t.orders.withColumnRenamed("o_custkey", "id"), "id", F.col("o_orderkey").asc()).where("o_orderstatus = 'F'")
    return first.join(t.customer, F.col("c_custkey") == F.col("id")).where(F.lower("c_name").contains("7")).select("id", "o_orderkey", "c_name")


@query("""WITH c AS (SELECT l_partkey, CAST(max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS INTEGER) AS classification FROM lineitem GROUP BY 1), m AS (SELECT l_partkey, 'pr' AS kind, l_orderkey AS id FROM lineitem UNION SELECT l_partkey, 'finding', l_suppkey FROM lineitem) SELECT l_partkey, classification, kind, id FROM c JOIN m USING (l_partkey)""")
def risk_sets(t: Tables) -> DataFrame:
    """Worst classification of each decision, and the sets of its reviews and findings, a row for each member."""
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    worst = t.lineitem.groupBy("l_partkey").agg(F.max(rank).alias("classification"))
    member = lambda kind, c: t.lineitem.select("l_partkey", F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return member("pr", "l_orderkey").union(member("finding", "l_suppkey")).distinct().join(worst, "l_partkey").select("l_partkey", "classification", "kind", "id")


@query("""WITH p AS (SELECT list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS s FROM pages), x AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS prefix, array_to_string(s[1:i + 1], '/') AS below FROM (SELECT s, unnest(range(1, len(s) - 1)) AS i FROM p WHERE len(s) > 2))
SELECT prefix, count(*) AS directory_count FROM x GROUP BY prefix""")
def manifest_directories(t: Tables) -> DataFrame:
    """How many directories each directory of a manifest holds."""
    parts = F.filter(F.split(F.regexp_replace("url", "^https?://", ""), "/"), lambda x: x != "")
    rows = t.pages.select(parts.alias("s")).where("size(s) > 2")
    path = lambda n: F.array_join(F.slice("s", F.lit(1), n), "/")
    steps = F.transform(F.sequence(F.lit(1), F.size("s") - 2), lambda i: F.struct(path(i).alias("prefix"), path(i + 1).alias("below")))
    return rows.select(F.inline(steps)).distinct().groupBy("prefix").agg(F.count("*").alias("directory_count"))


@query(r"""WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/abs' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'a//b' WHEN 3 THEN 'a\b' ELSE 'src/f' || doc_id END AS path FROM documents) SELECT doc_id, path, NOT regexp_matches(path, '^/|\\|(^|/)\.\.?(/|$)|//') AS valid FROM p""")
def plan_paths(t: Tables) -> DataFrame:
    """Paths of a plan, and whether each is inside the repository."""
    i = F.col("doc_id")
    path = C.first_match([(i % 6 == 0, F.lit("/abs")), (i % 6 == 1, F.lit("a/../b")), (i % 6 == 2, F.lit("a//b")), (i % 6 == 3, F.lit("a\\b"))], F.concat(F.lit("src/f"), i.cast("string")))
    rows = t.documents.select("doc_id", path.alias("path"))
    return rows.select("doc_id", "path", C.valid_path(F.col("path")).alias("valid"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IN (SELECT label FROM embeddings WHERE vec_id = 0)), s AS (SELECT a.vec_id AS query_id, b.vec_id AS item, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS position FROM s)
SELECT query_id, item, round(score, 6) AS score, CAST(position AS INTEGER) AS position FROM r WHERE position <= 8""")
def filtered_topk(t: Tables) -> DataFrame:
    """The eight nearest of one label: the filter comes before the search, so none of them can be missed."""
    label = t.embeddings.where("vec_id = 0").select("label")
    rows = t.embeddings.join(label, "label", "left_semi").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.ranked(R.most_similar(rows, F.col("id") % 50 == 0, 8), "query_id", "item", 8).select("query_id", "item", F.round("score", 6).alias("score"), "position")


@query("""SELECT p_partkey, CAST((CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 4 ELSE 0 END) + (CASE WHEN p_brand = 'Brand#2' THEN 3 ELSE 0 END) + (CASE WHEN p_size > 40 THEN 2 ELSE 0 END) + (CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice > 1800 THEN 1 ELSE 0 END) AS INTEGER) AS score FROM part""")
def stored_hints(t: Tables) -> DataFrame:
    """Hints of stored requirements: entity 4, community 3, repository 2, language as it is spelt 1, open 1."""
    hit = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("entity", F.lit(4))
    add = lambda test, n: F.when(F.expr(test), n).otherwise(0)
    score = F.coalesce("entity", F.lit(0)) + add("p_brand = 'Brand#2'", 3) + add("p_size > 40", 2) + add("p_type = 'SMALL'", 1) + add("p_retailprice > 1800", 1)
    return t.part.join(hit, "p_partkey", "left").select("p_partkey", score.cast("int").alias("score"))


@query(r"""WITH x AS (SELECT c_custkey AS rule, c_nationkey, 'Supplier#' || lpad(CAST(c_custkey % 130 AS VARCHAR), 9, '0') AS name, c_acctbal > 0 AS whole, c_mktsegment <> 'BUILDING' AS scoped, c_custkey % 9 > 0 AS cited FROM customer), m AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49), r AS (SELECT x.*, s_suppkey, m.l_suppkey IS NOT NULL AS has FROM x LEFT JOIN supplier ON lower(regexp_replace(s_name, '[\s_\-]+', '', 'g')) = lower(regexp_replace(x.name, '[\s_\-]+', '', 'g')) LEFT JOIN m ON m.l_suppkey = s_suppkey)
SELECT rule, CASE WHEN cited AND whole AND scoped AND has THEN s_suppkey END AS community, CASE WHEN NOT cited THEN 'NO_EVIDENCE' WHEN NOT scoped OR NOT whole THEN 'NOT_WHOLE_SCOPE' WHEN s_suppkey IS NULL THEN 'UNKNOWN_NAME' WHEN NOT has THEN 'NO_MEMBER' ELSE 'RESOLVED' END AS state FROM r""")
def scope_resolution(t: Tables) -> DataFrame:
    """Communities that rules govern: only by a name or alias of the community, only with evidence and for the
    whole scope, and only if the community has a member."""
    rows = t.customer.select(F.col("c_custkey").alias("rule"), F.concat(F.lit("SUPPLIER #"), F.lpad((F.col("c_custkey") % 130).cast("string"), 9, "0")).alias("name"), (F.col("c_acctbal") > 0).alias("whole"), (F.col("c_mktsegment") != "BUILDING").alias("scoped"), (F.col("c_custkey") % 9 > 0).alias("cited"))
    known = t.supplier.select(I.squeezed(F.col("s_name")).alias("key"), "s_suppkey")
    members = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("has", F.lit(True))
    found = rows.withColumn("key", I.squeezed(F.col("name"))).join(known, "key", "left").join(members, "s_suppkey", "left")
    state = C.first_match([(~F.col("cited"), "NO_EVIDENCE"), (~F.col("scoped") | ~F.col("whole"), "NOT_WHOLE_SCOPE"), (F.col("s_suppkey").isNull(), "UNKNOWN_NAME"), (F.col("has").isNull(), "NO_MEMBER")], "RESOLVED")
    return found.select("rule", F.when(state == "RESOLVED", F.col("s_suppkey")).alias("community"), state.alias("state"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS evidence FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), b AS (SELECT l_orderkey, sha256(evidence) AS batch, count(*) AS decisions FROM d GROUP BY ALL) SELECT b.* FROM b WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def enrichment_batches(t: Tables) -> DataFrame:
    """Decisions with one evidence set are enriched together; records that are up to date are left out."""
    stale = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    sets = t.lineitem.where("l_returnflag <> 'N'").groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ",").alias("evidence"))
    return sets.groupBy("l_orderkey", I.digest(F.col("evidence")).alias("batch")).agg(F.count("*").alias("decisions")).join(stale, "l_orderkey", "left_anti")


@query("""WITH n AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS i, count(*) OVER (PARTITION BY l_partkey) AS total FROM lineitem) SELECT l_partkey, count(*) AS shown, max(total) > 20 AS truncated, CAST(max(l_orderkey) AS BIGINT) AS last FROM n WHERE i <= 20 GROUP BY 1""")
def knowledge_detail(t: Tables) -> DataFrame:
    """The first twenty relations of each entity, and whether there are more: one row beyond tells."""
    head = R.capped(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", [F.asc("l_orderkey"), F.asc("l_linenumber")], 21)
    shown = F.col("nth") <= 20
    return head.groupBy("l_partkey").agg(F.count_if(shown).alias("shown"), (F.max("nth") > 20).alias("truncated"), F.max(F.when(shown, F.col("l_orderkey"))).alias("last"))


@query("""WITH m AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 4 > 0), b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 9 = 0 THEN lang ELSE text END) AS h FROM documents WHERE doc_id % 5 > 0), h AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN source ELSE text END) AS h FROM documents WHERE doc_id % 6 > 0)
SELECT coalesce(m.path, b.path, h.path) AS path, CASE WHEN m.h IS NULL AND h.h IS NULL THEN 'ABSENT' WHEN m.h IS NULL THEN 'ADDED' WHEN h.h IS NULL THEN 'DELETED' WHEN m.h = h.h THEN 'UNCHANGED' ELSE 'MODIFIED' END AS comparison, CASE WHEN b.h IS NULL THEN 'BASE_ABSENT' WHEN m.h IS NOT NULL AND m.h = b.h THEN 'BASE_SAME' ELSE 'BASE_MOVED' END AS base_state FROM m FULL JOIN b ON b.path = m.path FULL JOIN h ON h.path = coalesce(m.path, b.path)""")
def revision_comparison(t: Tables) -> DataFrame:
    """Each file at merge base, target base and head: what the change did, and whether the base moved on. The
    three revisions are made of the documents, each without some."""
    side = lambda name, gone, edit: t.documents.where(F.col("doc_id") % gone > 0).select(F.col("doc_id").alias("path"), I.digest(edit).alias(name))
    text = F.col("text")
    three = side("m", 4, text).join(side("b", 5, F.when(F.col("doc_id") % 9 == 0, F.col("lang")).otherwise(text)), "path", "full").join(side("h", 6, F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(text)), "path", "full")
    m, b, h = F.col("m"), F.col("b"), F.col("h")
    comparison = C.first_match([(m.isNull() & h.isNull(), "ABSENT"), (m.isNull(), "ADDED"), (h.isNull(), "DELETED"), (m == h, "UNCHANGED")], "MODIFIED")
    return three.select("path", comparison.alias("comparison"), C.first_match([(b.isNull(), "BASE_ABSENT"), (m == b, "BASE_SAME")], "BASE_MOVED").alias("base_state"))


@query("""WITH j AS (SELECT user_id, max(event_id) AS last, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), o AS (SELECT user_id, min(event_id) AS intent FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT j.user_id, n, CASE WHEN intent IS NULL THEN 'NO_INTENT' ELSE 'DUE' END AS reason FROM j LEFT JOIN o ON o.user_id = j.user_id WHERE intent IS NULL OR intent < last ORDER BY last, j.user_id LIMIT 50""")
def due_with_intents(t: Tables) -> DataFrame:
    """Jobs that are due: without an intent in the outbox, or with one whose time has come; fifty at most."""
    jobs = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").alias("last"), F.count("*").alias("n"))
    outbox = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("intent"))
    rows = jobs.join(outbox, "user_id", "left").where("intent IS NULL OR intent < last").orderBy("last", "user_id").limit(50)
    return rows.select("user_id", "n", F.when(F.col("intent").isNull(), "NO_INTENT").otherwise("DUE").alias("reason"))
