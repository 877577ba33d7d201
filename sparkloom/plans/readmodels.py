"""Read models: orders as jobs, lines as findings, parts and customers as what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import classify as C
from sparkloom.operators import retrieval as R

from .registry import Tables, query


@query("""WITH c AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT (SELECT count(*) FROM orders) AS jobs, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS reviewed, (SELECT count(*) FROM c) AS confirmed, (SELECT count(*) FROM p WHERE l_orderkey NOT IN (SELECT l_orderkey FROM c)) AS potential, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N') AS unmapped""")
def overview_kpis(t: Tables) -> DataFrame:
    """Potential is what is not confirmed: both flags of an order meet in one aggregate."""
    has = lambda flag: F.bool_or(F.col("l_returnflag") == flag)
    per = t.lineitem.groupBy("l_orderkey").agg(has("R").alias("confirmed"), has("A").alias("potential"), F.count_if(F.col("l_returnflag") == "N").alias("unmapped"))
    found = per.agg(F.count_if("confirmed").alias("confirmed"), F.count_if(F.col("potential") & ~F.col("confirmed")).alias("potential"), F.coalesce(F.sum("unmapped"), F.lit(0)).alias("unmapped"))
    jobs = t.orders.agg(F.count("*").alias("jobs"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("reviewed"))
    return jobs.crossJoin(found).select("jobs", "reviewed", "confirmed", "potential", "unmapped")  # one row each


@query("""WITH r AS (SELECT p_brand, p_type, max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS classification, count(DISTINCT l_suppkey) AS suppliers, count(*) AS findings FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_brand, p_type, CAST(classification AS INTEGER) AS classification, suppliers, findings FROM r ORDER BY classification DESC, findings DESC, p_brand, p_type LIMIT 50""")
def risk_rollup(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    by_supplier = rows.groupBy("p_brand", "p_type", "l_suppkey").agg(F.max(rank).alias("classification"), F.count("*").alias("n"))
    found = by_supplier.groupBy("p_brand", "p_type").agg(F.max("classification").alias("classification"), F.count("l_suppkey").alias("suppliers"), F.sum("n").alias("findings"))
    return found.orderBy(F.desc("classification"), F.desc("findings"), "p_brand", "p_type").limit(50)


@query("""WITH o AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)
SELECT o_orderkey, c_name, n_name, coalesce(n, 0) AS findings FROM o JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = o_orderkey""")
def recent_reviews(t: Tables) -> DataFrame:
    """The ten newest jobs with what belongs to them: the bound comes before the joins."""
    head = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    lines = t.lineitem.join(F.broadcast(head.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = head.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", "c_name", "n_name", F.coalesce("n", F.lit(0)).alias("findings"))


CODES = ["INDEX_UNAVAILABLE", "SCAN_FAILED", "HASH_MISMATCH", "SCOPE_INCOMPLETE", "CATALOG_TRUNCATED", "QUERY_OMITTED", "UNIT_OMITTED", "PATH_REJECTED", "VECTOR_REJECTED", "LIMIT_REACHED", "CHUNK_OMITTED", "SOURCE_STALE", "TEXT_CUT", "EDGE_OMITTED", "ENTITY_OMITTED", "SEED_OMITTED", "RULE_OMITTED", "FILE_BINARY", "FILE_TOO_LARGE", "OTHER"]


@query("""WITH e AS (SELECT ['INDEX_UNAVAILABLE','SCAN_FAILED','HASH_MISMATCH','SCOPE_INCOMPLETE','CATALOG_TRUNCATED','QUERY_OMITTED','UNIT_OMITTED','PATH_REJECTED','VECTOR_REJECTED','LIMIT_REACHED','CHUNK_OMITTED','SOURCE_STALE','TEXT_CUT','EDGE_OMITTED','ENTITY_OMITTED','SEED_OMITTED','RULE_OMITTED','FILE_BINARY','FILE_TOO_LARGE','OTHER'][CAST(json_extract(props, '$.k') AS BIGINT) % 20 + 1] AS code, user_id < 5 AS relevant FROM events), a AS (SELECT code, count(*) AS n, bool_or(relevant) AS relevant, regexp_matches(code, 'FAILED|MISMATCH|UNAVAILABLE|INCOMPLETE') AS integrity FROM e GROUP BY code)
SELECT code, n, relevant, integrity, CAST(row_number() OVER (ORDER BY NOT integrity, NOT relevant, n DESC, code) AS INTEGER) AS place FROM a QUALIFY place <= 12""")
def coverage_summary(t: Tables) -> DataFrame:
    """Limitations by code: those of integrity first, then relevant ones, then the commonest; twelve at most."""
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.get_json_object("props", "$.k").cast("long") % len(CODES) + 1).cast("int"))
    found = t.events.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.bool_or(F.col("user_id") < 5).alias("relevant"))
    found = found.withColumn("integrity", F.col("code").rlike("FAILED|MISMATCH|UNAVAILABLE|INCOMPLETE"))
    order = [F.desc("integrity"), F.desc("relevant"), F.desc("n"), F.asc("code")]
    return found.orderBy(*order).limit(12).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("""WITH m AS (SELECT p_partkey, p_name, p_type FROM part WHERE lower(coalesce(p_name, '')) LIKE '%widget%' AND p_type IN ('ECONOMY', 'SMALL'))
SELECT p_partkey, p_name, p_type, (SELECT count(*) FROM m) AS total FROM m ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20""")
def knowledge_search_page(t: Tables) -> DataFrame:
    """The second page of twenty, with the number of all hits."""
    hits = t.part.select("p_partkey", "p_name", "p_type").where(F.lower(F.coalesce("p_name", F.lit(""))).contains("widget") & F.col("p_type").isin("ECONOMY", "SMALL"))
    return hits.orderBy("p_name", "p_partkey").offset(20).limit(20).crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))


@query("""SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS sources, count(DISTINCT l_orderkey) AS findings FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey""")
def evidence_groups(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_returnflag <> 'N'").groupBy("l_partkey", "l_suppkey", "l_orderkey").agg(F.lit(1).alias("one"))
    found = rows.groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"), F.countDistinct("l_orderkey").alias("findings"))
    return found.select("l_partkey", F.array_join(F.col("s").cast("array<string>"), ",").alias("sources"), "findings")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([l_suppkey % 3, 10 + l_partkey % 2]) AS delta FROM lineitem), s AS (SELECT l_orderkey, delta, count(*) AS k FROM d GROUP BY ALL)
SELECT l_orderkey, n, n >= 2 AND coalesce(m = n, false) AS shared FROM n JOIN (SELECT l_orderkey, max(k) AS m FROM s GROUP BY 1) USING (l_orderkey)""")
def shared_change(t: Tables) -> DataFrame:
    """Whether two or more findings of a review, here the lines of an order, have a changed place in common;
    one finding alone shares nothing."""
    rows = t.lineitem.select("l_orderkey", F.array_distinct(F.array(F.pmod("l_suppkey", F.lit(3)), 10 + F.pmod("l_partkey", F.lit(2)))).alias("deltas"))
    n = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    most = rows.select("l_orderkey", F.explode("deltas").alias("d")).groupBy("l_orderkey", "d").agg(F.count("*").alias("k")).groupBy("l_orderkey").agg(F.max("k").alias("most"))
    return n.join(most, "l_orderkey").select("l_orderkey", "n", ((F.col("n") >= 2) & (F.col("most") == F.col("n"))).alias("shared"))


@query("""SELECT o_orderkey AS pr FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def set_union_prs(t: Tables) -> DataFrame:
    jobs = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pr"))
    return jobs.union(t.lineitem.where("l_returnflag = 'R'").select("l_orderkey")).distinct()


@query("""WITH b AS (SELECT c_custkey, c_mktsegment AS usr, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment END AS owner, CASE WHEN c_nationkey % 7 = 0 THEN 'BUILDING' ELSE '' END AS named, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal >= 3000 END AS admin, c_nationkey % 2 AS bound, CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_nationkey % 4 END AS installation, CASE CAST(floor(abs(c_acctbal)) AS BIGINT) % 4 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'NOT_INDEXED' WHEN 2 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM customer),
r AS (SELECT *, CASE WHEN (owner IS NOT NULL AND owner <> usr) OR (named <> '' AND named <> usr) THEN 'owned_by_another_user' WHEN admin IS NULL THEN 'permission_unknown' WHEN NOT admin THEN 'github_admin_required' WHEN owner = usr AND bound IS DISTINCT FROM installation THEN 'installation_binding_mismatch' ELSE 'allowed' END AS capability FROM b)
SELECT c_custkey, capability, CASE WHEN status NOT IN ('IDLE', 'NOT_INDEXED') THEN false WHEN capability = 'allowed' THEN true WHEN capability = 'permission_unknown' THEN NULL ELSE false END AS can_enable, CASE WHEN status <> 'FAILED' THEN false WHEN capability = 'allowed' THEN true WHEN capability = 'permission_unknown' THEN NULL ELSE false END AS can_retry FROM r""")
def capability_case(t: Tables) -> DataFrame:
    """Why a user may monitor a repository or not, and what follows; unknown rights stay unknown."""
    c = F.col
    owner = F.when(c("c_nationkey") % 3 == 0, c("c_mktsegment"))
    named = F.when(c("c_nationkey") % 7 == 0, "BUILDING").otherwise("")
    admin = F.when(c("c_acctbal") < 0, F.lit(None).cast("boolean")).otherwise(c("c_acctbal") >= 3000)
    installation = F.when(c("c_acctbal") > 9000, None).otherwise(c("c_nationkey") % 4)
    status = F.element_at(F.array(*map(F.lit, ("IDLE", "NOT_INDEXED", "FAILED", "COMPLETED"))), (F.floor(F.abs("c_acctbal")) % 4 + 1).cast("int"))
    reason = C.capability(c("c_mktsegment"), F.array(owner, named), admin, owner, c("c_nationkey") % 2, installation)
    rows = t.customer.select("c_custkey", reason.alias("capability"), status.alias("status"))
    can = C.monitoring(c("capability"), c("status"))
    return rows.select("c_custkey", "capability", can["can_enable"].alias("can_enable"), can["can_retry"].alias("can_retry"))


@query("""WITH f AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 48) AS conflicts, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 45) AS review FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-01-01' AS stale, o_totalprice > 60000 AS evaluated, CASE o_orderpriority[1] WHEN '1' THEN 'CONFLICTS_FOUND' WHEN '2' THEN 'REVIEW_REQUIRED' WHEN '3' THEN 'NO_CONFLICTS_FOUND' END AS outcome, coalesce(conflicts, 0) AS conflicts, coalesce(review, 0) AS review, o_orderstatus = 'F' AS complete, CASE WHEN o_totalprice > 400000 THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'QUEUED' WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE 'DEFERRED' END AS status FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN stale THEN 'STALE' WHEN NOT evaluated THEN 'NOT_EVALUATED' WHEN conflicts > 0 OR outcome = 'CONFLICTS_FOUND' THEN 'CONFLICTS' WHEN review > 0 OR outcome = 'REVIEW_REQUIRED' THEN 'NEEDS_REVIEW' WHEN outcome = 'NO_CONFLICTS_FOUND' AND complete THEN 'CLEAN' WHEN outcome = 'NO_CONFLICTS_FOUND' THEN 'CLEAN_INCOMPLETE' WHEN status = 'QUEUED' THEN 'QUEUED' WHEN status = 'RUNNING' THEN 'EVALUATING' WHEN status = 'FAILED' THEN 'UNAVAILABLE' ELSE 'NOT_EVALUATED' END AS status FROM b""")
def review_status_case(t: Tables) -> DataFrame:
    """What a list of reviews shows for each: old analyses first, then missing ones, conflicts and so on."""
    c = F.col
    n = lambda test: F.count_if(F.expr(test))
    found = t.lineitem.groupBy("l_orderkey").agg(n("l_returnflag = 'R' AND l_quantity > 48").alias("conflicts"), n("l_returnflag = 'A' AND l_quantity > 45").alias("review"))
    rows = t.orders.join(found, c("l_orderkey") == c("o_orderkey"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    stale = c("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    rank = F.substring("o_orderpriority", 1, 1)
    outcome = F.when(rank == "1", "CONFLICTS_FOUND").when(rank == "2", "REVIEW_REQUIRED").when(rank == "3", "NO_CONFLICTS_FOUND")
    status = F.when(c("o_totalprice") > 400000, "FAILED").when(c("o_orderstatus") == "O", "QUEUED").when(c("o_orderstatus") == "P", "RUNNING").otherwise("DEFERRED")
    return rows.select("o_orderkey", C.review_status(stale, c("o_totalprice") > 60000, outcome, zero("conflicts"), zero("review"), c("o_orderstatus") == "F", status).alias("status"))


@query("""WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) SELECT source, lang, doc_id, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 8""")
def seeds_per_source(t: Tables) -> DataFrame:
    """At most eight seeds of each source, longest first."""
    return R.capped(t.documents.select("source", "lang", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 8).select("source", "lang", "doc_id", "nth")
