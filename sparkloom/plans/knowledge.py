"""Knowledge queries: properties, associations, matches, reserved places, intents and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import classify as C
from sparkloom.functions import identity as I
from sparkloom.operators import records as R

from .registry import Tables, query

K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query(r"""WITH r AS (SELECT p_partkey, trim(regexp_replace(upper(trim(p_type || ' ' || p_brand)), '[^A-Z0-9_]', '_', 'g'), '_') AS r FROM part)
SELECT p.p_partkey, sha256(CAST(to_json([CAST(p.p_partkey AS VARCHAR), p_name, p_type]) AS VARCHAR)) AS stable, sha256('parts:' || p_brand || ':' || p_name || ':' || p_size) AS chunk, CASE WHEN r = '' THEN 'RELATED_TO' WHEN regexp_matches(r, '^[0-9]') THEN 'R_' || r ELSE r END AS relation, CASE WHEN p_name = p_type THEN '' ELSE 'edge:' || p_name || ':R:' || p_type END AS edge FROM part p JOIN r USING (p_partkey)""")
def identity_keys(t: Tables) -> DataFrame:
    """Content-addressed ids of parts, their relationship type and the id of a drawn edge."""
    c = F.col
    relation = I.relationship_type(F.concat(c("p_type"), F.lit(" "), c("p_brand")))
    edge = I.edge_id(F.concat(F.lit("entity:"), c("p_name")), F.lit("R"), c("p_type"))
    return t.part.select("p_partkey", I.stable_id(c("p_partkey"), c("p_name"), c("p_type")).alias("stable"), I.keyed_id(":", F.lit("parts"), c("p_brand"), c("p_name"), c("p_size")).alias("chunk"), relation.alias("relation"), edge.alias("edge"))


@query("""WITH p AS (SELECT p_brand, 'type' AS name, p_type AS value, p_partkey FROM part UNION ALL SELECT p_brand, 'size', CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE ' ' END, p_partkey FROM part UNION ALL SELECT p_brand, 'title', CASE WHEN p_name LIKE 's%' THEN p_name END, p_partkey FROM part)
SELECT p_brand, name, arg_min(value, p_partkey) AS value FROM p WHERE value <> '' GROUP BY ALL""")
def property_merge(t: Tables) -> DataFrame:
    """Properties of brands over their parts: the first that is not empty wins, key by key."""
    fields = {"type": F.col("p_type"), "size": F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(" "), "title": F.when(F.col("p_name").startswith("s"), F.col("p_name"))}
    props = t.part.select("p_brand", "p_partkey", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in fields.items()])))
    return R.first_non_empty(props, "p_brand", "name", "value", "p_partkey")


@query("""WITH e AS (SELECT l_partkey % 50 AS src, l_suppkey % 50 AS dst, l_returnflag AS kind FROM lineitem)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM e WHERE src <> dst GROUP BY ALL""")
def parallel_edges(t: Tables) -> DataFrame:
    edges = t.lineitem.select((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst"), F.col("l_returnflag").alias("kind"))
    return R.parallel_edges(edges).withColumn("kinds", F.array_join("kinds", ","))


@query("""SELECT o_orderkey, coalesce(m.entities, 0) AS entities, coalesce(a.assertions, 0) AS assertions, a.best FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS entities FROM lineitem GROUP BY 1) m ON m.l_orderkey = o_orderkey LEFT JOIN (SELECT user_id, count(*) AS assertions, max(value) AS best FROM events WHERE event_type = 'purchase' GROUP BY 1) a ON a.user_id = o_orderkey""")
def chunk_associations(t: Tables) -> DataFrame:
    """Orders as chunks with their entities and assertions."""
    mentions = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    asserted = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("o_orderkey"), "value")
    out = R.associated(t.orders.select("o_orderkey"), "o_orderkey", (mentions, {"entities": F.countDistinct("l_partkey")}), (asserted, {"assertions": F.count("*"), "best": F.max("value")}))
    return out.fillna(0, ["entities", "assertions"])


@query("""WITH m AS (SELECT 's' || l_suppkey AS entity, l_orderkey AS chunk FROM lineitem WHERE l_returnflag = 'N' UNION SELECT 's' || l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 'p' || l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT entity, count(*) AS chunks, min(chunk) AS first_chunk FROM m GROUP BY entity""")
def entity_evidence(t: Tables) -> DataFrame:
    """Chunks that mention an entity, or support an assertion of which it is an end."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ends = F.when(F.col("l_returnflag") == "R", F.array(name("s", "l_suppkey"), name("p", "l_partkey"))).when(F.col("l_returnflag") == "N", F.array(name("s", "l_suppkey")))
    rows = t.lineitem.select(F.explode(ends).alias("entity"), F.col("l_orderkey").alias("chunk")).distinct()
    return rows.groupBy("entity").agg(F.count("*").alias("chunks"), F.min("chunk").alias("first_chunk"))


@query("""WITH i AS (SELECT DISTINCT CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN 'gh' || user_id ELSE 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS identifier FROM events), n AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS identifier FROM customer UNION SELECT c_custkey, 'gh' || c_custkey FROM customer UNION SELECT c_custkey, c_name FROM customer)
SELECT DISTINCT c_custkey, identifier FROM n JOIN i USING (identifier)""")
def monitoring_bindings(t: Tables) -> DataFrame:
    """Repositories asked for by id, by outside id or by full name."""
    user = F.col("user_id").cast("string")
    asked = F.when(F.col("event_type") == "click", user).when(F.col("event_type") == "view", F.concat(F.lit("gh"), user)).otherwise(F.concat(F.lit("Customer#"), F.lpad(user, 9, "0")))
    key = F.col("c_custkey").cast("string")
    return R.by_alias(t.events.select(asked.alias("identifier")), t.customer, [key, F.concat(F.lit("gh"), key), F.col("c_name")], "c_custkey")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS target, min(o_orderstatus) AS kind FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'F' ELSE 'O' END AS kind FROM customer)
SELECT c_custkey, c.kind, CASE WHEN n = 1 AND o.kind = c.kind THEN target END AS target, CASE WHEN n = 1 AND o.kind = c.kind THEN 'FOUND' ELSE 'NOT_FOUND' END AS state FROM c LEFT JOIN o ON o_custkey = c_custkey""")
def unique_match(t: Tables) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "F").otherwise("O").alias("kind")
    targets = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("target"), F.col("o_orderstatus").alias("kind"))
    return R.unique_match(t.customer.select("c_custkey", kind), targets, "c_custkey", "kind")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS src, o_custkey + 1 + o_orderkey % 7 AS dst FROM orders), m AS (SELECT n_nationkey AS community, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), i AS (SELECT a.c_nationkey AS community, count(*) AS edges FROM e JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst WHERE a.c_nationkey = b.c_nationkey GROUP BY 1)
SELECT community, members, coalesce(edges, 0) AS edges FROM m LEFT JOIN i USING (community)""")
def community_contexts(t: Tables) -> DataFrame:
    """Communities with their members and the edges that stay inside."""
    home = lambda end: t.customer.select(F.col("c_custkey").alias(end), F.col("c_nationkey").alias("community"))
    edges = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 7).alias("dst")).distinct()
    inner = edges.join(home("src"), "src").join(home("dst"), ["dst", "community"])
    every = t.nation.select(F.col("n_nationkey").alias("community"))
    return R.associated(every, "community", (home("src"), {"members": F.count("*")}), (inner, {"edges": F.count("*")})).fillna(0, ["members", "edges"])


@query(f"""WITH c AS (SELECT DISTINCT lower('CUSTOMER#' || lpad(CAST(user_id AS VARCHAR), 9, '0')) AS src_key, lower('Supplier#' || lpad(CAST({K} AS VARCHAR), 9, '0')) AS dst_key FROM events)
SELECT src_key, dst_key, c_custkey AS src, s_suppkey AS dst FROM c LEFT JOIN customer ON lower(c_name) = src_key LEFT JOIN supplier ON lower(s_name) = dst_key""")
def relationship_candidates(t: Tables) -> DataFrame:
    """Pairs of extracted names, both ends resolved by their folded names."""
    key = lambda prefix, c: I.folded(F.concat(F.lit(prefix), F.lpad(c.cast("string"), 9, "0")))
    found = t.events.select(key("CUSTOMER#", F.col("user_id")).alias("src_key"), key("Supplier#", _k()).alias("dst_key")).distinct()
    entities = t.customer.select(I.folded(F.col("c_name")).alias("key"), F.col("c_custkey").alias("id")).unionByName(t.supplier.select(I.folded(F.col("s_name")).alias("key"), F.col("s_suppkey").alias("id")))
    return R.both_resolved(found, entities).select("src_key", "dst_key", "src", "dst")


@query(f"""WITH g AS (SELECT user_id, event_type AS channel, bool_or(value > 110) AS skipped, count(DISTINCT {K}) FILTER (value > 30) AS hits, coalesce(array_to_string(list_sort(list(DISTINCT 'GAP_' || ({K} % 3)) FILTER (value > 60)), ', '), '') AS detail, bool_or(value BETWEEN 50 AND 52) AS omitted FROM events GROUP BY ALL),
r AS (SELECT *, CASE WHEN skipped THEN 'SKIPPED' WHEN hits > 0 THEN 'READY' ELSE 'EMPTY' END AS raw FROM g), m AS (SELECT *, CASE WHEN detail <> '' AND raw IN ('READY', 'EMPTY') THEN CASE WHEN hits > 0 THEN 'TRUNCATED' ELSE 'UNAVAILABLE' END ELSE raw END AS mid FROM r)
SELECT user_id, channel, CASE WHEN mid IN ('READY', 'EMPTY') AND omitted THEN 'TRUNCATED' ELSE mid END AS state, hits AS distinct_candidates, detail FROM m""")
def channel_status(t: Tables) -> DataFrame:
    """State of each channel of a query: gaps cut what was found or make it unavailable, left out queries cut it."""
    gaps = F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") > 60, F.concat(F.lit("GAP_"), _k() % 3)))), ", ")
    found = t.events.groupBy("user_id", F.col("event_type").alias("channel")).agg(F.bool_or(F.col("value") > 110).alias("skipped"), F.countDistinct(F.when(F.col("value") > 30, _k())).alias("distinct_candidates"), gaps.alias("detail"), F.bool_or(F.col("value").between(50, 52)).alias("omitted"))
    raw = F.when(F.col("skipped"), "SKIPPED").when(F.col("distinct_candidates") > 0, "READY").otherwise("EMPTY")
    return found.select("user_id", "channel", C.channel_state(raw, F.col("detail") != "", F.col("distinct_candidates"), F.col("omitted")).alias("state"), "distinct_candidates", "detail")


@query("""WITH r AS (SELECT source, d.doc_id, l.doc_id IS NOT NULL AS linked, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS p FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)), f AS (SELECT *, min(p) FILTER (NOT linked) OVER (PARTITION BY source) AS f FROM r)
SELECT source, doc_id, linked, CAST(least(p, 5) AS INTEGER) AS place FROM f WHERE p < 5 OR (p = 5 AND (f IS NULL OR f <= 5)) OR (p > 5 AND p = f)""")
def reserved_place(t: Tables) -> DataFrame:
    """Five documents of each source; the last place is kept for one without a label."""
    labelled = t.labels.select("doc_id").distinct().withColumn("linked", F.lit(True))
    rows = t.documents.select("source", "doc_id", "n_chars").join(labelled, "doc_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return R.with_reserved(rows, "source", "doc_id", "linked", [F.desc("n_chars"), F.asc("doc_id")], 5).select("source", "doc_id", "linked", "place")


@query("""SELECT lang AS channel, sha256(lower(trim(text))) AS query, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS seeds FROM documents GROUP BY ALL""")
def query_merge(t: Tables) -> DataFrame:
    """Equal texts of a channel are one query with the seeds of all."""
    rows = t.documents.groupBy(F.col("lang").alias("channel"), I.digest(F.lower(F.trim("text"))).alias("query")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("seeds"))
    return rows.withColumn("seeds", F.array_join("seeds", ","))


@query(f"""WITH r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 3 ELSE 2 END AS r, {K} % 2 AS identity FROM events WHERE event_type <> 'error'), m AS (SELECT user_id, max(r) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM r),
c AS (SELECT user_id, identity IS DISTINCT FROM lag(identity) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS new FROM r WHERE r = 3), f AS (SELECT user_id, count(*) FILTER (new) AS finals FROM c GROUP BY 1)
SELECT user_id, max(m) AS intent, CAST(count(DISTINCT m) FILTER (m < 3) + coalesce(max(finals), 0) AS INTEGER) AS version FROM m LEFT JOIN f USING (user_id) GROUP BY user_id""")
def publication_intent(t: Tables) -> DataFrame:
    """What is to be published of each job; a new final evaluation raises the version as well."""
    rank = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") != "error", 2)
    return R.intents(t.events, "user_id", rank, _k() % 2, F.struct("ts", "event_id"))


@query(f"""WITH e AS (SELECT user_id, {K} AS k, event_type, value, ts, event_id FROM events)
SELECT user_id, k, arg_max(value, {{'ts': ts, 'event_id': event_id}}) AS value FROM e u WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM e d WHERE d.event_type = 'error' AND d.value > 90 AND d.user_id = u.user_id AND d.k = u.k) GROUP BY user_id, k""")
def client_reconciliation(t: Tables) -> DataFrame:
    rows = t.events.withColumn("k", _k())
    return R.reconciled(rows.where("event_type <> 'error'"), rows.where("event_type = 'error' AND value > 90"), ["user_id", "k"], "value", F.struct("ts", "event_id"))


@query("""WITH w AS (SELECT doc_id, sha256(text) AS hash FROM documents), d AS (SELECT w.doc_id, CASE WHEN quality = 1 THEN hash ELSE sha256(hash) END AS hash FROM w JOIN labels USING (doc_id)) SELECT doc_id, hash FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = w.doc_id AND d.hash = w.hash)""")
def vector_backfill(t: Tables) -> DataFrame:
    """Documents to be embedded anew: not done yet, or done with another content."""
    wanted = t.documents.select("doc_id", I.digest(F.col("text")).alias("hash"))
    done = wanted.join(t.labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("hash")).otherwise(I.digest(F.col("hash"))).alias("hash"))
    return R.pending(wanted, done, "doc_id", "hash")


@query("""SELECT 'document_id_repeats' AS "check", count(*) AS violations FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'document_size', count(*) FROM documents WHERE n_chars IS DISTINCT FROM length(text) UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'vector_size', count(*) FROM embeddings WHERE len(embedding) IS DISTINCT FROM 64 UNION ALL SELECT 'line_without_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def index_integrity(t: Tables) -> DataFrame:
    """Uniqueness, stored sizes and references; a sound index has zero rows in each check."""
    known = lambda rows, other, key, ref: rows.join(other.select(F.col(ref).alias(key)), key, "left_anti")
    return R.violations(
        document_id_repeats=t.documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"),
        document_size=t.documents.where(~F.col("n_chars").eqNullSafe(F.length("text"))),
        label_without_document=known(t.labels, t.documents, "doc_id", "doc_id"),
        vector_size=t.embeddings.where(~F.when(F.col("embedding").isNotNull(), F.size("embedding")).eqNullSafe(F.lit(64))),
        line_without_part=known(t.lineitem, t.part, "l_partkey", "p_partkey"),
    )


@query("""WITH d AS (SELECT d.doc_id, source, sha256(text) AS hash, coalesce(quality = 0, false) AS failed FROM documents d LEFT JOIN labels USING (doc_id)), f AS (SELECT source, hash, min(doc_id) FILTER (NOT failed) AS owner FROM d GROUP BY ALL)
SELECT doc_id, CASE WHEN failed THEN 'RETRYABLE' WHEN doc_id = owner THEN 'CLAIMED' ELSE 'DUPLICATE' END AS state, owner FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source AND f.hash IS NOT DISTINCT FROM d.hash""")
def duplicate_uploads(t: Tables) -> DataFrame:
    """The first upload of a content that did not fail owns it; failed ones may be tried again."""
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "source", I.digest(F.col("text")).alias("hash"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("failed"))
    owner = rows.groupBy(F.col("source").alias("s"), F.col("hash").alias("h")).agg(F.min(F.when(~F.col("failed"), F.col("doc_id"))).alias("owner"))
    out = rows.join(owner, F.col("source").eqNullSafe(F.col("s")) & F.col("hash").eqNullSafe(F.col("h")))
    return out.select("doc_id", F.when(F.col("failed"), "RETRYABLE").when(F.col("doc_id") == F.col("owner"), "CLAIMED").otherwise("DUPLICATE").alias("state"), "owner")


@query("""SELECT doc_id, list_has_any(string_split(text, ' '), ['the', 'data', 'und', 'les']) AS any_term, len(list_filter(string_split(text, ' '), lambda x: length(x) > 24)) = 0 AS all_short FROM documents""")
def term_quantifiers(t: Tables) -> DataFrame:
    """Whether any word is among the given ones, and whether all words are short."""
    words = F.split("text", " ", -1)
    return t.documents.select("doc_id", F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("the", "data", "und", "les")])).alias("any_term"), F.forall(words, lambda w: F.length(w) <= 24).alias("all_short"))


@query(f"""WITH e AS (SELECT user_id, ts, event_id, event_type, {K} % 2 AS k FROM events) SELECT user_id, (arg_min(event_type, {{'ts': ts, 'event_id': event_id}}) IS DISTINCT FROM arg_max(event_type, {{'ts': ts, 'event_id': event_id}})) OR (arg_min(k, {{'ts': ts, 'event_id': event_id}}) IS DISTINCT FROM arg_max(k, {{'ts': ts, 'event_id': event_id}})) AS changed FROM e GROUP BY user_id""")
def binding_changed(t: Tables) -> DataFrame:
    """Whether the identity of a binding differs between its first and its last row."""
    at, identity = F.struct("ts", "event_id"), F.struct("event_type", (_k() % 2).alias("k"))
    return t.events.groupBy("user_id").agg((~F.min_by(identity, at).eqNullSafe(F.max_by(identity, at))).alias("changed"))


@query("""WITH x AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 200) SELECT o_orderstatus, count(*) AS kept, min(o_orderdate) AS oldest FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x) GROUP BY 1""")
def expired_purge(t: Tables) -> DataFrame:
    """What is left after one pass of purging, 200 expired rows a pass, oldest first."""
    gone = t.orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey")
    return t.orders.join(F.broadcast(gone), "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("kept"), F.min("o_orderdate").alias("oldest"))


@query("""WITH f AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 48) AS conflicts, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 46) AS open_ FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, CASE o_orderpriority[1] WHEN '1' THEN 'NOT_EVALUATED' WHEN '2' THEN 'REVIEW_REQUIRED' WHEN '3' THEN NULL ELSE 'NO_CONFLICTS_FOUND' END AS outcome, coalesce(conflicts, 0) AS conflicts, o_orderstatus <> 'F' OR coalesce(open_, 0) > 0 AS gaps FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN outcome IS NULL OR outcome = 'NOT_EVALUATED' THEN 'action_required' WHEN conflicts > 0 THEN 'failure' WHEN gaps OR outcome <> 'NO_CONFLICTS_FOUND' THEN 'neutral' ELSE 'success' END AS conclusion FROM b""")
def check_conclusion(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus", "l_quantity")
    rows = R.associated(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", (lines, {"conflicts": F.expr("count_if(l_returnflag = 'R' AND l_quantity > 48)"), "open": F.expr("count_if(l_linestatus = 'O' AND l_quantity > 46)")}))
    rank = F.substring("o_orderpriority", 1, 1)
    outcome = F.when(rank == "1", "NOT_EVALUATED").when(rank == "2", "REVIEW_REQUIRED").when(rank != "3", "NO_CONFLICTS_FOUND")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rows.select("o_orderkey", C.check_conclusion(outcome, zero("conflicts"), (F.col("o_orderstatus") != "F") | (zero("open") > 0)).alias("conclusion"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, arg_max(o_orderpriority[1], o_orderkey) AS last FROM orders GROUP BY 1),
b AS (SELECT c_custkey, coalesce(n, 0) > 8 AS tracked, CASE last WHEN '1' THEN 'COMPLETED' WHEN '2' THEN 'INDEXING' WHEN '3' THEN 'FAILED' WHEN '4' THEN 'IDLE' WHEN '5' THEN 'NOT_INDEXED' ELSE 'ARCHIVED' END AS status, CASE c_mktsegment WHEN 'BUILDING' THEN 'owned_by_another_user' WHEN 'MACHINERY' THEN 'github_admin_required' WHEN 'HOUSEHOLD' THEN NULL ELSE 'allowed' END AS reason, CASE WHEN c_acctbal > 0 THEN true END AS admin FROM customer LEFT JOIN o ON o_custkey = c_custkey),
k AS (SELECT *, CASE status WHEN 'COMPLETED' THEN 'ready' WHEN 'INDEXING' THEN 'indexing' WHEN 'FAILED' THEN 'failed' WHEN 'IDLE' THEN 'available' WHEN 'NOT_INDEXED' THEN 'available' ELSE 'unknown' END AS known FROM b)
SELECT c_custkey, CASE WHEN tracked AND status IN ('COMPLETED', 'INDEXING', 'FAILED') THEN known WHEN reason = 'owned_by_another_user' OR (reason = 'github_admin_required' AND status IN ('IDLE', 'NOT_INDEXED', 'FAILED')) THEN 'restricted' WHEN NOT tracked THEN CASE WHEN status = 'NOT_INDEXED' THEN 'available' ELSE 'unknown' END ELSE known END AS state,
CASE WHEN admin AND reason = 'allowed' AND status IN ('IDLE', 'NOT_INDEXED') THEN 'enable' WHEN admin AND reason = 'allowed' AND tracked AND status = 'FAILED' THEN 'retry' END AS action FROM k""")
def repository_state(t: Tables) -> DataFrame:
    """State and offered action of each listed repository, here of a customer by the last order."""
    runs = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    rows = R.associated(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey", (runs, {"n": F.count("*"), "last": F.max_by(F.substring("o_orderpriority", 1, 1), "o_orderkey")}))
    states = F.create_map(*[F.lit(x) for kv in {"1": "COMPLETED", "2": "INDEXING", "3": "FAILED", "4": "IDLE", "5": "NOT_INDEXED"}.items() for x in kv])
    seg = F.col("c_mktsegment")
    reason = F.when(seg == "BUILDING", "owned_by_another_user").when(seg == "MACHINERY", "github_admin_required").when(seg != "HOUSEHOLD", "allowed")
    rows = rows.select("c_custkey", (F.coalesce("n", F.lit(0)) > 8).alias("tracked"), F.coalesce(F.try_element_at(states, F.col("last")), F.lit("ARCHIVED")).alias("status"), reason.alias("reason"), F.when(F.col("c_acctbal") > 0, True).alias("admin"))
    c = F.col
    can = C.monitoring(c("reason"), c("status"))
    return rows.select("c_custkey", C.repository_state(c("tracked"), c("status"), c("reason")).alias("state"), C.repository_action(c("tracked"), c("status"), c("reason"), c("admin"), can).alias("action"))


@query("""WITH p AS (SELECT l_orderkey, min(l_linestatus) AS low, max(l_linestatus) AS high FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN low IS NULL THEN 'MISSING' WHEN low <> high THEN 'MIXED' ELSE 'MISMATCH' END AS repair FROM orders LEFT JOIN p ON l_orderkey = o_orderkey WHERE low IS NULL OR low <> high OR low <> o_orderstatus""")
def lifecycle_repair(t: Tables) -> DataFrame:
    """Jobs whose publication is missing or tells another state."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    rows = R.associated(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", (lines, {"low": F.min("l_linestatus"), "high": F.max("l_linestatus")}))
    return rows.where("low IS NULL OR low <> high OR low <> o_orderstatus").select("o_orderkey", F.when(F.col("low").isNull(), "MISSING").when(F.col("low") != F.col("high"), "MIXED").otherwise("MISMATCH").alias("repair"))


@query("""SELECT c_custkey, 'Name: ' || c_name || chr(10) || 'Type: ' || c_mktsegment || coalesce(chr(10) || 'Scope: ' || n_name, '') AS entity_text FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def entity_texts(t: Tables) -> DataFrame:
    """The text of an entity that is embedded; missing parts have no line."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", F.concat_ws("\n", line("Name", "c_name"), line("Type", "c_mktsegment"), line("Scope", "n_name")).alias("entity_text"))


@query("""SELECT doc_id, substr(text, 1, 1200) AS excerpt, length(text) > 1200 AS truncated FROM documents""")
def knowledge_excerpt(t: Tables) -> DataFrame:
    """Documents as they are shown: at most 1200 characters, and whether there are more. The bound is what is shown."""
    return t.documents.select("doc_id", F.substring("text", 1, 1200).alias("excerpt"), (F.length("text") > 1200).alias("truncated"))


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(text, '\s+') AS ws FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, word, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) WHERE trim(word) <> '' AND length(word) <= 96 GROUP BY ALL), o AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM t),
f(doc_id, n, held, kept, terms) AS (SELECT doc_id, n, length(word), 1, word FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.n, CASE WHEN held + 1 + length(word) <= 1600 THEN held + 1 + length(word) ELSE held END, CASE WHEN held + 1 + length(word) <= 1600 THEN kept + 1 ELSE kept END, CASE WHEN held + 1 + length(word) <= 1600 THEN terms || ' ' || word ELSE terms END FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1 WHERE kept < 64 AND held <= 1598)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(x.terms, '') END AS terms FROM documents d LEFT JOIN (SELECT doc_id, arg_max(terms, n) AS terms FROM f GROUP BY 1) x ON x.doc_id = d.doc_id""")
def bounded_terms(t: Tables) -> DataFrame:
    """Words of each document that fit a search text: 64 terms and 1600 characters are what it may hold."""
    return t.documents.select("doc_id", F.array_join(R.bounded_terms(F.split("text", r"\s+")), " ").alias("terms"))


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN ' Module ' WHEN 2 THEN lower(p_type) ELSE p_type END AS a, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'ArchitectureComponent' WHEN 2 THEN p_type ELSE 'SMALL' END AS b FROM part), f AS (SELECT *, lower(trim(a)) AS x, lower(trim(b)) AS y FROM p)
SELECT p_partkey, coalesce(a, '') = '' OR b = '' OR x = y OR x IN ('component', 'entity', 'module', 'architecturecomponent') OR y IN ('component', 'entity', 'module', 'architecturecomponent') AS agree, CASE WHEN a IS NULL THEN '' ELSE 'entity:' || a END AS node FROM f""")
def label_agreement(t: Tables) -> DataFrame:
    """Whether two labels of an entity fit together, and the id under which it is drawn."""
    size = F.col("p_size")
    a = F.when(size % 5 == 1, " Module ").when(size % 5 == 2, F.lower("p_type")).when(size % 5 > 2, F.col("p_type"))
    b = F.when(size % 4 == 0, "").when(size % 4 == 1, "ArchitectureComponent").when(size % 4 == 2, F.col("p_type")).otherwise("SMALL")
    return t.part.select("p_partkey", I.labels_agree(a, b).alias("agree"), I.node_id(F.concat(F.lit("entity:"), a)).alias("node"))
