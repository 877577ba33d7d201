"""Bounded inventories and evidence: orders as decision records, lines as their chunks, parts as entities,
suppliers as communities, customers as repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import identity as I
from sparkloom.operators import evidence as E
from sparkloom.operators import graph as G
from sparkloom.operators import ledger as L
from sparkloom.operators import retrieval
from sparkloom.operators.steps import materialise

from .registry import Tables, query

K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def _chunk(order: str = "l_orderkey", line: str = "l_linenumber"):
    return F.concat_ws(":", F.lit("adr"), F.col(order).cast("string"), F.lit("chunk"), F.col(line).cast("string"))


@query("""SELECT DISTINCT 'adr:' || l_orderkey || ':chunk:' || l_linenumber AS chunk, sha256('adr:decision:v2:' || 'adr:' || l_orderkey || ':chunk:' || l_linenumber || ':' || l_linenumber || ':' || l_returnflag) AS decision, sha256('adr:constraint:' || l_linenumber || ':' || l_returnflag) AS constraint_id,
sha256('{"adr":"' || l_orderkey || '","chunk":"' || l_linenumber || '","content_hash":"' || l_returnflag || '","format":"v1","repository":null}') AS vector_key, sha256(sha256(l_returnflag) || ':inkeys=' || CASE WHEN l_linenumber > 3 THEN 'True' ELSE 'False' END) AS embedding_version FROM lineitem""")
def record_ids(t: Tables) -> DataFrame:
    """Ids of chunks, decisions and constraints, and the keys under which vectors are kept. Different rows of what they
    are made of have different ids, so those rows are told apart and not the long ids."""
    n, flag = F.col("l_linenumber").cast("string"), F.col("l_returnflag")
    key = I.fingerprint(format=F.lit("v1"), repository=F.lit(None).cast("string"), adr=F.col("l_orderkey").cast("string"), chunk=n, content_hash=flag)
    version = I.digest(F.concat(I.digest(flag), F.lit(":inkeys="), F.when(F.col("l_linenumber") > 3, "True").otherwise("False")))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    return rows.select(_chunk().alias("chunk"), I.keyed_id(":", F.lit("adr:decision:v2"), _chunk(), n, flag).alias("decision"), I.keyed_id(":", F.lit("adr:constraint"), n, flag).alias("constraint_id"), key.alias("vector_key"), version.alias("embedding_version"))


@query("""WITH m AS (SELECT DISTINCT l_suppkey, l_partkey, p_name, p_type FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT l_suppkey, string_agg(l_partkey || ':' || p_name || ':' || p_type, '|' ORDER BY l_partkey || ':' || p_name || ':' || p_type) AS members, string_agg('- ' || p_name || ' [' || p_type || '] (ID: ' || l_partkey || ')', chr(10) ORDER BY p_name, l_partkey) AS shown FROM m GROUP BY 1),
e AS (SELECT DISTINCT a.l_suppkey, a.l_partkey || ':' || a.p_name || '-[SAME_TYPE]->' || b.l_partkey || ':' || b.p_name AS edge FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.p_type = b.p_type AND a.p_name = b.p_name AND a.l_partkey < b.l_partkey), r AS (SELECT l_suppkey, string_agg(edge, '|' ORDER BY edge) AS rels FROM e GROUP BY 1)
SELECT s.l_suppkey AS community, sha256('MEMBERS:' || members || '#RELS:' || coalesce(rels, '')) AS context_hash, sha256('Community ID: ' || s.l_suppkey || chr(10) || chr(10) || 'Entities:' || chr(10) || shown) AS prompt FROM s LEFT JOIN r ON r.l_suppkey = s.l_suppkey""")
def community_context(t: Tables) -> DataFrame:
    """Context digest of each community over its sorted members and inner edges, and the text that shows it. Lines
    pass sorted through one digest each; no list of a community's members is held."""
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "l_partkey", "p_name", "p_type").distinct()
    m = materialise(m, "members")
    number = F.col("l_partkey").cast("string")
    name = lambda p: F.concat_ws(":", F.col(f"{p}l_partkey").cast("string"), f"{p}p_name")
    pair = m.alias("a").join(m.alias("b"), ["l_suppkey", "p_type", "p_name"]).where("a.l_partkey < b.l_partkey")
    edge = F.concat(F.concat_ws(":", F.col("a.l_partkey").cast("string"), "p_name"), F.lit("-[SAME_TYPE]->"), F.concat_ws(":", F.col("b.l_partkey").cast("string"), "p_name"))
    own = m.select("l_suppkey", F.lit(0).alias("section"), F.concat_ws(":", name(""), "p_type").alias("first"), F.lit(0).cast("long").alias("second"), F.concat_ws(":", name(""), "p_type").alias("line"))
    rels = pair.select("l_suppkey", F.lit(1).alias("section"), edge.alias("first"), F.lit(0).cast("long").alias("second"), edge.alias("line")).distinct()
    line = F.concat(F.lit("- "), "p_name", F.lit(" ["), "p_type", F.lit("] (ID: "), number, F.lit(")"))
    shown = m.select("l_suppkey", F.lit(0).alias("section"), F.col("p_name").alias("first"), F.col("l_partkey").alias("second"), line.alias("line"))
    head = F.concat(F.lit("Community ID: "), F.col("l_suppkey").cast("string"), F.lit("\n\nEntities:\n"))
    context = G.sectioned_digests(own.union(rels), "l_suppkey", ("MEMBERS:", "#RELS:"), "|").withColumnRenamed("digest", "context_hash")
    titled = shown.unionByName(m.select("l_suppkey").distinct().select("l_suppkey", F.lit(-1).alias("section"), F.lit("").alias("first"), F.lit(0).cast("long").alias("second"), head.alias("line")))
    prompt = G.sectioned_digests(titled.withColumn("section", F.col("section") + 1), "l_suppkey", ("", ""), "\n").withColumnRenamed("digest", "prompt")
    return context.join(prompt, "l_suppkey").select(F.col("l_suppkey").alias("community"), "context_hash", "prompt")


@query("""WITH e AS (SELECT p_partkey % 100 AS src, CASE p_size % 6 WHEN 0 THEN 'ASSERTS' WHEN 1 THEN 'TARGETS' WHEN 2 THEN 'MENTIONS' WHEN 3 THEN 'MEMBER_OF' WHEN 4 THEN 'CALLS' ELSE 'USES' END AS rel, p_partkey % 37 AS dst, p_brand FROM part)
SELECT src, rel, dst, count(*) AS n FROM e WHERE rel NOT IN ('ASSERTS', 'TARGETS', 'MENTIONS', 'MEMBER_OF') AND p_brand = 'Brand#7' GROUP BY ALL""")
def scoped_edges(t: Tables) -> DataFrame:
    """Architectural edges of one repository: provenance is left out, and the scope may be left open."""
    kind = F.element_at(F.array(*map(F.lit, (*E.PROVENANCE, "CALLS", "USES"))), (F.col("p_size") % 6 + 1).cast("int"))
    edges = t.part.select((F.col("p_partkey") % 100).alias("src"), kind.alias("rel"), (F.col("p_partkey") % 37).alias("dst"), "p_brand")
    return E.in_scope(E.architectural(edges), "p_brand", "Brand#7").groupBy("src", "rel", "dst").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_custkey AND e.event_type = 'error')""")
def present_records(t: Tables) -> DataFrame:
    """Records that are not deleted, of repositories without a pending deletion."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", "DELETED").otherwise("PUBLISHED").alias("status"))
    pending = t.events.where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    return E.present(rows, "status", pending, "o_custkey").select("o_orderkey", "o_custkey")


@query("""WITH c AS (SELECT DISTINCT o_orderkey, l_linenumber, 'adr:' || o_orderkey || ':chunk:' || l_linenumber AS chunk FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' ORDER BY o_orderkey, chunk LIMIT 2000),
k AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, chunk, count(l_partkey) AS requirements FROM c LEFT JOIN k ON l_orderkey = o_orderkey AND k.l_linenumber = c.l_linenumber GROUP BY ALL""")
def adr_chunks(t: Tables) -> DataFrame:
    """Chunks of decision records with the requirements they support: the bound comes before the outer join."""
    urgent = t.orders.where(F.col("o_orderpriority").startswith("1")).select("o_orderkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", _chunk().alias("chunk"))
    head = urgent.join(lines, "o_orderkey").distinct().orderBy("o_orderkey", "chunk").limit(2000)
    needs = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").distinct()
    return head.join(needs, ["o_orderkey", "l_linenumber"], "left").groupBy("o_orderkey", "chunk").agg(F.count("l_partkey").alias("requirements"))


@query("""SELECT p_partkey AS entity, l_suppkey AS community FROM (SELECT DISTINCT p_partkey, l_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 9 ORDER BY p_partkey, l_suppkey LIMIT 400)""")
def entity_communities(t: Tables) -> DataFrame:
    """Communities of the asked entities, bounded after they are put in order."""
    asked = t.part.where("p_size = 9").select(F.col("p_partkey").alias("l_partkey"))
    found = t.lineitem.select("l_partkey", "l_suppkey").join(asked, "l_partkey", "left_semi").distinct().orderBy("l_partkey", "l_suppkey").limit(400)
    return found.select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("community"))


@query("""SELECT DISTINCT l_orderkey AS adr, 'adr:' || l_orderkey || ':chunk:' || l_linenumber AS chunk FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3')""")
def scope_evidence(t: Tables) -> DataFrame:
    """Chunks of the asked records among the asked chunks: two semi-joins."""
    adrs = t.orders.where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    chunks = t.part.where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(adrs, "l_orderkey", "left_semi").join(chunks, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("adr"), _chunk().alias("chunk")).distinct()


@query("""WITH c AS (SELECT doc_id AS chunk, source, CASE WHEN doc_id % 5 = 0 THEN 'def ' || source || '(' ELSE '' END || text AS text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), e AS (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL)
SELECT chunk, c.source, CAST(min(CASE WHEN contains(text, 'def ' || name || '(') OR contains(text, 'class ' || name) OR contains(text, 'function ' || name || '(') THEN 0 ELSE 1 END) AS INTEGER) AS hint FROM c JOIN e ON e.name = c.source GROUP BY ALL ORDER BY hint, c.source, chunk LIMIT 150""")
def declaring_chunks(t: Tables) -> DataFrame:
    """Chunks that mention an entity, those that declare it first."""
    rows = t.documents.where("text IS NOT NULL AND source IS NOT NULL")
    body = F.concat(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("def "), "source", F.lit("("))).otherwise(""), F.col("text"))
    chunks = rows.select(F.col("doc_id").alias("chunk"), "source", body.alias("text"))
    entities = rows.select(F.col("source").alias("entity"), F.col("source").alias("name")).distinct()
    return E.declaring(chunks, rows.select(F.col("doc_id").alias("chunk"), F.col("source").alias("entity")), entities, ["source", "chunk"], 150)


@query("""WITH e AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 60), c AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier QUALIFY rank <= 5), m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
h AS (SELECT id AS entity, 'entity' AS channel, id, rank FROM e UNION ALL SELECT l_partkey, 'community', c.id, rank FROM m JOIN c ON c.id = l_suppkey), p AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS entity FROM lineitem), s AS (SELECT DISTINCT chunk, channel, id, rank FROM p JOIN h USING (entity))
SELECT chunk, count(DISTINCT channel) AS channels, min(rank) AS best_rank, count(*) AS signals FROM s GROUP BY chunk ORDER BY channels DESC, best_rank, chunk LIMIT 500""")
def signal_chunks(t: Tables) -> DataFrame:
    """Chunks that entity and community hits lead to: more channels first, then the best rank."""
    top = lambda rows, key, by, most: rows.orderBy(F.desc(by), key).limit(most).select(F.col(key).alias("id"), F.row_number().over(Window.orderBy(F.desc(by), key)).cast("long").alias("rank"))
    members = t.lineitem.select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("community")).distinct()
    said = t.lineitem.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    return E.signalled(top(t.part, "p_partkey", "p_retailprice", 60), top(t.supplier, "s_suppkey", "s_acctbal", 5), members, said, 500)


@query("""WITH o AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), f AS (SELECT l_partkey, min(l_suppkey) AS first FROM o GROUP BY 1), g AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000),
a AS (SELECT o.l_partkey, min(o.l_suppkey) FILTER (g.s_suppkey IS NULL) AS next, bool_or(g.s_suppkey IS NOT NULL) AS touched, bool_or(g.s_suppkey IS NOT NULL AND o.l_suppkey = f.first) AS moved FROM o JOIN f USING (l_partkey) LEFT JOIN g ON g.s_suppkey = o.l_suppkey GROUP BY 1)
SELECT l_partkey, next AS l_suppkey, CASE WHEN next IS NULL THEN 'DELETE' WHEN moved THEN 'TRANSFER' ELSE 'KEEP' END AS action FROM a WHERE touched""")
def ownership_transfer(t: Tables) -> DataFrame:
    """What becomes of shared entities when some records that own them are deleted."""
    owned = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    first = owned.groupBy("l_partkey").agg(F.min("l_suppkey").alias("first"))
    owned = owned.join(first, "l_partkey").select("l_partkey", "l_suppkey", (F.col("l_suppkey") == F.col("first")).alias("primary"))
    return E.owners_after(owned, "l_partkey", "l_suppkey", t.supplier.where("s_acctbal < 2000").select(F.col("s_suppkey").alias("l_suppkey")))


@query("""SELECT source, count(*) AS dropped, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS english FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source""")
def full_reconcile(t: Tables) -> DataFrame:
    """What a full run drops: everything of a source that is no decision record (here: that has no label)."""
    code = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_anti")
    return code.groupBy("source").agg(F.count("*").alias("dropped"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("english"))


@query("""SELECT (SELECT count(DISTINCT source) FROM documents) AS files, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS completed, (SELECT count(*) FROM embeddings) AS expected, (SELECT count(*) FROM labels) AS entities, (SELECT count(*) FROM embeddings WHERE embedding IS NULL) AS missing""")
def stage_counts(t: Tables) -> DataFrame:
    """Persisted counts of a run, one row each side by side, and whether the vector space is complete."""
    docs = t.documents.agg(F.countDistinct("source").alias("files"), F.count("*").alias("chunks"))
    vectors = t.embeddings.agg(F.count("embedding").alias("completed"), F.count("*").alias("expected"), F.count_if(F.col("embedding").isNull()).alias("missing"))
    return docs.crossJoin(vectors).crossJoin(t.labels.agg(F.count("*").alias("entities")))


@query("""SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM (SELECT o_custkey, max(o_orderdate) AS head, max(o_orderpriority) AS base FROM orders GROUP BY 1) s WHERE s.o_custkey = o.o_custkey AND s.head = o.o_orderdate AND s.base = o.o_orderpriority)""")
def current_reviews(t: Tables) -> DataFrame:
    """Jobs of the revisions now observed: repository, base and head must all agree."""
    states = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"), F.max("o_orderpriority").alias("o_orderpriority"))
    return E.current(t.orders, states, "o_custkey", "o_orderdate", "o_orderpriority").select("o_orderkey")


@query("""WITH r AS (SELECT c_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY c_custkey ORDER BY (o_orderstatus = 'F') DESC NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey NULLS LAST) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey) SELECT c_custkey, o_orderkey, coalesce(o_orderstatus, 'NOT_TRACKED') AS status FROM r WHERE n = 1""")
def accessible_repositories(t: Tables) -> DataFrame:
    """Every accessible repository with its tracked row, the best one where there are several."""
    rows = t.customer.select("c_custkey").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    found = E.preferred(rows, "c_custkey", (F.col("o_orderstatus") == "F").desc_nulls_last(), F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last())
    return found.select("c_custkey", "o_orderkey", F.coalesce("o_orderstatus", F.lit("NOT_TRACKED")).alias("status"))


@query("""WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS base FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT h.l_orderkey, h.l_linenumber, h.l_suppkey AS head, b.base FROM h JOIN b USING (l_orderkey, l_linenumber)""")
def snapshot_pairs(t: Tables) -> DataFrame:
    """Head and base snapshots of the same path and line range; the first base of several."""
    side = lambda status: t.lineitem.where(F.col("l_linestatus") == status)
    base = side("F").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("base"))
    return side("O").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("head")).distinct().join(base, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "head", "base")


@query("""SELECT c.conv_id, c.turn, d.doc_id FROM conversations c JOIN documents d ON d.doc_id = c.conv_id * 2 AND contains(lower(d.text), lower(regexp_extract(c.text, '[A-Za-z]{5,}'))) WHERE regexp_matches(c.text, '[A-Za-z]{5,}') AND c.text IS NOT NULL AND c.text <> ''""")
def citation_sources(t: Tables) -> DataFrame:
    """Citations whose source is named by id and also holds the quoted words."""
    cited = t.conversations.where("text <> ''").select("conv_id", "turn", (F.col("conv_id") * 2).alias("doc_id"), F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0)).alias("quote")).where("quote <> ''")
    found = cited.join(t.documents.select("doc_id", "text"), "doc_id").where(F.lower("text").contains(F.col("quote")))
    return found.select("conv_id", "turn", "doc_id")


@query("""SELECT count(*) FILTER (l.l_partkey IS NOT NULL) AS matched, count(*) FILTER (l.l_partkey IS NULL) AS missing FROM part p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) l ON l.l_partkey = p.p_partkey""")
def context_match(t: Tables) -> DataFrame:
    """How many nodes of a context the graph shows, and how many it does not."""
    shown = t.lineitem.select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("here", F.lit(1))
    return t.part.join(shown, "p_partkey", "left").agg(F.count("here").alias("matched"), F.count_if(F.col("here").isNull()).alias("missing"))


@query("""WITH p AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), n AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL EXCEPT SELECT l_orderkey, l_partkey FROM p), u AS (SELECT p_brand AS unit, p_partkey FROM part WHERE p_size < 20),
d AS (SELECT l_orderkey, unit, count(*) AS d FROM p JOIN u ON p_partkey = l_partkey GROUP BY ALL), b AS (SELECT l_orderkey, unit, count(*) AS n FROM n JOIN u ON p_partkey = l_partkey GROUP BY ALL)
SELECT coalesce(d.l_orderkey, b.l_orderkey) AS seed, coalesce(d.unit, b.unit) AS unit, CAST(1 + 4 * coalesce(d, 0) AS DOUBLE) AS structural, CAST(4 * coalesce(d, 0) + coalesce(n, 0) AS DOUBLE) AS association FROM d FULL JOIN b ON b.l_orderkey = d.l_orderkey AND b.unit = d.unit""")
def structural_scores(t: Tables) -> DataFrame:
    """Scores of search units by the changed entities of a seed and those near them: 1 + 4 n and 4 n + m."""
    part = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select("l_orderkey", "l_partkey").distinct()
    primary = part("R").withColumn("kind", F.lit("direct"))
    nearby = part("A").join(part("R"), ["l_orderkey", "l_partkey"], "left_anti").withColumn("kind", F.lit("near"))
    units = t.part.where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("unit"))
    found = primary.unionByName(nearby).join(units, "l_partkey").groupBy(F.col("l_orderkey").alias("seed"), "unit").agg(F.count_if(F.col("kind") == "direct").alias("d"), F.count_if(F.col("kind") == "near").alias("n"))
    return found.select("seed", "unit", (1 + 4 * F.col("d")).cast("double").alias("structural"), (4 * F.col("d") + F.col("n")).cast("double").alias("association"))


DISCOVERY = """CASE WHEN entity THEN 100 ELSE 0 END + CASE WHEN scope_entity AND NOT entity THEN 80 ELSE 0 END + CASE WHEN near AND NOT entity AND NOT scope_entity THEN 25 ELSE 0 END + CASE WHEN community THEN 70 ELSE 0 END + CASE WHEN repository THEN 65 ELSE 0 END + CASE WHEN condition_ THEN 60 ELSE 0 END + CASE WHEN mention THEN 50 ELSE 0 END + least(lexical, 20) + least(5 * literal, 20)"""


@query(f"""WITH f AS (SELECT c_custkey, coalesce(bool_or(o_orderpriority LIKE '1%'), false) AS entity, coalesce(bool_or(o_totalprice > 470000), false) AS scope_entity, coalesce(bool_or(o_orderpriority LIKE '2%'), false) AS near, c_nationkey % 5 = 0 AS community, c_mktsegment = 'BUILDING' AS repository, c_acctbal > 9000 AS condition_, c_custkey % 6 = 0 AS mention, count(o_orderkey) AS lexical, count(*) FILTER (o_orderstatus = 'P') AS literal FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_mktsegment, c_acctbal)
SELECT c_custkey, CAST({DISCOVERY} AS INTEGER) AS score, array_to_string(list_filter([CASE WHEN entity THEN 'ENTITY_TARGET' END, CASE WHEN scope_entity THEN 'SCOPE_ENTITY_TARGET' END, CASE WHEN near AND NOT entity THEN 'NEIGHBOR_TARGET' END, CASE WHEN community THEN 'COMMUNITY_SCOPE' END, CASE WHEN repository THEN 'REPOSITORY_SCOPE' END, CASE WHEN condition_ THEN 'CONDITIONAL_SCOPE' END, CASE WHEN mention THEN 'ADR_MENTION' END, CASE WHEN lexical > 0 THEN 'LEXICAL_FALLBACK' END, CASE WHEN literal > 0 THEN 'CHANGED_LITERAL' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f""")
def discovery_scores(t: Tables) -> DataFrame:
    """Why a requirement is looked at, and its score: nine terms, two of them only where no stronger one holds."""
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    rank = F.col("o_orderpriority")
    facts = t.customer.join(o, "c_custkey", "left").groupBy("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").agg(F.coalesce(F.bool_or(rank.startswith("1")), F.lit(False)).alias("entity"), F.coalesce(F.bool_or(F.col("o_totalprice") > 470000), F.lit(False)).alias("scope_entity"), F.coalesce(F.bool_or(rank.startswith("2")), F.lit(False)).alias("near"), F.count("o_orderkey").alias("lexical"), F.count_if(F.col("o_orderstatus") == "P").alias("literal"))
    c = F.col
    score, reasons = retrieval.discovery(c("entity"), c("scope_entity"), c("near"), c("c_nationkey") % 5 == 0, c("c_mktsegment") == "BUILDING", c("c_acctbal") > 9000, c("c_custkey") % 6 == 0, c("lexical"), c("literal"))
    return facts.select("c_custkey", score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


@query("""WITH g AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM g)) SELECT n_nationkey AS installation, count(c_custkey) AS repositories, coalesce(min(c_custkey), -1) AS first FROM nation LEFT JOIN p ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1""")
def granted_repositories(t: Tables) -> DataFrame:
    """Public repositories that a user sees and the installation was granted, counted by installation."""
    granted = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    public = t.customer.where("c_acctbal >= 0").join(granted, "c_custkey", "left_semi").groupBy(F.col("c_nationkey").alias("installation")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    active = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("installation"))
    return active.join(public, "installation", "left").select("installation", F.coalesce("n", F.lit(0)).alias("repositories"), F.coalesce("first", F.lit(-1)).alias("first"))


@query("""WITH a AS (SELECT DISTINCT user_id, 'CUSTOMER#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS name, CASE WHEN event_type = 'view' THEN user_id % 25 END AS hint FROM events), m AS (SELECT a.user_id, a.hint, c_custkey, row_number() OVER (PARTITION BY a.user_id, a.hint ORDER BY c_custkey) AS n FROM a JOIN customer ON lower(c_name) = lower(a.name) AND (a.hint IS NULL OR c_nationkey = a.hint))
SELECT user_id, hint, c_custkey FROM m WHERE n = 1""")
def selected_repository(t: Tables) -> DataFrame:
    """A repository by its full name in any case, in the hinted installation where there is one; the first."""
    asked = t.events.select("user_id", F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("name"), F.when(F.col("event_type") == "view", F.col("user_id") % 25).alias("hint")).distinct()
    found = asked.join(t.customer.select(F.lower("c_name").alias("name"), "c_custkey", "c_nationkey"), "name").where("hint IS NULL OR c_nationkey = hint")
    return found.groupBy("user_id", "hint").agg(F.min("c_custkey").alias("c_custkey"))


@query(f"""WITH e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'handoff' WHEN 'view' THEN 'installation_return' ELSE 'other' END AS purpose, {K} AS attempt, ts, event_id FROM events) SELECT user_id, purpose, arg_max(attempt, (ts, event_id)) AS attempt, count(*) - 1 AS superseded FROM e GROUP BY ALL""")
def latest_attempts(t: Tables) -> DataFrame:
    """The newest attempt of each user and purpose; it supersedes all before."""
    purpose = F.when(F.col("event_type") == "signup", "handoff").when(F.col("event_type") == "view", "installation_return").otherwise("other")
    return t.events.groupBy("user_id", purpose.alias("purpose")).agg(F.max_by(_k(), F.struct("ts", "event_id")).alias("attempt"), (F.count("*") - 1).alias("superseded"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id FROM events WHERE event_type IN ('click', 'view')), l AS (SELECT user_id, i, event_id, ts + INTERVAL 6 HOUR AS until, true AS got FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN e.ts >= l.until THEN e.ts + INTERVAL 6 HOUR ELSE l.until END, e.ts >= l.until FROM l JOIN e ON e.user_id = l.user_id AND e.i = l.i + 1)
SELECT user_id, event_id, got FROM l""")
def credential_locks(t: Tables) -> DataFrame:
    """Who gets a lock that is held for six hours: requests in order, refused while it is held."""
    asked = t.events.where(F.col("event_type").isin("click", "view")).select("user_id", "ts", "event_id")
    return L.lock_holders(asked, "user_id", 6 * 3600)


@query(f"""WITH a AS (SELECT user_id, {K} AS token, ts, event_id FROM events), m AS (SELECT *, max(token) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a)
SELECT user_id, count(*) FILTER (token > coalesce(before, 0)) AS armed, count(*) FILTER (token <= coalesce(before, 0)) AS refused, max(token) AS fence FROM m GROUP BY user_id""")
def graph_fence(t: Tables) -> DataFrame:
    """Runs that arm a repository's fence: only with a token above all before; the others lost it."""
    return L.fenced(t.events.select("user_id", _k().alias("token"), "ts", "event_id"), "user_id", "token", ["ts", "event_id"])
