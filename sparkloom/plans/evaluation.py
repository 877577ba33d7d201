"""Evaluation: units, coverage, dispositions, budgets and the state machines around them. Orders are reviews,
lines are findings, customers are rules, users are jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import classify as C
from sparkloom.functions import identity as I
from sparkloom.operators import containment as CT
from sparkloom.operators import evidence as E
from sparkloom.operators import graph as G
from sparkloom.operators import ledger as L
from sparkloom.operators import records as R
from sparkloom.operators.steps import materialise

from .registry import Tables, query


@query("""WITH r AS (SELECT c_custkey AS rule, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), g AS (SELECT p_brand || '/' || p_type AS grp FROM part GROUP BY 1), o AS (SELECT grp, row_number() OVER (ORDER BY grp) AS k FROM g), c AS (SELECT count(*) AS n FROM g)
SELECT (r.n - 1) * c.n + k - 1 AS place, CAST(rule AS VARCHAR) AS rule, grp AS "group", greatest(0, (SELECT count(*) FROM r) * c.n - 512) AS overflow FROM r, o, c WHERE (r.n - 1) * c.n + k - 1 < 512""")
def evaluation_units(t: Tables) -> DataFrame:
    """Rules by changed places, rule by rule: 512 units at most, with the number of those left out."""
    rules = t.customer.select(F.col("c_custkey").alias("rule"))
    groups = t.part.select(F.concat("p_brand", F.lit("/"), "p_type").alias("group")).distinct()
    return E.first_units(rules, groups, [F.asc("group")], 512)


@query("""WITH o AS (SELECT l_orderkey, l_linestatus, count(*) FILTER (l_quantity > 5) AS good FROM lineitem GROUP BY ALL), c AS (SELECT l_orderkey, count(*) FILTER (good > 0) AS roles FROM o GROUP BY 1)
SELECT o_orderkey, coalesce(roles = 2, false) AS covered FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def source_coverage(t: Tables) -> DataFrame:
    """Units whose every revision has a complete observation; line states are the revisions here."""
    seen = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus", "l_quantity")
    return E.covered(t.orders.select("o_orderkey"), seen, "o_orderkey", "l_linestatus", ("O", "F"), F.col("l_quantity") > 5)


FINDINGS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity < 4 AS impact, ['INTRODUCED','WORSENED','PRE_EXISTING','RESOLVED','UNCHANGED','UNKNOWN'][l_partkey % 6 + 1] AS attribution, l_discount > 0.02 AS applies, l_tax > 0.07 AS unsure, l_suppkey % 3 > 0 AS approved, l_quantity > 10 AS covered, l_returnflag <> 'N' AS mandatory, l_linestatus = 'F' AS adr, CASE l_suppkey % 4 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' WHEN 2 THEN 'SUPPORTED' END AS verdict, l_tax > 0.06 AS core_missing, l_partkey % 7 > 0 AS unchanged FROM lineitem"""


def _findings(t: Tables) -> DataFrame:
    c = F.col
    kinds = F.array(*map(F.lit, ("INTRODUCED", "WORSENED", "PRE_EXISTING", "RESOLVED", "UNCHANGED", "UNKNOWN")))
    verdict = F.when(c("l_suppkey") % 4 == 1, "REFUTED").when(c("l_suppkey") % 4 != 3, "SUPPORTED")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_quantity") < 4).alias("impact"), F.element_at(kinds, (c("l_partkey") % 6 + 1).cast("int")).alias("attribution"), (c("l_discount") > 0.02).alias("applies"), (c("l_tax") > 0.07).alias("unsure"), (c("l_suppkey") % 3 > 0).alias("approved"), (c("l_quantity") > 10).alias("covered"), (c("l_returnflag") != "N").alias("mandatory"), (c("l_linestatus") == "F").alias("adr"), verdict.alias("verdict"), (c("l_tax") > 0.06).alias("core_missing"), (c("l_partkey") % 7 > 0).alias("unchanged"))


def _decided(t: Tables) -> DataFrame:
    c = F.col
    rows = _findings(t).withColumn("eligible", E.candidate_eligible(c("impact"), c("approved"), c("covered"), c("attribution"), c("applies"), c("mandatory"), c("adr")))
    rows = rows.withColumn("accepted", F.coalesce(E.review_accepted(c("verdict"), c("core_missing"), c("attribution"), c("approved"), c("unchanged")), F.lit(False)))
    return rows.withColumn("disposition", E.disposition(c("impact"), c("attribution"), c("applies"), c("unsure") | ~c("covered"), c("eligible"), c("accepted"), c("verdict")))


DECIDED = f"""f AS ({FINDINGS}), e AS (SELECT *, NOT impact AND approved AND covered AND attribution IN ('INTRODUCED', 'WORSENED') AND applies AND (NOT adr OR mandatory) AS eligible, coalesce(NOT core_missing AND unchanged AND (verdict = 'REFUTED' OR (verdict = 'SUPPORTED' AND attribution IN ('INTRODUCED', 'WORSENED') AND approved)), false) AS accepted FROM f),
d AS (SELECT *, CASE WHEN eligible AND accepted AND verdict = 'SUPPORTED' THEN 'SUPPORTED_CONFLICT' WHEN eligible AND accepted AND verdict = 'REFUTED' THEN 'REFUTED' WHEN unsure OR NOT covered THEN 'NEEDS_REVIEW' WHEN impact THEN 'ADVISORY' WHEN attribution = 'PRE_EXISTING' AND applies THEN 'PRE_EXISTING' WHEN attribution IN ('RESOLVED', 'UNCHANGED') AND applies THEN 'ADVISORY' ELSE 'NEEDS_REVIEW' END AS disposition FROM e)"""


@query(f"WITH {DECIDED} SELECT disposition, eligible, accepted, count(*) AS findings, count(DISTINCT l_orderkey) AS reviews FROM d GROUP BY ALL")
def finding_dispositions(t: Tables) -> DataFrame:
    """What becomes of the findings, by eligibility and review."""
    return _decided(t).groupBy("disposition", "eligible", "accepted").agg(F.count("*").alias("findings"), F.countDistinct("l_orderkey").alias("reviews"))


@query(f"WITH {DECIDED} SELECT l_orderkey, CASE WHEN bool_or(disposition = 'SUPPORTED_CONFLICT') THEN 'CONFLICTS_FOUND' WHEN NOT bool_or(verdict IS NOT NULL) THEN 'NOT_EVALUATED' WHEN bool_or(disposition = 'NEEDS_REVIEW') THEN 'REVIEW_REQUIRED' ELSE 'NO_CONFLICTS_FOUND' END AS outcome FROM d GROUP BY 1")
def evaluation_outcomes(t: Tables) -> DataFrame:
    """Outcome of each evaluation from its findings."""
    has = lambda name: F.count_if(F.col("disposition") == name)
    per = _decided(t).groupBy("l_orderkey").agg(has("SUPPORTED_CONFLICT").alias("conflicts"), F.bool_or(F.col("verdict").isNotNull()).alias("run"), (has("NEEDS_REVIEW") > 0).alias("partial"))
    return per.select("l_orderkey", C.evaluation_outcome(F.col("run"), F.col("conflicts"), F.col("partial")).alias("outcome"))


@query(f"WITH {DECIDED}, p AS (SELECT l_orderkey, l_linenumber, unnest([p_brand, p_type]) AS rule, disposition FROM d JOIN part ON p_partkey = l_partkey WHERE disposition IN ('SUPPORTED_CONFLICT', 'NEEDS_REVIEW')) SELECT rule, disposition, count(*) AS rows, count(DISTINCT l_orderkey) AS reviews FROM p GROUP BY ALL")
def finding_rules(t: Tables) -> DataFrame:
    """Projection of findings to the rules they cite, a row each."""
    rows = _decided(t).where(F.col("disposition").isin("SUPPORTED_CONFLICT", "NEEDS_REVIEW")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_orderkey", "disposition", F.explode(F.array("p_brand", "p_type")).alias("rule"))
    return rows.groupBy("rule", "disposition").agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("reviews"))


@query(f"WITH {DECIDED} SELECT 'conflict not eligible' AS check_name, count(*) FILTER (disposition = 'SUPPORTED_CONFLICT' AND NOT eligible) AS violations FROM d UNION ALL SELECT 'refuted without review', count(*) FILTER (disposition = 'REFUTED' AND NOT accepted) FROM d UNION ALL SELECT 'finding without review', count(*) FROM d WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'same place twice', (SELECT count(*) FROM (SELECT 1 FROM d GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))")
def result_invariants(t: Tables) -> DataFrame:
    """Invariants of results: how many rows break each."""
    d = _decided(t)
    twice = d.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    found = R.violations(**{"conflict not eligible": d.where("disposition = 'SUPPORTED_CONFLICT' AND NOT eligible"), "refuted without review": d.where("disposition = 'REFUTED' AND NOT accepted"), "finding without review": d.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti"), "same place twice": twice})
    return found.withColumnRenamed("check", "check_name")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS keep, CAST(l_quantity AS BIGINT) AS size, l_partkey FROM lineitem), b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY keep, size, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY l_orderkey) AS total FROM r)
SELECT l_orderkey, count(*) AS kept, CAST(sum(size) AS BIGINT) AS size FROM b WHERE total - before <= 90 GROUP BY 1""")
def pruned_context(t: Tables) -> DataFrame:
    """Contexts cut to a budget: the weakest rows go first, class by class, until the rest fits."""
    keep = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", keep.alias("keep"), F.col("l_quantity").cast("long").alias("size"))
    return E.pruned(rows, "l_orderkey", ["keep", "size", "l_linenumber", "l_partkey"], "size", 90).groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.sum("size").alias("size"))


@query("""WITH b AS (SELECT doc_id, coalesce(n_chars, 0) AS base FROM documents), a AS (SELECT doc_id, base, base + length(CAST(0 AS VARCHAR)) AS s1 FROM b), c AS (SELECT *, greatest(s1, base + length(CAST(s1 AS VARCHAR))) AS s2 FROM a) SELECT doc_id, greatest(s2, base + length(CAST(s2 AS VARCHAR))) AS estimated FROM c""")
def settled_sizes(t: Tables) -> DataFrame:
    """Sizes of contexts that state their own size."""
    return t.documents.select("doc_id", E.settled_size(F.coalesce("n_chars", F.lit(0)).cast("long")).alias("estimated"))


@query("""WITH r AS (SELECT l_suppkey, l_partkey, min(l_linenumber) AS distance, max(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS strength FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY distance, strength, l_partkey) AS n, count(*) OVER (PARTITION BY l_suppkey) AS total FROM r)
SELECT l_suppkey, l_partkey, CAST(distance AS BIGINT) AS distance, greatest(total - 40, 0) AS omitted FROM k WHERE n <= 40""")
def entity_cap(t: Tables) -> DataFrame:
    """The forty strongest entities of each context, by distance, strength of the mapping and id."""
    strength = F.max(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2))
    rows = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.min("l_linenumber").alias("distance"), strength.alias("strength"))
    return E.strongest(rows, "l_suppkey", ["distance", "strength", "l_partkey"], 40).select("l_suppkey", "l_partkey", F.col("distance").cast("long").alias("distance"), "omitted")


def _hosts_sql(rows: str) -> str:
    return f"""WITH x AS ({rows}), h AS (SELECT a.grp, a.item, b.item AS host, instr(b.text, a.text) - 1 AS start, row_number() OVER (PARTITION BY a.grp, a.item ORDER BY length(b.text) DESC, b.item) AS n FROM x a JOIN x b ON a.grp = b.grp AND contains(b.text, a.text))
SELECT grp, item, host, start FROM h WHERE n = 1"""


@query(_hosts_sql("SELECT conv_id AS grp, turn AS item, text FROM conversations WHERE text <> ''"))
def shared_sources(t: Tables) -> DataFrame:
    """Texts of a packet that a longer one holds share it, with the place."""
    return CT.hosts(t.conversations.select(F.col("conv_id").alias("grp"), F.col("turn").alias("item"), "text"), "grp", "item", "text")


@query(_hosts_sql("SELECT 0 AS grp, 'b' || item_id AS item, text FROM benchmark WHERE text <> '' UNION ALL SELECT 0, 'd' || doc_id, text FROM documents WHERE text <> ''"))
def shared_passages(t: Tables) -> DataFrame:
    """The longest text that holds each passage and each document: all of them are one packet."""
    rows = t.benchmark.select(F.lit(0).alias("grp"), F.concat(F.lit("b"), F.col("item_id")).alias("item"), "text").union(t.documents.select(F.lit(0), F.concat(F.lit("d"), F.col("doc_id")), "text"))
    return CT.hosts(rows, "grp", "item", "text", span=64)  # hardly a text is shorter


@query()
def challenge_packets(t: Tables) -> DataFrame:
    """Findings of a review in packets of at most 16 that share evidence; parts are the evidence."""
    rows = t.lineitem.where("l_returnflag = 'R'").groupBy("l_suppkey", "l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 50)).alias("evidence"), F.sum("l_quantity").cast("long").alias("size"))
    return E.challenges(rows, "l_suppkey", "l_orderkey", "evidence", "size", 200)


@query("""WITH i AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 > 0), c AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 13 > 0)
SELECT coalesce(i.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'EXTRA' WHEN i.doc_id IS NULL THEN 'MISSING' WHEN i.h = c.h THEN 'FRESH' ELSE 'STALE' END AS state FROM i FULL JOIN c ON c.doc_id = i.doc_id""")
def index_freshness(t: Tables) -> DataFrame:
    """An index against the rows it was built of. Two versions are made of the documents, so a part of them is
    in one version only."""
    d = t.documents
    old = d.where("doc_id % 7 > 0").select("doc_id", I.digest(F.col("text")).alias("h"))
    new = d.where("doc_id % 13 > 0").select("doc_id", I.digest(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return E.freshness(old, new, "doc_id", "h")


@query("""WITH r AS (SELECT c_custkey, count(*) AS n, bool_or(o_orderstatus = 'F' AND o_totalprice > 200000) AS verified, bool_or(o_orderstatus = 'P') AS pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN coalesce(verified, false) AND NOT coalesce(pending, false) THEN 'APPROVED' ELSE 'UNKNOWN' END AS status, CASE WHEN NOT coalesce(verified, false) THEN 'REPOSITORY_ADR_UNVERIFIED' WHEN coalesce(pending, false) THEN 'UPLOAD_HASH_MISMATCH' ELSE 'REPOSITORY_ADR_VERIFIED' END AS reason FROM r""")
def authority_receipts(t: Tables) -> DataFrame:
    """Which policies are approved: complete, of the same repository, and with the hash of what was uploaded."""
    rows = t.customer.select("c_custkey").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    per = rows.groupBy("c_custkey").agg(F.coalesce(F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)), F.lit(False)).alias("verified"), F.coalesce(F.bool_or(F.col("o_orderstatus") == "P"), F.lit(False)).alias("changed"))
    reason = C.first_match([(~F.col("verified"), "REPOSITORY_ADR_UNVERIFIED"), (F.col("changed"), "UPLOAD_HASH_MISMATCH")], "REPOSITORY_ADR_VERIFIED")
    return per.select("c_custkey", F.when(F.col("verified") & ~F.col("changed"), "APPROVED").otherwise("UNKNOWN").alias("status"), reason.alias("reason"))


@query("""SELECT p_partkey, p_size % 5 = 0 OR p_size % 5 IN (1, 2) OR p_brand <> 'Brand#1' OR p_retailprice > 1500 OR p_type = 'SMALL' OR p_partkey % 4 = 0 AS unresolved FROM part""")
def applicability_open(t: Tables) -> DataFrame:
    """Whether the applicability of a rule is left open."""
    size = F.col("p_size") % 5
    scopes = F.when(size == 0, F.array().cast("array<string>")).when(size == 1, F.array(F.lit("entity"), F.lit("unknown"))).when(size == 2, F.array(F.lit("other"))).otherwise(F.array(F.lit("repository")))
    bases = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("explicit"), F.lit("inferred"))).otherwise(F.array(F.lit("explicit")))
    basis = F.when(F.col("p_brand") == "Brand#1", "explicit").otherwise("inferred")
    return t.part.select("p_partkey", E.unresolved(scopes, basis, F.col("p_retailprice") > 1500, F.col("p_type") == "SMALL", bases).alias("unresolved"))


@query("""WITH s AS (SELECT DISTINCT p_brand, p_type, p_partkey FROM part WHERE p_size > 40), r AS (SELECT source, count(*) AS n, array_to_string(list_sort(list('[' || doc_id || '] ' || lang))[1:5], chr(10)) AS shown FROM documents WHERE lang IS NOT NULL GROUP BY source) SELECT source, n, shown FROM r""")
def evidence_shown(t: Tables) -> DataFrame:
    """Sources of an answer, a line each, five at most of a place."""
    line = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), "lang")
    rows = t.documents.where("lang IS NOT NULL").select("source", line.alias("line"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("line"))).where("nth <= 5")
    shown = first.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("shown"))  # five lines
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    return counts.alias("c").join(shown.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "n", "shown")


@query("""WITH c AS (SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i)\\b(?:the|and|only)\\b')) AS hits, length(coalesce(text, '')) AS size FROM documents), o AS (SELECT *, coalesce(sum(size + 20) OVER (PARTITION BY source ORDER BY hits DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT source, doc_id, CAST(hits AS BIGINT) AS hits, CAST(least(size, 6000 - 20 - before) AS BIGINT) AS taken FROM o WHERE 6000 - 20 - before >= 64 AND 6000 - 20 - before - size > -size""")
def document_context(t: Tables) -> DataFrame:
    """What goes into a context of 6,000 characters: chunks with most scope words first, the last one cut."""
    hits = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)\b(?:the|and|only)\b"), F.lit(0)))
    rows = t.documents.select("source", "doc_id", hits.cast("long").alias("hits"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    order = Window.partitionBy("source").orderBy(F.desc("hits"), "doc_id")
    # A chunk takes 20 characters at least, so no more than 300 of a source are ever reached.
    rows = rows.withColumn("nth", F.row_number().over(order)).where("nth <= 300")
    before = F.coalesce(F.sum(F.col("size") + 20).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = 6000 - 20 - F.col("before")
    return rows.withColumn("before", before).where(room >= 64).select("source", "doc_id", "hits", F.least("size", room).alias("taken"))


@query("""WITH e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, max(round(1 - l_discount, 4)) AS c FROM lineitem GROUP BY ALL), k AS (SELECT a, b FROM e WHERE c >= 0.70), d AS (SELECT a AS node, '-> ' || b AS line FROM k UNION ALL SELECT b, '<- ' || a FROM k) SELECT node, count(*) AS edges, sha256(string_agg(line, chr(10) ORDER BY line)) AS shown FROM d GROUP BY node""")
def neighbourhood_text(t: Tables) -> DataFrame:
    """What stands around each entity, both directions, of relationships with a confidence of 0.70 or more."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t.lineitem.groupBy(name("p", "l_partkey").alias("a"), name("s", "l_suppkey").alias("b")).agg(F.max(F.round(1 - F.col("l_discount"), 4)).alias("c")).where("c >= 0.70")
    both = edges.select(F.col("a").alias("node"), F.concat(F.lit("-> "), "b").alias("line")).union(edges.select("b", F.concat(F.lit("<- "), "a")))
    both = materialise(both, "edges")
    shown = G.sectioned_digests(both.select("node", F.lit(0).alias("section"), F.col("line").alias("first"), F.lit(0).cast("long").alias("second"), "line"), "node", ("",), "\n")
    return both.groupBy("node").agg(F.count("*").alias("edges")).join(shown.withColumnRenamed("digest", "shown"), "node").select("node", "edges", "shown")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT a, b FROM (SELECT p.p_partkey AS a, q.p_partkey AS b FROM part p JOIN part q ON p.p_name = q.p_name AND p.p_brand = q.p_brand AND p.p_partkey <> q.p_partkey)), r(node, m) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.m WHERE l.b < r.m OR l.b < r.node), f AS (SELECT node, min(m) AS target FROM r GROUP BY 1)
SELECT target, count(*) AS merged, count(DISTINCT p_type) AS labels FROM f JOIN part ON p_partkey = node GROUP BY target""")
def semantic_merges(t: Tables) -> DataFrame:
    """Entities whose merge was accepted become the smallest of them, through any number of redirects."""
    same = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("dst"))
    pairs = t.part.join(same, ["p_name", "p_brand"]).where("p_partkey <> dst").select(F.col("p_partkey").alias("src"), "dst")
    found = G.communities(G.undirected(pairs))
    rows = t.part.join(found, F.col("p_partkey") == F.col("node"), "left").select("p_type", F.coalesce("community", "p_partkey").alias("target"))
    return rows.groupBy("target").agg(F.count("*").alias("merged"), F.countDistinct("p_type").alias("labels"))


@query("""WITH s AS (SELECT source, sha256(string_agg(doc_id || ':' || coalesce(lang, ''), '|' ORDER BY doc_id)) AS h FROM documents WHERE source IS NOT NULL GROUP BY 1), o AS (SELECT source, sha256(string_agg(doc_id || ':' || coalesce(lang, ''), '|' ORDER BY doc_id)) AS h FROM documents WHERE source NOT LIKE '%1' OR doc_id > 100 GROUP BY 1)
SELECT s.source, CASE WHEN o.h IS NULL THEN 'NEW' WHEN o.h = s.h THEN 'REUSED' ELSE 'CHANGED' END AS state FROM s LEFT JOIN o ON o.source = s.source""")
def summary_reuse(t: Tables) -> DataFrame:
    """Which summaries stay: those whose context has the hash it had before."""
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit(""))).alias("line")
    rows = lambda d: d.where("source IS NOT NULL").select("source", F.lit(0).alias("section"), F.lit("").alias("first"), F.col("doc_id").alias("second"), line)
    hashed = lambda d: G.sectioned_digests(rows(d), "source", ("",), "|").withColumnRenamed("digest", "h")
    old = hashed(t.documents.where("source NOT LIKE '%1' OR doc_id > 100")).withColumnRenamed("h", "old")
    state = F.when(F.col("old").isNull(), "NEW").when(F.col("old") == F.col("h"), "REUSED").otherwise("CHANGED")
    return hashed(t.documents).join(old, "source", "left").select("source", state.alias("state"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 25 <> c_nationkey AND o_totalprice > 450000 THEN 'SCOPE_MISMATCH' WHEN c_custkey IS NULL THEN 'FOREIGN_IDENTITY' WHEN o_orderstatus = 'P' THEN 'INCOMPLETE' END AS rejected FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE (o_custkey % 25 <> c_nationkey AND o_totalprice > 450000) OR c_custkey IS NULL OR o_orderstatus = 'P'""")
def scope_guards(t: Tables) -> DataFrame:
    """Rows that fail a guard of scope or identity, with the reason; none of them goes on."""
    rows = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    reason = F.when((F.col("o_custkey") % 25 != F.col("c_nationkey")) & (F.col("o_totalprice") > 450000), "SCOPE_MISMATCH").when(F.col("c_custkey").isNull(), "FOREIGN_IDENTITY").when(F.col("o_orderstatus") == "P", "INCOMPLETE")
    return rows.select("o_orderkey", reason.alias("rejected")).where("rejected IS NOT NULL")


@query("""WITH p AS (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL), u AS (SELECT p_partkey FROM part WHERE p_size < 45) SELECT l_orderkey, count(*) AS candidates, count(*) FILTER (p_partkey IS NULL) AS forged FROM p LEFT JOIN u ON p_partkey = l_partkey GROUP BY 1 HAVING count(*) FILTER (p_partkey IS NULL) > 0""")
def forged_candidates(t: Tables) -> DataFrame:
    """Plans with candidates that no index unit stands behind."""
    units = t.part.where("p_size < 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("here"))
    plan = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(units, "l_partkey", "left")
    return plan.groupBy("l_orderkey").agg(F.count("*").alias("candidates"), F.count_if(F.col("here").isNull()).alias("forged")).where("forged > 0")


@query("""WITH s AS (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'R') AS structural, max(l_discount) AS score, bool_and(l_quantity > 1) AS complete, bool_or(l_discount > 0.01) AS ranked FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_partkey, round(CASE WHEN structural THEN 1.0 ELSE 0.0 END + CASE WHEN ranked THEN score ELSE 0.0 END, 6) AS priority FROM s WHERE (ranked OR structural) AND complete""")
def selection_priority(t: Tables) -> DataFrame:
    """Selected policies by structure and fused score: neither found nor linked ones, and incomplete ones, go."""
    rows = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("structural"), F.max("l_discount").alias("score"), F.bool_and(F.col("l_quantity") > 1).alias("complete"), F.bool_or(F.col("l_discount") > 0.01).alias("ranked"))
    rows = rows.where("(ranked OR structural) AND complete")
    return rows.select("l_orderkey", "l_partkey", F.round(F.col("structural").cast("double") + F.when(F.col("ranked"), F.col("score")).otherwise(0.0), 6).alias("priority"))


@query("""WITH w AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS wanted, count(DISTINCT l_partkey) FILTER (l_linestatus = 'F') AS loaded, count(DISTINCT l_partkey) FILTER (l_linestatus = 'F' AND l_tax < 0.08) AS equal FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN wanted - loaded > 2 THEN 'TOO_MANY_PENDING' WHEN loaded < wanted THEN 'PENDING' WHEN equal < loaded THEN 'MANIFEST_MISMATCH' ELSE 'HYDRATED' END AS state FROM w""")
def hydration_state(t: Tables) -> DataFrame:
    """Whether the code a plan asks for is loaded: a few may be pending, and what is loaded must be as listed."""
    n = lambda test: F.countDistinct(F.when(test, F.col("l_partkey")))
    done = F.col("l_linestatus") == "F"
    per = t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("wanted"), n(done).alias("loaded"), n(done & (F.col("l_tax") < 0.08)).alias("same"))
    state = C.first_match([(F.col("wanted") - F.col("loaded") > 2, "TOO_MANY_PENDING"), (F.col("loaded") < F.col("wanted"), "PENDING"), (F.col("same") < F.col("loaded"), "MANIFEST_MISMATCH")], "HYDRATED")
    return per.select("l_orderkey", state.alias("state"))


@query("""WITH b AS (SELECT user_id, max(event_id) FILTER (ts < TIMESTAMP '2024-01-15') AS before, max(event_id) FILTER (ts < TIMESTAMP '2024-01-16') AS after FROM events GROUP BY 1) SELECT user_id, before IS NOT DISTINCT FROM after AS available FROM b""")
def read_barrier(t: Tables) -> DataFrame:
    """A read counts only if the snapshot was the same before and after it."""
    upto = lambda day: F.max(F.when(F.col("ts") < F.lit(day).cast("timestamp_ntz"), F.col("event_id")))
    per = t.events.groupBy("user_id").agg(upto("2024-01-15").alias("before"), upto("2024-01-16").alias("after"))
    return per.select("user_id", F.col("before").eqNullSafe(F.col("after")).alias("available"))


@query("""WITH o AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC) AS last FROM documents), k AS (SELECT * FROM o WHERE last = 1) SELECT doc_id % 50 AS evidence, doc_id, CAST(row_number() OVER (ORDER BY source, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, n_chars, doc_id) AS INTEGER) AS place FROM k""")
def source_order(t: Tables) -> DataFrame:
    """Sources by path, origin in a fixed order and line; the last row of an evidence id wins."""
    last = t.documents.groupBy((F.col("doc_id") % 50).alias("evidence")).agg(F.max("doc_id").alias("doc_id"))
    rows = t.documents.select("doc_id", "source", "lang", "n_chars").join(last, "doc_id")
    origin = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return rows.select("evidence", "doc_id", F.row_number().over(Window.orderBy("source", origin, "n_chars", "doc_id")).alias("place"))


E_SQL = "e AS (SELECT user_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS token, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


def _steps(t: Tables) -> DataFrame:
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("token"), second.alias("at"), "ts", "event_id")


@query(f"""WITH RECURSIVE {E_SQL}, s(user_id, i, status, attempts, ok, accepted) AS (SELECT user_id, CAST(0 AS BIGINT), 'NEW', CAST(0 AS BIGINT), false, CAST(0 AS BIGINT) FROM e WHERE i = 1 UNION ALL
SELECT x.user_id, x.i, CASE WHEN ok2 THEN CASE kind WHEN 'signup' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END ELSE status END, attempts + CASE WHEN ok2 AND kind = 'signup' THEN 1 ELSE 0 END, ok2, accepted + CASE WHEN ok2 THEN 1 ELSE 0 END FROM (SELECT e.user_id, e.i, e.kind, s.status, s.attempts, s.accepted, CASE e.kind WHEN 'signup' THEN s.status IN ('NEW', 'FAILED', 'SUPERSEDED') WHEN 'purchase' THEN s.status = 'RUNNING' WHEN 'error' THEN s.status = 'RUNNING' ELSE false END AS ok2 FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) x)
SELECT user_id, arg_max(accepted, i) AS accepted, max(i) - arg_max(accepted, i) AS refused, arg_max(status, i) AS status, arg_max(attempts, i) AS attempts FROM s GROUP BY user_id""")
def revision_claims(t: Tables) -> DataFrame:
    """Claims of revisions: new or failed ones are claimed, running ones are not, only running ones finish."""
    return L.machine(_steps(t), "user_id", ["ts", "event_id"], ["event_type"], L.revision_step, {"status": "NEW", "attempts": 0}, "status string, attempts long")


@query(f"""WITH RECURSIVE {E_SQL}, s(user_id, i, status, epoch, attempts, lease, accepted) AS (SELECT user_id, CAST(0 AS BIGINT), 'NEW', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e WHERE i = 1 UNION ALL
SELECT user_id, i, CASE WHEN NOT ok THEN status WHEN kind = 'signup' THEN 'QUEUED' WHEN kind = 'click' THEN 'INDEXING' WHEN kind = 'view' THEN status WHEN kind = 'purchase' THEN 'READY' WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY' END, epoch + CASE WHEN ok AND kind = 'click' THEN 1 ELSE 0 END, CASE WHEN ok AND kind = 'signup' THEN 0 WHEN ok AND kind = 'click' THEN attempts + 1 ELSE attempts END, CASE WHEN ok AND kind IN ('click', 'view') THEN sec + 259200 ELSE lease END, accepted + CASE WHEN ok THEN 1 ELSE 0 END
FROM (SELECT e.user_id, e.i, e.kind, e.sec, s.status, s.epoch, s.attempts, s.lease, s.accepted, CASE e.kind WHEN 'signup' THEN s.status NOT IN ('QUEUED', 'RETRY', 'INDEXING') WHEN 'click' THEN (s.status IN ('QUEUED', 'RETRY') OR (s.status = 'INDEXING' AND s.lease <= e.sec)) AND s.attempts < 3 ELSE s.status = 'INDEXING' AND e.token % 2 = s.epoch % 2 AND s.lease > e.sec END AS ok FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id, arg_max(accepted, i) AS accepted, max(i) - arg_max(accepted, i) AS refused, arg_max(status, i) AS status, arg_max(epoch, i) AS epoch, arg_max(attempts, i) AS attempts, arg_max(lease, i) AS lease FROM s GROUP BY user_id""")
def ingestion_jobs(t: Tables) -> DataFrame:
    """Ingestion runs: queued, claimed under a new epoch, kept alive, finished or failed only by who holds them."""
    step = lambda state, event: L.ingestion_step(state, event, 259_200)  # noqa: E731  a lease of three days
    return L.machine(_steps(t), "user_id", ["ts", "event_id"], ["event_type", "token", "at"], step, {"status": "NEW", "epoch": 0, "attempts": 0, "lease": 0}, "status string, epoch long, attempts long, lease long")


@query(f"""WITH RECURSIVE {E_SQL}, s(user_id, i, status, wanted, claimed, published, lease, accepted) AS (SELECT user_id, CAST(0 AS BIGINT), 'NEW', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e WHERE i = 1 UNION ALL
SELECT user_id, i, CASE WHEN NOT ok THEN status WHEN kind = 'signup' THEN CASE WHEN status IN ('NEW', 'PUBLISHED') THEN 'PENDING' ELSE status END WHEN kind = 'click' THEN 'PUBLISHING' WHEN kind = 'purchase' THEN CASE WHEN claimed = wanted THEN 'PUBLISHED' ELSE 'PENDING' END ELSE 'RETRY' END, wanted + CASE WHEN kind = 'signup' THEN 1 ELSE 0 END, CASE WHEN ok AND kind = 'click' THEN wanted ELSE claimed END, CASE WHEN ok AND kind = 'purchase' THEN claimed ELSE published END, CASE WHEN ok AND kind = 'click' THEN sec + 259200 ELSE lease END, accepted + CASE WHEN ok THEN 1 ELSE 0 END
FROM (SELECT e.user_id, e.i, e.kind, e.sec, s.status, s.wanted, s.claimed, s.published, s.lease, s.accepted, CASE e.kind WHEN 'signup' THEN true WHEN 'click' THEN s.status IN ('PENDING', 'RETRY') OR (s.status = 'PUBLISHING' AND s.lease <= e.sec) WHEN 'view' THEN false ELSE s.status = 'PUBLISHING' AND s.lease > e.sec END AS ok FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id, arg_max(accepted, i) AS accepted, max(i) - arg_max(accepted, i) AS refused, arg_max(status, i) AS status, arg_max(wanted, i) AS wanted, arg_max(claimed, i) AS claimed, arg_max(published, i) AS published, arg_max(lease, i) AS lease FROM s GROUP BY user_id""")
def check_publications(t: Tables) -> DataFrame:
    """Publications of checks: claimed under a lease, acknowledged with the version that was claimed."""
    step = lambda state, event: L.publication_step(state, event, 259_200)
    start = {"status": "NEW", "wanted": 0, "claimed": 0, "published": 0, "lease": 0}
    return L.machine(_steps(t), "user_id", ["ts", "event_id"], ["event_type", "at"], step, start, "status string, wanted long, claimed long, published long, lease long")
