"""Graph queries: parts, suppliers, customers and nations as entities, order lines as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import classify as C
from sparkloom.functions import identity as I
from sparkloom.operators import graph as G
from sparkloom.operators import modularity as M
from sparkloom.operators import ranges as RG
from sparkloom.operators import walk as W
from sparkloom.operators.steps import growing, materialise

from .registry import Tables, query

CODE = "code AS (SELECT 'p' || l_partkey AS src, 'SUPPLIED_BY' AS rel, 's' || l_suppkey AS dst, max(round(1 - l_discount, 4)) AS confidence, CAST(min(l_orderkey) AS BIGINT) AS seq, min(l_shipdate) AS rationale FROM lineitem GROUP BY ALL)"
ASSERT = "asserted AS (SELECT 'c' || o_custkey AS src, 'ORDERS' AS rel, 'p' || l_partkey AS dst, max(round(l_quantity / 50, 4)) AS confidence, CAST(min(o_orderkey) AS BIGINT) AS seq FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' GROUP BY ALL)"
BOTH = "both_ AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM code UNION ALL SELECT dst, src FROM code) WHERE a <> b)"


def code_edges(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = t.lineitem.select(name("p", "l_partkey").alias("src"), F.lit("SUPPLIED_BY").alias("rel"), name("s", "l_suppkey").alias("dst"), F.round(1 - F.col("l_discount"), 4).alias("confidence"), "l_orderkey")
    return rows.groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence"), F.min("l_orderkey").alias("seq"))


def assertion_edges(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = t.orders.where(F.col("o_orderpriority").startswith("1")).join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(name("c", "o_custkey").alias("src"), F.lit("ORDERS").alias("rel"), name("p", "l_partkey").alias("dst"), F.round(F.col("l_quantity") / 50, 4).alias("confidence"), "o_orderkey")
    return rows.groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence"), F.min("o_orderkey").alias("seq"))


@query(f"WITH {CODE} SELECT src, rel, dst, confidence, seq FROM code")
def edges_code(t: Tables) -> DataFrame:
    return code_edges(t)


@query(f"WITH {ASSERT} SELECT src, rel, dst, confidence, seq FROM asserted")
def edges_assertion(t: Tables) -> DataFrame:
    return assertion_edges(t)


@query("""WITH d AS (SELECT 'p' || l_partkey AS src, 'SUPPLIED_BY' AS rel, 's' || l_suppkey AS dst, round(1 - l_discount, 4) AS confidence, l_returnflag AS source, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linestatus = 'O' THEN l_returnflag || l_linenumber END AS rationale FROM lineitem)
SELECT src, rel, dst, max(confidence) AS confidence, arg_min(rationale, seq) FILTER (rationale IS NOT NULL) AS rationale, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM d GROUP BY ALL""")
def edges_merged(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rationale = F.when(F.col("l_linestatus") == "O", F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    rows = t.lineitem.select(name("p", "l_partkey").alias("src"), F.lit("SUPPLIED_BY").alias("rel"), name("s", "l_suppkey").alias("dst"), F.round(1 - F.col("l_discount"), 4).alias("confidence"), F.col("l_returnflag").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), rationale.alias("rationale"))
    return G.merged_edges(rows).withColumn("sources", F.array_join("sources", ","))


SAID = """d AS (SELECT DISTINCT 'p' || l_partkey AS src, CASE l_returnflag WHEN 'R' THEN 'CALLS' WHEN 'A' THEN 'READS_FROM' ELSE 'USES' END AS rel, 's' || l_suppkey AS dst FROM lineitem),
a AS (SELECT 'p' || l_partkey || '|' || CASE l_returnflag WHEN 'R' THEN 'CALLS' WHEN 'A' THEN 'READS_FROM' ELSE 'USES' END || '|s' || l_suppkey AS edge, 'p' || l_partkey AS src, CASE l_returnflag WHEN 'R' THEN 'CALLS' WHEN 'A' THEN 'READS_FROM' ELSE 'USES' END AS rel, 's' || l_suppkey AS dst, bool_and(l_linestatus = 'F') AS adr, count(DISTINCT o_orderkey) AS support FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%' GROUP BY ALL),
q AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) UNION SELECT 'p' || p_partkey FROM part WHERE p_brand LIKE '%1')"""
PLACE = "CAST(adr AS INTEGER), CASE rel WHEN 'CALLS' THEN 0 WHEN 'READS_FROM' THEN 1 ELSE 2 END, edge"


def _said(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(direct, asserted, supports, asked): parts and suppliers, related by the lines' return flags; urgent orders assert
    such relations and support them, and suppliers and parts of some regions and brands are asked about."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rel = F.when(F.col("l_returnflag") == "R", "CALLS").when(F.col("l_returnflag") == "A", "READS_FROM").otherwise("USES")
    ends = [name("p", "l_partkey").alias("src"), rel.alias("rel"), name("s", "l_suppkey").alias("dst")]
    direct = t.lineitem.select(*ends).distinct()
    urgent = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"))
    said = t.lineitem.join(urgent, "l_orderkey").select("l_orderkey", "l_linestatus", *ends).withColumn("edge", F.concat_ws("|", "src", "rel", "dst"))
    asserted = said.groupBy("src", "rel", "dst").agg(F.bool_and(F.col("l_linestatus") == "F").alias("adr")).select(F.concat_ws("|", "src", "rel", "dst").alias("edge"), "src", "rel", "dst", "adr")
    near = t.nation.where("n_regionkey < 2").select(F.col("n_nationkey").alias("s_nationkey"))
    asked = t.supplier.join(near, "s_nationkey", "left_semi").select(name("s", "s_suppkey").alias("node")).union(t.part.where(F.col("p_brand").endswith("1")).select(name("p", "p_partkey")))
    return direct, asserted, said.select("edge", F.col("l_orderkey").cast("string").alias("chunk")), asked


@query(f"WITH {SAID} SELECT src, rel, dst, 'assertion' AS kind FROM a UNION ALL SELECT src, rel, dst, 'direct' FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.src = d.src AND a.rel = d.rel AND a.dst = d.dst)")
def relationship_inventory(t: Tables) -> DataFrame:
    """Asserted relationships, and direct ones that no assertion of the same type stands for."""
    edges, asserted, _, _ = _said(t)
    direct = G.uncovered_direct(edges, asserted)
    return asserted.select("src", "rel", "dst", F.lit("assertion").alias("kind")).unionByName(direct.select("src", "rel", "dst", F.lit("direct").alias("kind")))


@query(f"""WITH {SAID}, x AS (SELECT 'assertion' AS kind, edge, src, rel, dst, adr, support FROM a WHERE src IN (FROM q) OR dst IN (FROM q)),
y AS (SELECT 'direct' AS kind, src || '|' || rel || '|' || dst AS edge, src, rel, dst, false AS adr, 0 AS support FROM d WHERE (src IN (FROM q) OR dst IN (FROM q)) AND NOT EXISTS (SELECT 1 FROM a WHERE a.src = d.src AND a.rel = d.rel AND a.dst = d.dst)) FROM x UNION ALL FROM y""")
def relationships_of_entities(t: Tables) -> DataFrame:
    """All relationships with one end or the other among the entities asked about, with the support of asserted ones."""
    direct, asserted, supports, asked = _said(t)
    return W.inventory(asked, asserted, supports, direct)


WALK = f"""{SAID}, u AS (SELECT edge, src, dst, rel, adr FROM a UNION ALL SELECT src || '|' || rel || '|' || dst, src, dst, rel, false FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.src = d.src AND a.rel = d.rel AND a.dst = d.dst)),
s0 AS (SELECT 's' || s_suppkey AS node FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) WHERE n = 1),
m1 AS (SELECT u.*, node FROM u JOIN s0 ON node = src UNION ALL SELECT u.*, node FROM u JOIN s0 ON node = dst),
c1 AS (SELECT DISTINCT edge, src, dst, rel, adr FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {PLACE}) AS n FROM m1) WHERE n <= 12),
t1 AS (SELECT *, row_number() OVER (ORDER BY {PLACE}) AS place FROM c1 QUALIFY place <= 2000),
n1 AS (SELECT node FROM (SELECT src AS node FROM t1 UNION SELECT dst FROM t1) WHERE node NOT IN (FROM s0)),
f1 AS (SELECT node FROM n1 WHERE node IN (SELECT src FROM t1 WHERE NOT adr UNION SELECT dst FROM t1 WHERE NOT adr)),
m2 AS (SELECT u.*, node FROM u JOIN f1 ON node = src UNION ALL SELECT u.*, node FROM u JOIN f1 ON node = dst),
c2 AS (SELECT DISTINCT edge, src, dst, rel, adr FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {PLACE}) AS n FROM m2) WHERE n <= 12 AND edge NOT IN (SELECT edge FROM t1)),
t2 AS (SELECT *, row_number() OVER (ORDER BY {PLACE}) + (SELECT count(*) FROM t1) AS place FROM c2 QUALIFY place <= 2000)"""


def _walked(t: Tables) -> tuple[DataFrame, DataFrame]:
    direct, asserted, _, _ = _said(t)
    bare = G.uncovered_direct(direct, asserted).select(F.concat_ws("|", "src", "rel", "dst").alias("edge"), "src", "dst", "rel", F.lit(False).alias("adr"))
    edges = materialise(asserted.select("edge", "src", "dst", "rel", "adr").unionByName(bare), "edges")
    first = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    seeds = t.supplier.withColumn("nth", first).where("nth = 1").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return W.walked(seeds, edges, 2, 12, 2000)


@query(f"WITH {WALK} SELECT edge, src, dst, rel, adr, 1 AS hop, CAST(place AS BIGINT) AS place FROM t1 UNION ALL SELECT edge, src, dst, rel, adr, 2, CAST(place AS BIGINT) FROM t2")
def walk_edges(t: Tables) -> DataFrame:
    """Two hops from the richest supplier of each nation: twelve edges a subject, calls first, asserted ones last and
    not followed."""
    return _walked(t)[0].select("edge", "src", "dst", "rel", "adr", "hop", F.col("place").cast("long").alias("place"))


@query(f"WITH {WALK}, n2 AS (SELECT node FROM (SELECT src AS node FROM t2 UNION SELECT dst FROM t2) WHERE node NOT IN (FROM s0) AND node NOT IN (FROM n1)) SELECT node, 0 AS distance FROM s0 UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2")
def walk_nodes(t: Tables) -> DataFrame:
    """What that walk leads to, with the distance."""
    return _walked(t)[1]


def _neighbourhood_sql(hops: int) -> str:
    steps = "".join(f", h{d} AS (SELECT DISTINCT b AS node FROM h{d - 1} JOIN lim ON a = node)" for d in range(1, hops + 1))
    union = " UNION ALL ".join(f"SELECT node, {d} AS distance FROM h{d}" for d in range(hops + 1))
    return f"WITH {CODE}, {BOTH}, lim AS (SELECT a, b FROM both_ QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 12), h0 AS (SELECT 's' || s_suppkey AS node FROM supplier){steps} SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM ({union}) GROUP BY node"


def _neighbourhood(t: Tables, hops: int) -> DataFrame:
    """The walk starts from all suppliers."""
    seeds = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return G.neighbourhood(seeds, G.undirected(code_edges(t)), hops, 12)


@query(_neighbourhood_sql(1))
def neighborhood_1hop(t: Tables) -> DataFrame:
    return _neighbourhood(t, 1)


@query(_neighbourhood_sql(2))
def neighborhood_2hop(t: Tables) -> DataFrame:
    return _neighbourhood(t, 2)


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders QUALIFY nth <= 201)
SELECT o.o_orderkey, CAST(nth AS INTEGER) AS nth, (SELECT max(nth) > 200 FROM o) AS truncated, coalesce(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_partkey IS NOT NULL)), ','), '') AS parts FROM o LEFT JOIN lineitem ON l_orderkey = o.o_orderkey WHERE nth <= 200 GROUP BY ALL""")
def inventory_bounded(t: Tables) -> DataFrame:
    """The bound comes before the outer join, so a row of the inventory never loses its place to lines."""
    head = G.bounded(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 200)
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    return head.join(lines, head.o_orderkey == lines.l_orderkey, "left").groupBy("o_orderkey", "nth", "truncated").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ",").alias("parts"))


@query("""SELECT c_custkey, score FROM (SELECT c_custkey, CAST((CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') THEN 8 ELSE 0 END) + (CASE WHEN n_regionkey = 1 THEN 4 ELSE 0 END) + (CASE WHEN c_acctbal > 5000 THEN 3 ELSE 0 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END) + (CASE WHEN c_name LIKE '%1' THEN 1 ELSE 0 END) AS INTEGER) AS score FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE score > 0 ORDER BY score DESC, c_custkey LIMIT 500""")
def requirement_hints(t: Tables) -> DataFrame:
    """Additive hints over an OR of predicates, bounded after scoring: top 500."""
    urgent = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("urgent", F.lit(8))
    add = lambda test, n: F.when(test, n).otherwise(0)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(urgent, "c_custkey", "left")
    score = F.coalesce("urgent", F.lit(0)) + add(F.col("n_regionkey") == 1, 4) + add(F.col("c_acctbal") > 5000, 3) + add(F.col("c_mktsegment") == "BUILDING", 2) + add(F.col("c_name").endswith("1"), 1)
    return rows.select("c_custkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "c_custkey").limit(500)


@query("""SELECT sha256(concat_ws('|', 'parts', replace(lower(trim(p_type)), 'ß', 'ss'), replace(lower(trim(p_name)), 'ß', 'ss'))) AS key, arg_min(p_name, p_partkey) AS name, count(*) AS mentions, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS spellings FROM part GROUP BY 1""")
def entity_resolution_exact(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_name").alias("name"), "p_type", F.col("p_partkey").alias("seq"))
    return G.canonical(rows, I.entity_id(F.lit("parts"), F.col("p_type"), F.col("name"))).withColumn("spellings", F.array_join("spellings", "|"))


@query(r"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 'Module' ELSE p_type END AS label, CASE WHEN p_partkey % 3 = 0 THEN upper(replace(p_name, ' ', '-')) ELSE p_name END AS name, CASE WHEN p_size % 5 = 0 THEN p_name || ' ' || p_brand ELSE 'x' || p_partkey END AS other FROM part),
m AS (SELECT id AS mention_id, lower(coalesce(label, 'Component')) AS want, lower(CASE WHEN id % 4 = 0 THEN other ELSE name END) AS n FROM p WHERE id % 2 = 0),
e AS (SELECT id AS entity_id, lower(coalesce(label, '')) AS label, lower(name) AS name, lower(other) AS other FROM p WHERE id % 2 = 1),
c AS (SELECT m.mention_id, e.entity_id, m.want = e.label AS same, m.want = e.label OR e.label = '' OR e.label IN ('component', 'entity', 'module', 'architecturecomponent') OR m.want IN ('component', 'entity', 'module', 'architecturecomponent') AS fits, m.n = e.name AS own, m.n = e.name OR m.n = e.other AS any_, regexp_replace(m.n, '[\s_\-]+', '', 'g') IN (regexp_replace(e.name, '[\s_\-]+', '', 'g'), regexp_replace(e.other, '[\s_\-]+', '', 'g')) AS bare FROM m JOIN e ON regexp_replace(m.n, '[\s_\-]+', '', 'g') IN (regexp_replace(e.name, '[\s_\-]+', '', 'g'), regexp_replace(e.other, '[\s_\-]+', '', 'g'))),
t AS (SELECT *, CASE WHEN same AND own THEN 1 WHEN same AND any_ THEN 2 WHEN fits AND any_ THEN 3 WHEN fits AND bare THEN 4 END AS tier FROM c),
f AS (SELECT mention_id, min(tier) AS tier FROM t GROUP BY 1),
g AS (SELECT f.mention_id, f.tier, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM f JOIN t ON t.mention_id = f.mention_id AND t.tier <= f.tier GROUP BY ALL)
SELECT m.mention_id, CASE WHEN g.n = 1 THEN g.e END AS entity_id, coalesce(g.tier, 0) AS tier, coalesce(g.n, 0) > 1 AS ambiguous FROM m LEFT JOIN g ON g.mention_id = m.mention_id""")
def entity_resolution_tiered(t: Tables) -> DataFrame:
    """Even parts are mentions, odd parts are the known entities: both halves of the whole table. Labels are
    missing or generic for some, names differ in case and hyphens, and every entity has an alias."""
    label = F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 7 == 1, "Module").otherwise(F.col("p_type"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))).otherwise(F.col("p_name"))
    other = F.when(F.col("p_size") % 5 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.concat(F.lit("x"), F.col("p_partkey")))
    rows = t.part.select(F.col("p_partkey").alias("id"), label.alias("label"), name.alias("name"), other.alias("other"))
    mentions = rows.where("id % 2 = 0").select(F.col("id").alias("mention_id"), "label", F.when(F.col("id") % 4 == 0, F.col("other")).otherwise(F.col("name")).alias("name"))
    entities = rows.where("id % 2 = 1").select(F.col("id").alias("entity_id"), "label", "name", F.array("other").alias("aliases"))
    return G.resolve_tiered(mentions, entities, I.folded, I.squeezed)


@query("""SELECT 'part' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25) UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.08) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def graph_orphans(t: Tables) -> DataFrame:
    """Entities to which no edge of the kept kinds leads: returned lines and urgent orders are the edges."""
    back = t.lineitem.where("l_returnflag = 'R'")
    kinds = (("part", t.part, "p_partkey", back.where("l_quantity > 25"), "l_partkey"), ("supplier", t.supplier, "s_suppkey", back.where("l_quantity > 49 AND l_discount > 0.08"), "l_suppkey"), ("customer", t.customer, "c_custkey", t.orders.where(F.col("o_orderpriority").startswith("1")), "o_custkey"))
    out = None
    for kind, rows, key, other, ref in kinds:
        found = rows.join(other.select(F.col(ref).alias(key)), key, "left_anti").select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        out = found if out is None else out.union(found)
    return out


def _dearest(t: Tables) -> DataFrame:
    """From each customer to the part of the dearest line of all its orders."""
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    first = F.min_by("l_partkey", F.struct(-F.col("l_extendedprice"), "l_orderkey", "l_linenumber"))
    best = rows.groupBy("o_custkey").agg(first.alias("part"))
    return best.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("part").cast("string")).alias("dst"))


COMMUNITIES = """WITH RECURSIVE d AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1),
e AS (SELECT src AS a, dst AS b FROM d UNION SELECT dst, src FROM d),
r(node, l) AS (SELECT a, a FROM e UNION SELECT e.b, r.l FROM r JOIN e ON r.node = e.a WHERE r.l < e.b), c AS (SELECT node, min(l) AS community FROM r GROUP BY node)
SELECT node, community, 'comm_' || substr(sha256(string_agg(node, '|' ORDER BY node) OVER (PARTITION BY community ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 1, 12) AS community_id FROM c"""


@query(COMMUNITIES)
def community_components(t: Tables) -> DataFrame:
    """Communities of customers and the parts they spend most on, with the digest of each."""
    return G.with_community_ids(G.communities(G.undirected(_dearest(t))))


def _spending(t: Tables) -> DataFrame:
    """Edges of a customer to its nation, of a supplier to its nation, and of a customer to the supplier of the dearest
    line of each order."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    first = F.min_by("l_suppkey", F.struct(-F.col("l_extendedprice"), "l_linenumber"))
    lines = t.lineitem.groupBy("l_orderkey").agg(first.alias("supplier"))
    bought = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(name("c", "o_custkey").alias("src"), name("s", "supplier").alias("dst"))
    home = t.customer.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    return bought.unionByName(home).unionByName(t.supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")))


@query()
def community_modularity(t: Tables) -> DataFrame:
    """Communities of customers, suppliers and nations by modularity, with the digest of each."""
    return G.with_community_ids(M.by_modularity(_spending(t)))


SPENDING = """s AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


@query(f"WITH {SPENDING}, n AS (SELECT src AS node FROM s UNION SELECT dst FROM s) SELECT 'nodes' AS property, count(*) AS value FROM n UNION ALL SELECT 'nodes in two communities', 0 UNION ALL SELECT 'ids of two communities', 0 UNION ALL SELECT 'communities in several parts', 0 UNION ALL SELECT 'modularity below that of nations', 0")
def community_invariants(t: Tables) -> DataFrame:
    """What must hold of communities by modularity: all nodes have one, ids differ, each is connected, and the
    modularity is not below that of the nations with their customers and suppliers."""
    edges = materialise(_spending(t), "edges")
    found = materialise(G.with_community_ids(M.by_modularity(edges)), "found")
    links = M.weighted(edges)
    home = edges.where("dst LIKE 'n%'").select(F.col("src").alias("node"), F.col("dst").alias("c"))
    home = home.union(home.select(F.col("c").alias("node"), "c").distinct())
    best, plain = M.modularity(links, found.select("node", F.col("community").alias("c"))), M.modularity(links, home)
    ends = links.join(growing(found.select(F.col("node").alias("a"), F.col("community").alias("ca"))), "a").join(growing(found.select(F.col("node").alias("b"), F.col("community").alias("cb"))), "b")
    whole = G.communities(ends.where("ca = cb").select("a", "b")).select("node", F.col("community").alias("part"))
    apart = found.join(growing(whole), "node").groupBy("community").agg(F.countDistinct("part").alias("n")).where("n > 1")
    twice = found.groupBy("node").agg(F.countDistinct("community").alias("n")).where("n > 1")
    shared = found.groupBy("community_id").agg(F.countDistinct("community").alias("n")).where("n > 1")
    out = None
    for name, rows in {"nodes": found, "nodes in two communities": twice, "ids of two communities": shared, "communities in several parts": apart}.items():
        one = rows.agg(F.lit(name).alias("property"), F.count("*").alias("value"))
        out = one if out is None else out.union(one)
    return out.union(edges.sparkSession.range(1).select(F.lit("modularity below that of nations"), F.lit(int(best < plain)).cast("long")))


@query("""WITH p AS (SELECT page_id, length(html) AS size, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS s FROM pages),
x AS (SELECT page_id, size, array_to_string(s[1:i], '/') AS prefix FROM (SELECT page_id, size, s, unnest(range(1, greatest(len(s), 2))) AS i FROM p))
SELECT prefix, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM x GROUP BY prefix""")
def manifest_rollup(t: Tables) -> DataFrame:
    """Files and sizes of every directory, over all that lies below it."""
    parts = F.filter(F.split(F.regexp_replace("url", "^https?://", ""), "/"), lambda x: x != "")
    rows = t.pages.select(F.length("html").alias("size"), parts.alias("s"))
    steps = F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1)))
    rows = rows.select("size", F.explode(F.transform(steps, lambda i: F.array_join(F.slice("s", F.lit(1), i), "/"))).alias("prefix"))
    return rows.groupBy("prefix").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"))


@query(r"""WITH f AS (SELECT doc_id, 'src/' || source || CASE doc_id % 12 WHEN 0 THEN '/adr/X.MD' WHEN 1 THEN '/main.py' WHEN 2 THEN '/openapi.json' WHEN 3 THEN '/a.proto' WHEN 4 THEN '/settings.toml' WHEN 5 THEN '/LICENSE' WHEN 6 THEN '/.env' WHEN 7 THEN '/logo.png' WHEN 8 THEN '/yarn.lock' WHEN 9 THEN '/x.hpp' WHEN 10 THEN '/Swagger.ts' ELSE '/a.env.example' END AS path FROM documents),
n AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS name, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\.([^.]+)$', 1)) AS s FROM f),
p AS (SELECT *, CASE WHEN s IN ('png','jpg','jpeg','gif','svg','ico','webp','zip','tar','gz','7z','rar','pdf','exe','dll','so','dylib','pyc','pyo','pyd','lock','map') OR name IN ('package-lock.json','uv.lock','poetry.lock','yarn.lock') THEN 1 WHEN s IN ('md','markdown','mdown') THEN 2 WHEN s = 'proto' THEN 3 WHEN contains(name, 'openapi') OR contains(name, 'swagger') THEN 4 WHEN s IN ('py','ts','tsx','js','jsx','go','java','rs','c','cpp','h','hpp','cs','rb') THEN 5 WHEN s IN ('yaml','yml','json','toml','ini','conf') THEN 6 ELSE 7 END AS k FROM n)
SELECT doc_id, path, CASE k WHEN 1 THEN 'EXCLUDE' WHEN 7 THEN 'LOW_PRIORITY' ELSE 'INCLUDE' END AS action, CASE k WHEN 1 THEN 'FALLBACK' WHEN 2 THEN 'MARKDOWN_SECTION' WHEN 3 THEN 'PROTO_MESSAGE' WHEN 4 THEN 'OPENAPI_OPERATION' WHEN 5 THEN 'SYMBOL' WHEN 6 THEN 'CONFIG_SECTION' ELSE 'WHOLE_FILE' END AS strategy, CASE k WHEN 2 THEN 'markdown' WHEN 3 THEN 'proto' WHEN 4 THEN s WHEN 6 THEN s WHEN 5 THEN CASE s WHEN 'py' THEN 'python' WHEN 'hpp' THEN 'cpp' ELSE s END END AS language FROM p""")
def file_classify(t: Tables) -> DataFrame:
    """What a plan does with a file; one strategy in three takes the file whole."""
    ends = F.array(*[F.lit(x) for x in ("/adr/X.MD", "/main.py", "/openapi.json", "/a.proto", "/settings.toml", "/LICENSE", "/.env", "/logo.png", "/yarn.lock", "/x.hpp", "/Swagger.ts", "/a.env.example")])
    rows = t.documents.select("doc_id", F.concat(F.lit("src/"), "source", F.element_at(ends, (F.col("doc_id") % 12 + 1).cast("int"))).alias("path"))
    plan = C.file_plan(F.col("path"))
    return rows.select("doc_id", "path", plan.alias("p")).select("doc_id", "path", "p.*")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING' WHEN d.doc_id IS NULL THEN 'UNKNOWN' WHEN n > 1 THEN 'DUPLICATE' ELSE 'COVERED' END AS state FROM documents d FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""")
def plan_coverage(t: Tables) -> DataFrame:
    planned = t.labels.groupBy("doc_id").agg(F.count("*").alias("n"))
    have = t.documents.select("doc_id", F.lit(1).alias("here"))
    state = F.when(F.col("n").isNull(), "MISSING").when(F.col("here").isNull(), "UNKNOWN").when(F.col("n") > 1, "DUPLICATE").otherwise("COVERED")
    return have.join(planned, "doc_id", "full").select("doc_id", state.alias("state"))


@query("""WITH o AS (SELECT doc_id // 2 AS path, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id // 2 AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN (SELECT text FROM documents x WHERE x.doc_id = d.doc_id - 1) ELSE text END) AS h FROM documents d WHERE doc_id % 2 = 1 AND doc_id % 3 > 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'ADDED' WHEN n.path IS NULL THEN 'DELETED' WHEN o.h = n.h THEN 'SAME' ELSE 'MODIFIED' END AS change FROM o FULL JOIN n ON n.path = o.path""")
def diff_two_manifests(t: Tables) -> DataFrame:
    """Two manifests made from even and odd documents; some odd ones repeat their even neighbour."""
    d = t.documents
    path = F.floor(F.col("doc_id") / 2).alias("path")
    old = d.where("doc_id % 2 = 0").select(path, I.digest(F.col("text")).alias("old"), F.lit(1).alias("o"))
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("same"))
    new = d.where("doc_id % 2 = 1 AND doc_id % 3 > 0").join(before, "doc_id", "left")
    new = new.select(path, I.digest(F.when(F.col("doc_id") % 5 == 0, F.col("same")).otherwise(F.col("text"))).alias("new"), F.lit(1).alias("n"))
    change = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "DELETED").when(F.col("old") == F.col("new"), "SAME").otherwise("MODIFIED")
    return old.join(new, "path", "full").select("path", change.alias("change"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_shipdate AS lo, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS hi FROM lineitem)
SELECT x.l_orderkey, x.l_linenumber AS a, y.l_linenumber AS b FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND x.lo <= y.hi AND y.lo <= x.hi""")
def interval_overlap(t: Tables) -> DataFrame:
    """Lines of one order whose spans meet."""
    day = F.unix_date(F.to_date("l_shipdate"))
    spans = t.lineitem.select("l_orderkey", "l_linenumber", day.alias("lo"), (day + F.col("l_quantity").cast("int")).alias("hi"))
    return RG.overlapping(spans, "l_orderkey", "l_linenumber", "lo", "hi").where("a <> b")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber AS n, l_shipdate AS lo, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS hi, CAST(l_quantity AS INTEGER) AS w FROM lineitem)
SELECT x.l_orderkey, x.n AS inner_line, arg_min(y.n, y.w * 100 + y.n) AS outer_line FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND x.n <> y.n AND y.lo <= x.lo AND x.hi <= y.hi AND y.w > x.w GROUP BY ALL""")
def innermost_range(t: Tables) -> DataFrame:
    """The narrowest span of the same order that encloses a line's span: an order has a handful of lines, which are
    compared with each other. supplier_innermost is the way for keys with many ranges."""
    width = F.col("l_quantity").cast("int")
    hi = F.expr("l_shipdate + make_dt_interval(cast(l_quantity as int))")
    span = lambda n: t.lineitem.select("l_orderkey", F.col("l_linenumber").alias(n), F.col("l_shipdate").alias(f"{n}_lo"), hi.alias(f"{n}_hi"), width.alias(f"{n}_w"))
    pairs = span("x").join(span("y"), "l_orderkey").where("x <> y AND y_lo <= x_lo AND x_hi <= y_hi AND y_w > x_w")
    return pairs.groupBy("l_orderkey", F.col("x").alias("inner_line")).agg(F.min_by("y", F.col("y_w") * 100 + F.col("y")).alias("outer_line"))


@query(f"WITH {CODE} SELECT src, rel, dst FROM code WHERE src IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10) AND dst IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def graph_read(t: Tables) -> DataFrame:
    """Edges whose two ends are among the nodes shown."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    nodes = t.part.where("p_size > 10").select(name("p", "p_partkey")).union(t.supplier.where("s_acctbal > 0").select(name("s", "s_suppkey")))
    return G.with_both_ends(code_edges(t), nodes).select("src", "rel", "dst")
