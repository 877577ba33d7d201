import random

from sparkloom import plans
from sparkloom.operators import containment, walk

EDGES = "edge string, src string, dst string, rel string, adr boolean"


def order(e):
    return bool(e[4]), 0 if e[3] == "CALLS" else 1 if e[3] in ("READS_FROM", "WRITES_TO") else 2, e[0]


def plain_walk(seeds, edges, hops, cap, most):
    """The edges taken one by one, counting against every subject they touch."""
    found, taken = dict.fromkeys(seeds, 0), {}
    frontier = set(seeds)
    for hop in range(1, hops + 1):
        counts, reached = dict.fromkeys(frontier, 0), set()
        for e in sorted((e for e in edges if {e[1], e[2]} & frontier), key=order):
            mine = {e[1], e[2]} & frontier
            if all(counts[n] >= cap for n in mine):
                continue
            for n in mine:
                counts[n] += 1
            if e[3] is None or e[0] in taken or len(taken) >= most:
                continue
            taken[e[0]] = hop
            reached |= {e[1], e[2]} - set(found)
        found |= dict.fromkeys(reached, hop)
        seen = {n for e in edges if e[0] in taken and not e[4] for n in e[1:3]}
        frontier = reached & seen
    return taken, found


def test_walk_equals_plain_loop(spark):
    rng = random.Random(6)
    for turn in range(3):
        nodes = [f"n{i}" for i in range(30)]
        edges = []
        for i in range(160):
            a, b = rng.choice(nodes[:6] if rng.random() < 0.4 else nodes), rng.choice(nodes)
            edges.append((f"e{i:03d}", a, b, rng.choice(["CALLS", "READS_FROM", "WRITES_TO", "USES", "OWNS", None]), rng.choice([True, False, False, None])))
        seeds = rng.sample(nodes, 3)
        cap, most, hops = (3, 1000, 2) if turn < 2 else (4, 17, 3)
        taken, found = walk.walked(spark.createDataFrame([(s,) for s in [*seeds, None]], "node string"), spark.createDataFrame(edges, EDGES).repartition(3), hops, cap, most)
        want_edges, want_nodes = plain_walk(seeds, edges, hops, cap, most)
        assert {r.edge: r.hop for r in taken.collect()} == want_edges
        assert {r.node: r.distance for r in found.collect()} == want_nodes


def test_inventory_of_relationships(spark):
    asserted = [("a1", "x", "y", "CALLS", False), ("a2", "y", "z", "USES", True), ("a3", "q", "r", "CALLS", False), ("a4", "x", "x", "OWNS", False)]
    direct = [("x", "CALLS", "y"), ("x", "USES", "y"), ("z", "CALLS", "x"), ("q", "USES", "r"), ("x", "USES", "x")]
    supports = [("a1", "c1"), ("a1", "c2"), ("a1", "c1"), ("a3", "c3"), ("a2", None)]
    asked = spark.createDataFrame([("x",), ("z",)], "node string")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = walk.inventory(asked, frame(asserted, EDGES), frame(supports, "edge string, chunk string"), frame(direct, "src string, rel string, dst string"), 10)
    assert sorted((r.kind, r.edge, r.support) for r in found.collect()) == [("assertion", "a1", 2), ("assertion", "a2", 0), ("assertion", "a4", 0), ("direct", "x|USES|x", 0), ("direct", "x|USES|y", 0), ("direct", "z|CALLS|x", 0)]
    few = walk.inventory(asked, frame(asserted, EDGES), frame(supports, "edge string, chunk string"), frame(direct, "src string, rel string, dst string"), 1)
    assert sorted((r.kind, r.edge) for r in few.collect()) == [("assertion", "a1"), ("direct", "x|USES|x")]


def plain_hosts(rows):
    out = []
    for g, i, t in rows:
        if t:
            others = [(-len(u), j, u) for h, j, u in rows if h == g and u and t in u]
            size, host, u = min(others)
            out.append((g, i, host, u.index(t)))
    return sorted(out, key=str)


def test_hosts_equal_plain_search(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(("alpha", "béta", "gamma", "漢字", "x")) + str(rng.randrange(40)) for _ in range(n))
    rows = []
    for i in range(40):
        g = rng.choice(("a", "b", None))
        t = words(rng.randrange(1, 60))
        rows.append((g, i, t))
        for j in range(rng.randrange(3)):
            a = rng.randrange(len(t))
            rows.append((g, 100 * i + 100 + j, t[a : a + rng.randrange(1, 80)]))
    rows += [("a", 9000, rows[0][2]), ("b", 9001, rows[0][2]), ("a", 9002, None), ("a", 9003, ""), ("a", 9004, "x"), ("a", 9005, "a" * 5000), ("a", 9006, "a" * 30), ("a", 9007, "a" * 3)]
    df = spark.createDataFrame(rows, "g string, id long, t string").repartition(4)
    found = containment.hosts(df, "g", "id", "t")
    assert found.columns == ["g", "id", "host", "start"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_hosts(rows)
    assert containment.hosts(df.limit(0), "g", "id", "t").collect() == []


def test_hosts_meet_by_keys_only(spark):
    df = spark.range(50).selectExpr("'g' AS g", "id", "repeat(concat('w', id, ' '), 20) AS t")
    plan = containment.hosts(df, "g", "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_only_edges_that_are_shown_are_counted(spark):
    """Supports of other edges are left out before they are dealt, and counts are of different chunks."""
    asserted = spark.createDataFrame([(f"p{i}|CALLS|s{i}", f"p{i}", "CALLS", f"s{i}", False) for i in range(9)], "edge string, src string, rel string, dst string, adr boolean")
    supports = spark.createDataFrame([(f"p{i}|CALLS|s{i}", f"c{j % 2}") for i in range(9) for j in range(3)] + [("p0|CALLS|s0", None)], "edge string, chunk string")
    asked = spark.createDataFrame([(f"p{i}",) for i in range(9)], "node string")
    found = walk.inventory(asked, asserted, supports, asserted.select("src", "rel", "dst"), 2)
    assert sorted((r.edge, r.support) for r in found.where("kind = 'assertion'").collect()) == [("p0|CALLS|s0", 2), ("p1|CALLS|s1", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan


def test_all_relationships_of_the_entities_asked_about(spark):
    """Of 500 asserted and 500 direct relationships of one entity none is left out, in the operator and in the query."""
    asserted = spark.range(500).selectExpr("concat('x|CALLS|s', id) AS edge", "'x' AS src", "'CALLS' AS rel", "concat('s', id) AS dst", "false AS adr")
    direct = spark.range(500).selectExpr("'x' AS src", "'USES' AS rel", "concat('s', id) AS dst")
    supports = asserted.selectExpr("edge", "explode(array('c1', 'c2')) AS chunk")
    asked = spark.createDataFrame([("x",)], "node string")
    found = walk.inventory(asked, asserted, supports, direct)
    assert {(r.kind, r.support, r.n) for r in found.groupBy("kind", "support").agg({"*": "count"}).toDF("kind", "support", "n").collect()} == {("assertion", 2, 500), ("direct", 0, 500)}
    counts = {r.kind: r["count"] for r in plans.queries()["relationships_of_entities"](spark, "/root/testdata/sf0.01").groupBy("kind").count().collect()}
    assert min(counts.values()) > 400
