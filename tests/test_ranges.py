import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from sparkloom.operators import ranges

SCHEMA = "k string, id long, lo long, hi long"


def made(rng, n, top, long):
    out = []
    for i in range(n):
        lo = rng.randrange(-top, top)
        out.append((rng.choice("aab"), i, lo, lo + rng.randrange(0, long)))
    out += [(k, 1000 + i, lo, hi) for i, (k, _, lo, hi) in enumerate(out[:5])]  # the same ends
    return out


ODD = [(None, 1, 0, 5), ("a", None, 0, 5), ("a", 2000, None, 5), ("a", 2001, 5, None), ("a", 2002, 5, 4)]


def good(rows):
    return [r for r in rows if None not in r and r[2] <= r[3]]


@pytest.mark.parametrize(("n", "top", "long"), [(60, 20, 8), (80, 1000, 900), (40, 5, 60)])
def test_overlaps_and_enclosures(spark, n, top, long):
    rng = random.Random(n)
    rows = made(rng, n, top, long) + ODD
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = good(rows)
    want = {(x[0], min(x[1], y[1]), max(x[1], y[1])) for x in kept for y in kept if x[0] == y[0] and x[1] != y[1] and x[2] <= y[3] and y[2] <= x[3]}
    found = [tuple(r) for r in ranges.overlapping(df, "k", "id", "lo", "hi").collect()]
    assert len(found) == len(set(found)) and set(found) == want

    for strictly in (False, True):
        def best(x, strictly=strictly):
            around = [y for y in kept if y[0] == x[0] and y[2] <= x[2] and y[3] >= x[3] and not (strictly and y[2:] == x[2:])]
            return min(((y[3] - y[2], y[2], y[1], y[3]) for y in around), default=None)

        want = {(x[0], x[1], *((b[2], b[1], b[3]) if (b := best(x)) else (None,) * 3)) for x in kept}
        assert {tuple(r) for r in ranges.innermost(df, df, "k", "id", "lo", "hi", strictly).collect()} == want
    want = {(x[0], x[1]) for x in kept if not any(y[0] == x[0] and y[2] <= x[2] and y[3] >= x[3] and (y[2:] != x[2:] or y[1] < x[1]) for y in kept)}
    assert {tuple(r) for r in ranges.outermost(df, "k", "id", "lo", "hi").collect()} == want


def test_positions_in_ranges(spark):
    rows = made(random.Random(1), 50, 100, 70)
    points = [("a", i, random.Random(i).randrange(-120, 200)) for i in range(60)] + [("z", 1, 1), (None, 2, 1), ("a", 99, None)]
    found = ranges.stabbed(spark.createDataFrame(points, "k string, p long, at long"), spark.createDataFrame(rows, SCHEMA), "k", "p", "at", "id", "lo", "hi")
    want = sorted((k, p, at, i, lo, hi) for k, p, at in points if at is not None for key, i, lo, hi in rows if key == k and lo <= at <= hi)
    assert sorted(map(tuple, found.collect())) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ranges.overlapping(none, "k", "id", "lo", "hi").collect() == []
    assert ranges.outermost(none, "k", "id", "lo", "hi").collect() == []
    one = spark.createDataFrame([("a", 1, 3, 3)], SCHEMA)
    assert [tuple(r) for r in ranges.innermost(one, none, "k", "id", "lo", "hi").collect()] == [("a", 1, None, None, None)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(2**40), 2**40), st.integers(0, 2**41)), min_size=1, max_size=12))
def test_nodes_cover_a_range_once(spark, found):
    levels = max(n + 1 for _, n in found).bit_length() - 1
    df = spark.createDataFrame([(lo, lo + n) for lo, n in found], "lo long, hi long")
    for r in df.select("lo", "hi", ranges.nodes(df.lo, df.hi, levels).alias("x")).collect():
        parts = sorted((x.n << x.l, (x.n + 1 << x.l) - 1) for x in r.x)
        assert parts[0][0] == r.lo and parts[-1][1] == r.hi
        assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * (levels + 1)


def test_a_key_with_very_many_ranges_is_split(spark):
    """A hundred thousand ranges of one key, nested and apart: the work spreads over the nodes of the key."""
    n = 100_000
    df = spark.range(n).selectExpr("'a' AS k", "id", "id * 4 AS lo", "id * 4 + CASE WHEN id % 1000 = 0 THEN 3999 ELSE 1 END AS hi")
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        inner = ranges.innermost(df, df, "k", "id", "lo", "hi", strictly=True)
        got = inner.where("id % 1000 = 7").selectExpr("count(*) AS n", "sum(CASE WHEN inner = id - 7 THEN 1 ELSE 0 END) AS ok").first()
        assert (got.n, got.ok) == (100, 100)
        assert ranges.outermost(df, "k", "id", "lo", "hi").count() == 100
        held = ranges._in_nodes(ranges._good(df, "k", "id", "lo", "hi"), ranges._levels(ranges._good(df, "k", "id", "lo", "hi")))
        per = held.groupBy("_k", "_l", "_n").count().agg({"count": "max"}).first()[0]
        assert per <= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)


@pytest.mark.parametrize(("few", "many"), [(0, 100_000), (2, 100_000), (256, 30), (256, 100_000)])
def test_full_blocks_go_by_nodes(spark, monkeypatch, few, many):
    monkeypatch.setattr(ranges, "FEW", few)
    monkeypatch.setattr(ranges, "MANY", many)
    rng = random.Random(few)
    rows = made(rng, 90, 300, 60) + made(rng, 6, 5000, 9000)
    df = spark.createDataFrame(rows, SCHEMA)
    for strictly in (False, True):
        best = lambda x, s=strictly: min(((y[3] - y[2], y[2], y[1], y[3]) for y in rows if y[0] == x[0] and y[2] <= x[2] and y[3] >= x[3] and not (s and y[2:] == x[2:])), default=(None,) * 4)
        want = sorted(((x[0], x[1], (b := best(x))[2], b[1], b[3]) for x in rows), key=str)
        assert sorted(map(tuple, ranges.innermost(df, df, "k", "id", "lo", "hi", strictly).collect()), key=str) == want


def shuffled(spark):
    """Records written to shuffles by all stages so far."""
    context = spark.sparkContext
    jvm = context._gateway.jvm
    stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_enclosing_ranges_move_few_rows(spark):
    n = 20_000
    df = spark.range(n).selectExpr("CAST(id % 400 AS STRING) AS k", "id", "id * 7 % 2500 AS lo", "id * 7 % 2500 + id % 50 + IF(id = 5, 2000, 0) AS hi").localCheckpoint()
    before = shuffled(spark)
    assert ranges.innermost(df, df, "k", "id", "lo", "hi", strictly=True).count() == n
    moved = shuffled(spark) - before
    assert moved < 12 * n


@pytest.mark.parametrize(("few", "many"), [(0, 100_000), (2, 100_000), (256, 30)])
def test_full_blocks_of_positions_go_by_nodes(spark, monkeypatch, few, many):
    monkeypatch.setattr(ranges, "FEW", few)
    monkeypatch.setattr(ranges, "MANY", many)
    rng = random.Random(7)
    rows = made(rng, 90, 300, 60) + made(rng, 6, 5000, 9000)[:6]
    points = [("a", i, rng.randrange(-320, 400)) for i in range(80)]
    found = ranges.stabbed(spark.createDataFrame(points, "k string, p long, at long"), spark.createDataFrame(rows, SCHEMA), "k", "p", "at", "id", "lo", "hi")
    assert sorted(map(tuple, found.collect())) == sorted((k, p, at, i, lo, hi) for k, p, at in points for key, i, lo, hi in rows if key == k and lo <= at <= hi)


def test_overlaps_write_few_rows(spark):
    n = 20_000
    df = spark.range(n).selectExpr("CAST(id % 400 AS STRING) AS k", "id", "id * 7 % 2500 AS lo", "id * 7 % 2500 + id % 50 + IF(id = 5, 2000, 0) AS hi").localCheckpoint()
    context = spark.sparkContext
    jvm = context._gateway.jvm

    def written():
        stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).outputRecords() for i in range(stages.size()))

    before = written()
    assert ranges.overlapping(df, "k", "id", "lo", "hi").where("a = b").count() == 0
    assert written() - before < 4 * n
