"""Joins of ranges within a key, without comparing all pairs of it.

Positions are whole numbers, both ends belong to a range. A range is cut into dyadic nodes, runs of 2**level
positions that start at a multiple of their length: at most two a level, and none beyond the level of the longest
range. A position lies in exactly one node of every level, so it meets a range in at most one node, and an equal join
on (key, level, node) finds exactly the ranges around a position: every row it makes is a result. A key's ranges
spread over its nodes, so a key with very many of them is no single task's work; rows of one node are joined from
written sides, which Spark can split. Rows that share an id are ranges of their own.

Nodes multiply the rows by the levels. Ranges are first looked for in blocks: ranges of one class of lengths
touch two blocks of their class at most, an item looks into its block of every class, and what a block holds is compared
whole. Only where that is too much do the rows of a block go by nodes.

Rows with a missing key, id or end, and ranges that end before they start, meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import materialise


#: Lengths of class c have CLASS * c bits at most. A block goes by nodes if its pairs are more than FEW times its rows, or
#: its rows of one side more than MANY.
CLASS, FEW, MANY = 6, 256, 100_000
BLOCK = ["_k", "_c", "_b"]


def _good(rows: DataFrame, key: str, item: str, lo: str, hi: str) -> DataFrame:
    """(key, id, lo, hi) under names of their own."""
    out = rows.select(F.col(key).alias("_k"), F.col(item).alias("_id"), F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi"))
    return out.where("_k IS NOT NULL AND _id IS NOT NULL AND _lo <= _hi")


def _levels(ranges: DataFrame) -> int:
    """The level of the longest range's longest possible node."""
    longest = ranges.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).first()[0]
    return max(int(longest or 1), 1).bit_length() - 1


def nodes(lo: Column, hi: Column, levels: int) -> Column:
    """The dyadic nodes that make up lo ... hi, as (level, node)."""
    empty = F.array().cast("array<struct<l:int,n:bigint>>")
    one = lambda level, n: F.array(F.struct(level.cast("int").alias("l"), n.cast("bigint").alias("n")))

    def step(state: Column, level: Column) -> Column:
        a, b, found = state["a"], state["b"], state["found"]
        last = level == levels  # the top level takes what is left, two nodes at most
        left = (a <= b) & ((F.pmod(a, F.lit(2)) == 1) | last)
        found = F.when(left, F.concat(found, one(level, a))).otherwise(found)
        a = F.when(left, a + 1).otherwise(a)
        right = (a <= b) & ((F.pmod(b, F.lit(2)) == 0) | last)
        found = F.when(right, F.concat(found, one(level, b))).otherwise(found)
        b = F.when(right, b - 1).otherwise(b)
        done = a > b
        return F.struct(F.when(done, F.lit(1)).otherwise(F.shiftright(a, 1)).cast("bigint").alias("a"), F.when(done, F.lit(0)).otherwise(F.shiftright(b, 1)).cast("bigint").alias("b"), found.alias("found"))

    start = F.struct(lo.cast("bigint").alias("a"), hi.cast("bigint").alias("b"), empty.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["found"])


def _in_nodes(ranges: DataFrame, levels: int) -> DataFrame:
    return ranges.select("*", F.explode(nodes(F.col("_lo"), F.col("_hi"), levels)).alias("x")).select("*", F.col("x.l").alias("_l"), F.col("x.n").alias("_n")).drop("x")


def _around(points: DataFrame, at: Column, levels: int) -> DataFrame:
    """points with the node of every level that holds the position `at`."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.cast("int").alias("l"), F.call_function("shiftright", at, level).alias("n")))
    return points.select("*", F.explode(steps).alias("x")).select("*", F.col("x.l").alias("_l"), F.col("x.n").alias("_n")).drop("x")


def _bits(c: Column) -> Column:
    return F.least(c * CLASS, F.lit(62)).cast("int")


def _in_blocks(ranges: DataFrame) -> DataFrame:
    """ranges with their class of lengths, once for each block of it that they touch."""
    longer = [F.when(F.col("_hi") - F.col("_lo") >= 1 << CLASS * i, 1).otherwise(0) for i in range(1, 63 // CLASS + 1)]
    block = lambda c: F.call_function("shiftright", F.col(c), _bits(F.col("_c")))
    return ranges.withColumn("_c", sum(longer, F.lit(1))).select("*", F.explode(F.sequence(block("_lo"), block("_hi"))).alias("_b"))


def _at_blocks(points: DataFrame, classes: list[int]) -> DataFrame:
    """points in their block of each class that has ranges as long as they are."""
    out = points.select("*", F.explode(F.array(*map(F.lit, classes)) if classes else F.array().cast("array<int>")).alias("_c"))
    fits = F.shiftright(F.col("_hi") - F.col("_lo"), 1) < F.call_function("shiftleft", F.lit(1).cast("long"), _bits(F.col("_c")) - 1)
    return out.where(fits).withColumn("_b", F.call_function("shiftright", F.col("_lo"), _bits(F.col("_c"))))


def _full(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """The blocks of _in_blocks() and _at_blocks() whose rows go by nodes; written."""
    count = lambda rows, r, p: rows.select(*BLOCK, F.lit(r).cast("long").alias("r"), F.lit(p).cast("long").alias("p"))
    counts = count(ranges, 1, 0).union(count(points, 0, 1)).groupBy(*BLOCK).agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    return materialise(counts.where(f"r > 0 AND p > 0 AND (CAST(r AS DOUBLE) * p > {FEW} * (r + p) OR r > {MANY} OR p > {MANY})").select(*BLOCK), "full")


def _classes(ranges: DataFrame) -> list[int]:
    return sorted(r[0] for r in ranges.select("_c").distinct().collect())  # eleven at most


def stabbed(points: DataFrame, ranges: DataFrame, key: str, point: str, at: str, item: str, lo: str, hi: str) -> DataFrame:
    """(key, point, at, item, lo, hi) of every position (key, point, at) and each range (key, item, lo, hi) of its
    key that holds it."""
    good = materialise(_good(ranges, key, item, lo, hi), "ranges")
    asked = points.select(F.col(key).alias("_k"), F.col(point).alias("_p"), F.col(at).cast("long").alias("_lo")).where("_k IS NOT NULL AND _lo IS NOT NULL")
    asked = materialise(asked, "points").withColumn("_hi", F.col("_lo"))
    near = _in_blocks(good)
    asked = _at_blocks(asked, _classes(near)).drop("_hi").withColumnRenamed("_lo", "_at")
    full = _full(near, asked)
    some = not full.isEmpty()
    named = lambda rows: rows.withColumnsRenamed({c: f"_p{c}" for c in ("_k", "_c", "_b", "_l", "_n")})
    meet = lambda p, r, by, *more: named(p).join(r, [F.col(f"_p{c}") == F.col(c) for c in by] + list(more)).select("_k", "_p", "_at", "_id", "_lo", "_hi")
    within = lambda rows, how: rows.join(full, BLOCK, how) if some else rows
    met = meet(within(asked, "left_anti"), within(near, "left_anti"), BLOCK, F.col("_lo") <= F.col("_at"), F.col("_at") <= F.col("_hi"))
    if some:  # nodes of each block apart: a point stands in one block of a class
        levels = _levels(good)
        held = materialise(_in_nodes(within(near, "left_semi"), levels), "ranges")
        around = materialise(_around(within(asked, "left_semi"), F.col("_at"), levels), "points")
        met = met.union(meet(around, held, [*BLOCK, "_l", "_n"]))
    return met.select(F.col("_k").alias(key), F.col("_p").alias(point), F.col("_at").alias(at), F.col("_id").alias(item), F.col("_lo").alias(lo), F.col("_hi").alias(hi))


def overlapping(rows: DataFrame, key: str, item: str, lo: str, hi: str) -> DataFrame:
    """(key, a, b), a <= b: all pairs of ranges of one key that share a position. Of such a pair the one that starts
    later (ties: the larger id) starts inside the other, and is found there."""
    good = materialise(_good(rows, key, item, lo, hi), "ranges")
    starts = good.select(F.col("_k").alias("k"), F.struct("_id", F.col("_lo").alias("s")).alias("p"), F.col("_lo").alias("at"))
    met = stabbed(starts, good.withColumnRenamed("_k", "k"), "k", "p", "at", "_id", "_lo", "_hi")
    later = (F.col("_lo") < F.col("p.s")) | ((F.col("_lo") == F.col("p.s")) & (F.col("_id") < F.col("p._id")))
    return met.where(later).select(F.col("k").alias(key), F.least("_id", "p._id").alias("a"), F.greatest("_id", "p._id").alias("b"))


def _enclosing(points: DataFrame, ranges: DataFrame, at: Column, levels: int, beyond: bool) -> DataFrame:
    """(_k, _lo, _hi, best) of every different (key, lo, hi) of points: the narrowest range that holds `at` and ends
    at hi or later, or beyond it. In a node, ranges are passed from the last end on; each end stands there once, with
    its narrowest range, so a node's rows follow its different ends and not the number of its ranges."""
    held = _in_nodes(ranges, levels).groupBy("_k", "_l", "_n", "_hi").agg(F.min(F.struct((F.col("_hi") - F.col("_lo")).alias("w"), "_lo", "_id", F.col("_hi").alias("h"))).alias("own"))
    asked = _around(points.select("_k", "_lo", "_hi"), at, levels)
    both = held.select("_k", "_l", "_n", F.col("_hi").alias("_end"), "own", F.lit(None).cast("bigint").alias("_lo"), F.lit(None).cast("bigint").alias("_hi"))
    both = both.unionByName(asked.select("_k", "_l", "_n", F.col("_hi").alias("_end"), F.lit(None).cast(held.schema["own"].dataType).alias("own"), "_lo", "_hi"))
    passed = Window.partitionBy("_k", "_l", "_n").orderBy(-F.col("_end")).rangeBetween(Window.unboundedPreceding, -1 if beyond else Window.currentRow)
    found = both.withColumn("best", F.min("own").over(passed)).where("_lo IS NOT NULL AND best IS NOT NULL")
    return found.groupBy("_k", "_lo", "_hi").agg(F.min("best").alias("best"))


def _innermost_of(points: DataFrame, held: DataFrame, levels: int, strictly: bool) -> DataFrame:
    """(_k, _lo, _hi, best) of different points by the nodes of ranges."""
    held = held.groupBy("_k", "_lo", "_hi").agg(F.min("_id").alias("_id"))
    points = points.select("_k", "_lo", "_hi").distinct()
    if not strictly:
        return _enclosing(points, held, F.col("_lo"), levels, False)
    # it ends later, or starts earlier
    found = _enclosing(points, held, F.col("_lo"), levels, True).union(_enclosing(points, held, F.col("_lo") - 1, levels, False))
    return found.groupBy("_k", "_lo", "_hi").agg(F.min("best").alias("best"))


def innermost(items: DataFrame, ranges: DataFrame, key: str, item: str, lo: str, hi: str, strictly: bool = False) -> DataFrame:
    """(key, item, inner, inner_lo, inner_hi): for every item the narrowest range of its key that encloses it, ties
    going to the earlier start and the smaller id; null where none does. With strictly, a range with the same ends
    does not count. Items and ranges have the same column names."""
    good = materialise(_good(items, key, item, lo, hi), "items")
    held = good if ranges is items else materialise(_good(ranges, key, item, lo, hi), "ranges")
    at, near = BLOCK, _in_blocks(held)
    points = _at_blocks(good, _classes(near))
    full = _full(near, points)
    some = not full.isEmpty()
    some_points, some_near = (points.join(full, at, "left_anti"), near.join(full, at, "left_anti")) if some else (points, near)
    cold = some_points.select(F.col("_k").alias("k"), F.col("_c").alias("c"), F.col("_b").alias("b"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    around = (F.col("_lo") <= F.col("lo")) & (F.col("_hi") >= F.col("hi"))
    if strictly:
        around &= (F.col("_lo") < F.col("lo")) | (F.col("_hi") > F.col("hi"))
    met = cold.join(some_near, (F.col("k") == F.col("_k")) & (F.col("c") == F.col("_c")) & (F.col("b") == F.col("_b")) & around)
    # Both sides are dealt by block, and so they stay while a block's points find the best of it.
    found = met.groupBy("k", "c", "b", "lo", "hi").agg(F.min(F.struct((F.col("_hi") - F.col("_lo")).alias("w"), "_lo", "_id", F.col("_hi").alias("h"))).alias("best"))
    found = found.select(F.col("k").alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "best")
    if some:
        # A range that holds a point touches the point's block of the range's class: those that touch full blocks are enough.
        near = materialise(near.join(full, at, "left_semi").select("_k", "_lo", "_hi", "_id").distinct(), "near")
        found = found.union(_innermost_of(points.join(full, at, "left_semi"), near, _levels(near), strictly))
    found = found.groupBy("_k", "_lo", "_hi").agg(F.min("best").alias("best"))
    out = good.join(found, ["_k", "_lo", "_hi"], "left")
    return out.select(F.col("_k").alias(key), F.col("_id").alias(item), F.col("best._id").alias("inner"), F.col("best._lo").alias("inner_lo"), F.col("best.h").alias("inner_hi"))


def outermost(rows: DataFrame, key: str, item: str, lo: str, hi: str) -> DataFrame:
    """(key, item) of the ranges that no other range of their key strictly encloses; of ranges with the same ends the
    smallest id."""
    one = _good(rows, key, item, lo, hi).groupBy("_k", "_lo", "_hi").agg(F.min("_id").alias("_id"))
    one = materialise(one, "ranges").select(F.col("_k").alias(key), F.col("_id").alias(item), F.col("_lo").alias(lo), F.col("_hi").alias(hi))
    return innermost(one, one, key, item, lo, hi, strictly=True).where("inner IS NULL").select(key, item)
