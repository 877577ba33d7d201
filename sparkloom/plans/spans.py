"""Ranges: lines of a supplier as spans of days from shipping on, as many days as the quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import ranges as R

from .registry import Tables, query

DAY = "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))"
SPANS = f"s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line, min({DAY}) AS lo, max({DAY} + CAST(l_quantity AS BIGINT)) AS hi FROM lineitem GROUP BY ALL)"


def _spans(t: Tables) -> DataFrame:
    """One span for each supplier and line of an order."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")
    return t.lineitem.groupBy("l_suppkey", line).agg(F.min(day).alias("lo"), F.max(day + F.col("l_quantity").cast("long")).alias("hi"))


@query(f"WITH {SPANS} SELECT x.l_suppkey, x.line AS line, count(*) AS others FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey AND x.line <> y.line AND x.lo <= y.hi AND y.lo <= x.hi GROUP BY ALL")
def supplier_overlaps(t: Tables) -> DataFrame:
    """How many other lines of its supplier a line's span meets."""
    pairs = R.overlapping(_spans(t), "l_suppkey", "line", "lo", "hi").where("a <> b")
    both = pairs.select("l_suppkey", F.explode(F.array("a", "b")).alias("line"))
    return both.groupBy("l_suppkey", "line").agg(F.count("*").alias("others"))


@query(f"WITH {SPANS}, p AS (SELECT x.l_suppkey, x.line, y.line AS inner_, y.lo, y.hi FROM s x LEFT JOIN s y ON x.l_suppkey = y.l_suppkey AND y.lo <= x.lo AND y.hi >= x.hi AND (y.lo < x.lo OR y.hi > x.hi)) SELECT l_suppkey, line, inner_ AS \"inner\", CAST(lo AS BIGINT) AS inner_lo, CAST(hi AS BIGINT) AS inner_hi FROM p QUALIFY row_number() OVER (PARTITION BY l_suppkey, line ORDER BY hi - lo, lo, inner_) = 1")
def supplier_innermost(t: Tables) -> DataFrame:
    """The narrowest span of the same supplier that strictly encloses a line's span."""
    spans = _spans(t)
    return R.innermost(spans, spans, "l_suppkey", "line", "lo", "hi", strictly=True)


@query(f"WITH {SPANS}, d AS (SELECT l_suppkey, lo, hi, min(line) AS line FROM s GROUP BY ALL) SELECT l_suppkey, line FROM d x WHERE NOT EXISTS (SELECT 1 FROM d y WHERE x.l_suppkey = y.l_suppkey AND y.lo <= x.lo AND y.hi >= x.hi AND (y.lo < x.lo OR y.hi > x.hi))")
def supplier_outermost(t: Tables) -> DataFrame:
    """Spans that no other span of their supplier strictly encloses."""
    return R.outermost(_spans(t), "l_suppkey", "line", "lo", "hi")


CALENDAR = "SELECT DISTINCT o_orderstatus AS kind, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders"


@query(f"WITH c AS ({CALENDAR}), x AS (SELECT DISTINCT l_linestatus, l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS lo, CAST(l_quantity AS BIGINT) AS size FROM lineitem) SELECT kind, day, count(*) AS lines FROM c JOIN x ON l_linestatus = kind AND lo <= day AND day <= lo + size GROUP BY ALL")
def days_covered(t: Tables) -> DataFrame:
    """How many different spans of a line state lie around each day on which orders of that state came in: very
    many ranges of two keys."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    spans = t.lineitem.select(F.col("l_linestatus").alias("kind"), "l_suppkey", day.alias("lo"), (day + F.col("l_quantity").cast("long")).alias("hi")).distinct()
    days = t.orders.select(F.col("o_orderstatus").alias("kind"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day")).distinct()
    met = R.stabbed(days.withColumn("p", F.lit(0)), spans, "kind", "p", "day", "l_suppkey", "lo", "hi")
    return met.groupBy("kind", "day").agg(F.count("*").alias("lines"))
