"""Leases that end by timers, and tables in committed versions: customers by nation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.steps import shared_dir
from sparkloom.sources.versions import Versioned
from sparkloom.streaming import leases

from .registry import Tables, query

ENDED = """WITH p AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS passed FROM events),
e AS (SELECT DISTINCT user_id, ts, event_id, event_type FROM events, p WHERE ts < passed),
n AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER w AS epoch, lead(ts) OVER w AS next_ts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS attempts, ts + INTERVAL 120 SECONDS AS ended_at FROM n)
SELECT user_id, ended_at, attempts, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY' END AS next_status FROM a, p WHERE event_type NOT IN ('signup', 'purchase', 'error') AND CASE WHEN next_ts IS NOT NULL THEN ended_at <= next_ts ELSE ended_at < passed END"""


@query(ENDED)
def stream_ended_leases(t: Tables) -> DataFrame:
    """Leases that ended, by a stream whose timers wake silent jobs: no job is at rest for longer than a year."""
    return leases.ended_leases(t.spark, f"{t.sf_dir}/events*.parquet", shared_dir(t.spark), keep=365 * 86_400)


@query(ENDED)
def ended_leases(t: Tables) -> DataFrame:
    """The same from all events at once."""
    passed = t.events.agg(F.max("ts").alias("last")).select((F.date_trunc("MILLISECOND", "last") - F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")).first()[0]
    return leases.ended_leases_at_once(t.events, F.lit(passed).cast("timestamp_ntz"))


@query("""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1),
r AS (SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment, 2 AS version FROM customer WHERE c_nationkey IN (FROM n) AND c_acctbal > 0),
s AS (SELECT *, 1 AS version FROM customer), t AS (SELECT * REPLACE (2 AS version) FROM s WHERE c_nationkey NOT IN (FROM n) UNION ALL BY NAME SELECT * FROM r)
SELECT version, c_nationkey, count(*) AS customers, min(c_name) AS first_name, round(sum(c_acctbal), 2) AS balance FROM (FROM s UNION ALL BY NAME SELECT * FROM t) GROUP BY ALL""")
def versioned_customers(t: Tables) -> DataFrame:
    """Customers in two committed versions: the nations of one region are replaced in the second, and a reader that
    pinned the first still sees it whole."""
    table = Versioned(t.spark, f"{shared_dir(t.spark)}/versions-{uuid.uuid4().hex}")
    first = table.create(t.customer, ["c_nationkey"])
    nations = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    rows = t.customer.join(nations, "c_nationkey", "left_semi").where("c_acctbal > 0").withColumn("c_name", F.upper("c_name"))
    second = table.replace(first, nations, rows)
    both = table.read(first).withColumn("version", F.lit(1)).unionByName(table.read(table.version(second.number)).withColumn("version", F.lit(2)))
    return both.groupBy("version", "c_nationkey").agg(F.count("*").alias("customers"), F.min("c_name").alias("first_name"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH s AS (SELECT n_nationkey, count(c_custkey) FILTER (c_mktsegment <> 'BUILDING') AS kept FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_nationkey AS c_nationkey, kept FROM s WHERE kept > 0""")
def versioned_deletions(t: Tables) -> DataFrame:
    """Customers by nation after the deletion of a market segment: the scope is the segment, and the other segments'
    files stay as they are."""
    table = Versioned(t.spark, f"{shared_dir(t.spark)}/versions-{uuid.uuid4().hex}")
    first = table.create(t.customer, ["c_mktsegment"])
    second = table.delete(first, t.customer.where("c_mktsegment = 'BUILDING'").select("c_mktsegment"))
    return table.read(second).groupBy("c_nationkey").agg(F.count("*").alias("kept"))
