"""Ledger queries: events as the log of jobs, one job per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import classify as C
from sparkloom.operators import ledger as L
from sparkloom.operators.steps import shared_dir
from sparkloom.streaming import jobs

from .registry import Tables, query

JOBS = """s AS (SELECT user_id, count(*) AS epoch, max({'ts': ts, 'event_id': event_id}) AS start FROM events WHERE event_type = 'signup' GROUP BY user_id),
g AS (SELECT user_id, epoch, count(*) FILTER (event_type = 'click') AS attempts, arg_max(event_type, {'ts': ts, 'event_id': event_id}) AS last_type, max(ts) AS last_at, max(ts) FILTER (event_type IN ('click', 'view')) AS beat FROM events JOIN s USING (user_id) WHERE {'ts': ts, 'event_id': event_id} >= start GROUP BY ALL),
j AS (SELECT *, CASE WHEN status = 'RUNNING' THEN beat + INTERVAL 120 SECOND END AS lease_until FROM (SELECT *, CASE last_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN (CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY' END) ELSE 'RUNNING' END AS status FROM g))"""


def _with_end(t: Tables, rows: DataFrame) -> DataFrame:
    """rows with `as_of`, the last time in the log: one row is broadcast."""
    return rows.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("as_of"))))


@query(f"WITH {JOBS} SELECT user_id, epoch, attempts, last_type, last_at, status, lease_until FROM j")
def job_latest_state(t: Tables) -> DataFrame:
    return L.job_states(t.events)


@query(f"WITH {JOBS} SELECT user_id, status, attempts FROM j WHERE status IN ('PENDING', 'RETRY') AND last_at + to_seconds(least(300, CAST(pow(2, least(attempts, 9)) AS INTEGER))) <= (SELECT max(ts) FROM events) ORDER BY last_at, user_id LIMIT 100")
def job_due(t: Tables) -> DataFrame:
    return L.due(_with_end(t, L.job_states(t.events)), F.col("as_of"), 100).select("user_id", "status", "attempts")


@query(f"WITH {JOBS} SELECT user_id, attempts, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY' END AS next_status FROM j WHERE status = 'RUNNING' AND lease_until <= (SELECT max(ts) FROM events)")
def lease_expiry(t: Tables) -> DataFrame:
    return L.expired(_with_end(t, L.job_states(t.events)), F.col("as_of")).select("user_id", "attempts", "next_status")


@query(f"WITH {JOBS} SELECT user_id, least(300.0, pow(2.0, attempts)) AS evaluation, least(300.0, 10 * pow(2.0, attempts)) AS ingestion, least(3600.0, pow(2.0, least(attempts, 11))) AS publication, least(300.0, pow(2.0, least(attempts, 8))) AS sync FROM j")
def backoff(t: Tables) -> DataFrame:
    wait = lambda base, most, cap: C.backoff(F.col("attempts").cast("int"), base, most, cap)
    return L.job_states(t.events).select("user_id", wait(1, 300, 1000).alias("evaluation"), wait(10, 300, 1000).alias("ingestion"), wait(1, 3600, 11).alias("publication"), wait(1, 300, 8).alias("sync"))


@query("""WITH e AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, ts, event_id FROM events)
SELECT user_id, k, count(*) AS n, arg_min(event_type, {'ts': ts, 'event_id': event_id}) AS identity, min(event_type) <> max(event_type) AS conflict FROM e GROUP BY user_id, k""")
def delivery_dedupe(t: Tables) -> DataFrame:
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return L.deliveries(rows, ["user_id", "k"], "event_type")


@query("""WITH e AS (SELECT user_id, date_trunc('hour', ts) AS updated, event_type FROM events), a AS (SELECT user_id, updated, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) ELSE 'UNKNOWN' END AS state FROM e GROUP BY ALL)
SELECT user_id, max(updated) AS updated, arg_max(state, updated) AS state FROM a GROUP BY user_id""")
def two_clock_latest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("updated"), "event_type")
    return L.two_clocks(rows, "user_id", "updated", "event_type")


@query(f"WITH {JOBS}, n AS (SELECT count(*) AS active FROM j WHERE status = 'RUNNING' AND lease_until >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR), w AS (SELECT user_id, row_number() OVER (ORDER BY last_at, user_id) AS place FROM j WHERE status IN ('PENDING', 'RETRY')) SELECT user_id, CAST(place AS INTEGER) AS place FROM w, n WHERE place <= greatest(0, 20 - active)")
def admission_cap(t: Tables) -> DataFrame:
    """At most 20 jobs run at once: those that hold a lease of the last hour count first."""
    jobs = _with_end(t, L.job_states(t.events))
    active = jobs.where("status = 'RUNNING' AND lease_until >= as_of - INTERVAL 1 HOUR").agg(F.count("*").alias("active"))
    waiting = jobs.where("status IN ('PENDING', 'RETRY')").crossJoin(F.broadcast(active))  # one row
    return L.admitted(waiting, F.col("active"), 20, [F.asc("last_at"), F.asc("user_id")]).select("user_id", "place")


@query("""WITH e AS (SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events)
SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN c ELSE 0 END) AS BIGINT) AS actual, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN c ELSE 0 END) AS BIGINT) AS reserved, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE c END) AS BIGINT) AS charged FROM e GROUP BY user_id""")
def budget_ledger(t: Tables) -> DataFrame:
    return L.charged(t.events, "user_id", F.round(F.col("value") * 100).cast("long"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(DISTINCT json_extract_string(props, '$.k')) AS k_kinds FROM events GROUP BY event_type""")
def json_props(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("k_sum"), F.countDistinct(k).alias("k_kinds"))


@query("""WITH i AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, max(ts) AS issued FROM events WHERE event_type = 'signup' GROUP BY ALL), u AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, max(ts) AS used FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, k, issued FROM i LEFT JOIN u USING (user_id, k) WHERE (used IS NULL OR used < issued) AND issued + INTERVAL 10 DAY > (SELECT max(ts) FROM events)""")
def single_use_tokens(t: Tables) -> DataFrame:
    """Tokens still to be used: the newest issue of each, alive for ten days, unless used since."""
    rows = t.events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", "event_type")
    newest = lambda kind, name: rows.where(F.col("event_type") == kind).groupBy("user_id", "k").agg(F.max("ts").alias(name))
    open_ = newest(L.ENQUEUE, "issued").join(newest(L.FINISH, "used"), ["user_id", "k"], "left").where("used IS NULL OR used < issued")
    return _with_end(t, open_).where("issued + INTERVAL 10 DAYS > as_of").select("user_id", "k", "issued")


@query("""WITH e AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS repo, event_id FROM events), f AS (SELECT user_id, repo, min(event_id) AS seen, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, arg_min(repo, seen) AS bound, CAST(sum(n) - arg_min(n, seen) AS BIGINT) AS conflicts FROM f GROUP BY user_id""")
def binding_conflicts(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", (F.get_json_object("props", "$.k").cast("long") % 5).alias("repo"), "event_id")
    return L.first_bindings(rows, "user_id", "repo", "event_id")


@query("""WITH n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, CASE WHEN o_custkey IS NULL THEN 'REVOKED' WHEN c_custkey IS NULL THEN 'ADDED' ELSE 'GRANTED' END AS state FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN n ON c_custkey = o_custkey""")
def grants_sync(t: Tables) -> DataFrame:
    new = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return L.grants_sync(t.customer.where("c_acctbal > 0"), new, "c_custkey")


@query("""WITH p AS (SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 30) THEN 'VIOLATES' WHEN bool_or(event_type = 'error') THEN 'SATISFIES' ELSE 'UNKNOWN' END AS before, CASE WHEN bool_or(event_type = 'purchase' AND value > 20) THEN 'VIOLATES' WHEN bool_or(event_type = 'purchase') THEN 'SATISFIES' ELSE 'UNKNOWN' END AS head, CASE WHEN bool_or(event_type = 'view' AND value > 60) THEN 'VIOLATES' WHEN bool_or(event_type = 'view' AND value > 40) THEN 'SATISFIES' WHEN bool_or(event_type = 'view') THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END AS target, count(*) > 3 AS changed, ['INTRODUCED','WORSENED','PRE_EXISTING','RESOLVED','UNCHANGED'][user_id % 5 + 1] AS claimed FROM events GROUP BY user_id)
SELECT user_id, claimed, CASE WHEN target <> 'UNKNOWN' AND changed AND CASE claimed WHEN 'INTRODUCED' THEN before IN ('SATISFIES', 'NOT_APPLICABLE') AND head = 'VIOLATES' AND target IN ('SATISFIES', 'NOT_APPLICABLE') WHEN 'WORSENED' THEN before = 'VIOLATES' AND head = 'VIOLATES' WHEN 'PRE_EXISTING' THEN before = 'VIOLATES' AND head = 'VIOLATES' WHEN 'RESOLVED' THEN before = 'VIOLATES' AND head = 'SATISFIES' ELSE before = head AND head <> 'UNKNOWN' END THEN claimed ELSE 'UNKNOWN' END AS change FROM p""")
def transition_truth_table(t: Tables) -> DataFrame:
    """Which claimed attributions the behaviours at three revisions bear out; users are findings here."""
    any_ = lambda kind, least: F.bool_or((F.col("event_type") == kind) & (F.col("value") > least))
    side = lambda kind, high: F.when(any_(kind, high), "VIOLATES").when(any_(kind, -1), "SATISFIES").otherwise("UNKNOWN")
    target = F.when(any_("view", 60), "VIOLATES").when(any_("view", 40), "SATISFIES").when(any_("view", -1), "NOT_APPLICABLE").otherwise("UNKNOWN")
    claims = F.array(*map(F.lit, ("INTRODUCED", "WORSENED", "PRE_EXISTING", "RESOLVED", "UNCHANGED")))
    sides = t.events.groupBy("user_id").agg(side("error", 30).alias("before"), side("purchase", 20).alias("head"), target.alias("target"), (F.count("*") > 3).alias("changed"))
    sides = sides.withColumn("claimed", F.element_at(claims, (F.col("user_id") % 5 + 1).cast("int")))
    c = F.col
    return sides.select("user_id", "claimed", C.verified_attribution(c("before"), c("head"), c("target"), c("claimed"), c("changed")).alias("change"))


@query("""SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, arg_max(role, turn) AS last_role, arg_min(role, turn) AS first_role, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id""")
def conversation_state(t: Tables) -> DataFrame:
    size = F.coalesce(F.length("text"), F.lit(0))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.min_by("role", "turn").alias("first_role"), F.sum(size).alias("chars"), F.count_if(F.col("role") == "user").alias("asked"))


@query()
def stream_job_state(t: Tables) -> DataFrame:
    """Epoch, attempts and last event of every job, folded by a stream; tests hold it against the batch."""
    return jobs.job_state(t.spark, f"{t.sf_dir}/events*.parquet", shared_dir(t.spark)).drop("version", "seen")
