"""Job ledgers: an event log folded into states, leases, admissions, budgets and bindings.

Folds are written as combinable aggregates (min, max, max_by, conditional sums), so a job that holds a
large share of all events is summed up before it is shuffled. What depends on the time takes `as_of`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_SECONDS, MOST_ATTEMPTS = 120, 3
#: What an event of the driver's log does to its job.
ENQUEUE, CLAIM, BEAT, FINISH, FAIL = "signup", "click", "view", "purchase", "error"


def latest(rows: DataFrame, key: str, *clock: str) -> DataFrame:
    """The row of each key that is last by the clocks, without a window over the key's rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*clock)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def job_states(events: DataFrame) -> DataFrame:
    """(user_id, epoch, attempts, last_type, last_at, status, lease_until) of every job that was enqueued:
    the last enqueueing starts it afresh, older revisions are superseded."""
    at = F.struct("ts", "event_id")
    start = events.where(F.col("event_type") == ENQUEUE).groupBy("user_id").agg(F.count("*").alias("epoch"), F.max(at).alias("start"))
    rows = events.join(start, "user_id").where(at >= F.col("start"))
    out = rows.groupBy("user_id", "epoch").agg(
        F.count_if(F.col("event_type") == CLAIM).alias("attempts"),
        F.max_by("event_type", at).alias("last_type"),
        F.max("ts").alias("last_at"),
        F.max(F.when(F.col("event_type").isin(CLAIM, BEAT), F.col("ts"))).alias("beat"),
    )
    last = F.col("last_type")
    status = F.when(last == ENQUEUE, "PENDING").when(last == FINISH, "COMPLETED").when(last == FAIL, F.when(F.col("attempts") >= MOST_ATTEMPTS, "FAILED").otherwise("RETRY")).otherwise("RUNNING")
    lease = F.when(status == "RUNNING", F.col("beat") + F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS"))
    return out.select("user_id", "epoch", "attempts", "last_type", "last_at", status.alias("status"), lease.alias("lease_until"))


def due(jobs: DataFrame, as_of: Column, most: int) -> DataFrame:
    """Jobs that wait and whose back-off min(300, 2 ** attempts) has passed, oldest first, at most `most`."""
    wait = F.least(F.lit(300), F.pow(F.lit(2), F.least("attempts", F.lit(9))).cast("int"))
    ready = F.col("last_at") + F.make_dt_interval(secs=wait)
    return jobs.where(F.col("status").isin("PENDING", "RETRY") & (ready <= as_of)).orderBy("last_at", "user_id").limit(most)


def expired(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Running jobs whose lease ends at `as_of` or before: they fail after the last attempt and are tried again before."""
    over = jobs.where((F.col("status") == "RUNNING") & (F.col("lease_until") <= as_of))
    return over.withColumn("next_status", F.when(F.col("attempts") >= MOST_ATTEMPTS, "FAILED").otherwise("RETRY"))


def deliveries(events: DataFrame, key: list[str], identity: str) -> DataFrame:
    """One row per delivery key: how often it came, its first identity, whether another one came too."""
    return events.groupBy(*key).agg(F.count("*").alias("n"), F.min_by(identity, F.struct("ts", "event_id")).alias("identity"), (F.min(identity) != F.max(identity)).alias("conflict"))


def two_clocks(events: DataFrame, key: str, updated: str, state: str) -> DataFrame:
    """The state of each key at its last update; different states of one time are UNKNOWN."""
    at = events.groupBy(key, updated).agg(F.min(state).alias("low"), F.max(state).alias("high"))
    merged = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("UNKNOWN")
    return at.groupBy(key).agg(F.max(updated).alias(updated), F.max_by(merged, updated).alias("state"))


def admitted(waiting: DataFrame, active: int | Column, limit: int, order: list) -> DataFrame:
    """The first `limit - active` of the waiting rows, numbered; only `limit` rows are numbered at all."""
    head = waiting.orderBy(*order).limit(limit)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= F.greatest(F.lit(0), F.lit(limit) - active))


def charged(events: DataFrame, key: str, cents: Column) -> DataFrame:
    """Budget by key: actual costs of finished calls, reserves of open ones, nothing for failed ones."""
    kind = F.col("event_type")
    return events.groupBy(key).agg(
        F.sum(F.when(kind == FINISH, cents).otherwise(0)).alias("actual"),
        F.sum(F.when(kind.isin(CLAIM, BEAT), cents).otherwise(0)).alias("reserved"),
        F.sum(F.when(kind == FAIL, 0).otherwise(cents)).alias("charged"),
    )


def first_bindings(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """First writer wins: the value each key is bound to, and how many rows wanted another one."""
    first = rows.groupBy(key, value).agg(F.min(seq).alias("at"), F.count("*").alias("n"))
    return first.groupBy(key).agg(F.min_by(value, "at").alias("bound"), (F.sum("n") - F.min_by("n", "at")).alias("conflicts"))


def grants_sync(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every key of either snapshot with GRANTED, REVOKED or ADDED."""
    both = old.select(key, F.lit(1).alias("o")).join(new.select(key, F.lit(1).alias("n")).distinct(), key, "full")
    return both.select(key, F.when(F.col("n").isNull(), "REVOKED").when(F.col("o").isNull(), "ADDED").otherwise("GRANTED").alias("state"))


def lock_holders(asked: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, event_id, got): requests for a lock in order of (ts, event_id); one gets it if it is free, and then
    holds it for `seconds`. Requests of a key are read in order, with only the end of the lock held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, until = None, None
        for part in parts:
            got = []
            for k, ts in zip(part[key], part["ts"], strict=True):
                if k != at:
                    at, until = k, None
                got.append(until is None or ts >= until)
                if got[-1]:
                    until = ts + pd.Timedelta(seconds=seconds)
            yield pd.DataFrame({key: part[key], "event_id": part["event_id"], "got": got})

    return asked.select(key, "ts", "event_id").repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(run, f"{key} long, event_id long, got boolean")


def fenced(runs: DataFrame, key: str, token: str, order: list[str]) -> DataFrame:
    """(key, armed, refused, fence): a run arms the fence of its key if its token is above every one before."""
    before = F.max(token).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("_ok", F.col(token) > F.coalesce(before, F.lit(0)))
    return rows.groupBy(key).agg(F.count_if("_ok").alias("armed"), F.count_if(~F.col("_ok")).alias("refused"), F.max(token).alias("fence"))


def machine(events: DataFrame, key: str, order: list[str], columns: list[str], step: Callable[[dict, dict], bool], start: dict, out: str) -> DataFrame:
    """(key, accepted, refused, the fields of `start`): each key's events run through a state machine in order.
    step changes the state it is given and tells whether the event counted. Events are read in order, and only
    the state of one key is held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, n = None, {}, [0, 0]

        def done() -> tuple:
            return (at, n[1], n[0], *(state[f] for f in start))

        for part in parts:
            rows = []
            for k, *values in zip(part[key], *(part[c] for c in columns), strict=True):
                if k != at:
                    if at is not None:
                        rows.append(done())
                    at, state, n = k, dict(start), [0, 0]
                n[step(state, dict(zip(columns, values, strict=True)))] += 1
            if rows:
                yield pd.DataFrame(rows, columns=[key, "accepted", "refused", *start])
        if at is not None:
            yield pd.DataFrame([done()], columns=[key, "accepted", "refused", *start])

    wanted = events.where(F.col(key).isNotNull()).select(key, *dict.fromkeys([*order, *columns]))
    return wanted.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{key} long, accepted long, refused long, {out}")


def revision_step(state: dict, event: dict) -> bool:
    """A revision is claimed when it is new, failed or superseded; only a running one is finished."""
    kind, status = event["event_type"], state["status"]
    if kind == ENQUEUE:
        if status not in ("NEW", "FAILED", "SUPERSEDED"):
            return False
        state.update(status="RUNNING", attempts=state["attempts"] + 1)
    elif kind in (FINISH, FAIL):
        if status != "RUNNING":
            return False
        state["status"] = "COMPLETED" if kind == FINISH else "FAILED"
    else:
        return False
    return True


def ingestion_step(state: dict, event: dict, lease: int = 3600, most: int = MOST_ATTEMPTS) -> bool:
    """Queued work is claimed under a new epoch, which is its token; a heartbeat, a finish or a failure counts only
    with that token (here: its parity) and before the lease ends; work whose lease is over can be claimed."""
    kind, now, status = event["event_type"], event["at"], state["status"]
    mine = status == "INDEXING" and event["token"] % 2 == state["epoch"] % 2 and state["lease"] > now
    if kind == ENQUEUE:
        if status in ("QUEUED", "RETRY", "INDEXING"):
            return False
        state.update(status="QUEUED", attempts=0)
    elif kind == CLAIM:
        free = status in ("QUEUED", "RETRY") or (status == "INDEXING" and state["lease"] <= now)
        if not free or state["attempts"] >= most:
            return False
        state.update(status="INDEXING", epoch=state["epoch"] + 1, attempts=state["attempts"] + 1, lease=now + lease)
    elif not mine:
        return False
    elif kind == BEAT:
        state["lease"] = now + lease
    elif kind == FINISH:
        state["status"] = "READY"
    else:
        state["status"] = "FAILED" if state["attempts"] >= most else "RETRY"
    return True


def publication_step(state: dict, event: dict, lease: int = 180) -> bool:
    """A wanted version above the published one can be claimed; it is acknowledged or fails under its lease, and a
    higher one that comes meanwhile leaves it pending again."""
    kind, now, status = event["event_type"], event["at"], state["status"]
    held = status == "PUBLISHING" and state["lease"] > now
    if kind == ENQUEUE:
        state["wanted"] += 1
        if status in ("NEW", "PUBLISHED"):
            state["status"] = "PENDING"
    elif kind == CLAIM:
        if not (status in ("PENDING", "RETRY") or (status == "PUBLISHING" and not held)):
            return False
        state.update(status="PUBLISHING", lease=now + lease, claimed=state["wanted"])
    elif kind == FINISH and held:
        state["published"] = state["claimed"]
        state["status"] = "PUBLISHED" if state["published"] == state["wanted"] else "PENDING"
    elif kind == FAIL and held:
        state["status"] = "RETRY"
    else:
        return False
    return True


def coalesced(events: DataFrame, key: str, revision: Column) -> DataFrame:
    """(key, nth, revision, requests, claims, state) of every revision of a key: requests for one revision are one job,
    which starts with the first of them; a newer revision supersedes one that nobody claimed before it came, and fences
    one that was claimed."""
    at = F.struct("ts", "event_id")
    asked = events.where((F.col("event_type") == ENQUEUE) & revision.isNotNull()).select(key, revision.alias("revision"), at.alias("at"))
    jobs = asked.groupBy(key, "revision").agg(F.min("at").alias("at"), F.count("*").alias("requests"))
    order = Window.partitionBy(key).orderBy("at")
    claims = events.where(F.col("event_type") == CLAIM).select(key, at.alias("at"), F.lit(None).cast("string").alias("revision"), F.lit(None).cast("long").alias("requests"))
    both = jobs.select(key, "at", "revision", "requests").unionByName(claims)
    both = both.withColumn("nth", F.count("requests").over(order)).where("nth > 0")
    per = both.groupBy(key, "nth").agg(F.max("revision").alias("revision"), F.max("requests").alias("requests"), F.count_if(F.col("requests").isNull()).alias("claims"))
    last = per.groupBy(key).agg(F.max("nth").alias("last"))
    state = F.when(F.col("nth") == F.col("last"), "HEAD").when(F.col("claims") > 0, "FENCED").otherwise("SUPERSEDED")
    return per.join(last, key).select(key, "nth", "revision", "requests", "claims", state.alias("state"))


def record_step(state: dict, event: dict, lease: int = 3600, most: int = MOST_ATTEMPTS) -> bool:
    """Work on a decision record, which can be deleted: a deletion leaves a tombstone, supersedes work that waits and
    queues a cleanup, which runs under the same lease and attempts and is tried anew when the deletion is repeated after
    it failed; a deleted record takes no further work of its own."""
    kind, now = event["event_type"], event["at"]
    deleted = state["record"] == "DELETED"
    if kind == "delete":
        if state["work"] in ("QUEUED", "RETRY"):
            state["work"] = "SUPERSEDED"
        fresh = not deleted or state["cleanup"] == "FAILED"
        if fresh:
            state.update(record="DELETED", cleanup="QUEUED", attempts=0)
        return fresh
    run = "cleanup" if deleted else "work"
    status = state[run]
    live = status == "INDEXING" and state["lease"] > now
    if kind == ENQUEUE:
        if deleted or status in ("QUEUED", "RETRY", "INDEXING", "COMPLETED"):
            return False
        state.update(work="QUEUED", attempts=0, record="PENDING")
    elif kind == CLAIM:
        if status not in ("QUEUED", "RETRY", "INDEXING") or live:
            return False
        if state["attempts"] >= most:
            state[run] = "FAILED"
            return False
        state.update({run: "INDEXING", "lease": now + lease, "attempts": state["attempts"] + 1})
        if not deleted:
            state["record"] = "PROCESSING"
    elif not live:
        return False
    elif kind == BEAT:
        state["lease"] = now + lease
    elif kind == FINISH:
        state[run] = "COMPLETED"
        if not deleted:
            state["record"] = "COMPLETED"
    else:
        state[run] = "FAILED" if state["attempts"] >= most else "RETRY"
        if not deleted:
            state["record"] = "FAILED" if state[run] == "FAILED" else "PENDING"
    return True
