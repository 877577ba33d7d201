"""Leases that end by themselves: a stateful stream with timers, and its batch twin.

A running job holds a lease that each claim and beat renews. The stream keeps a job's events until the watermark has
passed them, so that they are applied in order of (ts, event_id) however they arrive and a delivery that comes again
counts once; a timer wakes it for the next event and for the end of the lease. A lease that ends without a further
event is told when the watermark passes its end, and a job that was silent for `KEEP` after it came to rest gives its
state back. Events behind the watermark are dropped.

The batch twin tells the same ends from all events at once, up to the time that the stream's watermark reached, for a
stream that keeps every state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators import ledger as L

from .jobs import EVENTS

OUT = "user_id long, ended_at long, attempts long, next_status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a job at rest keeps its state, in seconds; how far the watermark trails.
KEEP, LATE = 30 * 86_400, "1 hour"
RESTING = ("COMPLETED", "FAILED", "RETRY", "PENDING")


def after(status: str | None, attempts: int, kind: str) -> tuple[str, int]:
    """A job's status and attempts after an event."""
    if kind == L.ENQUEUE:
        return "PENDING", 0
    attempts += kind == L.CLAIM
    if kind == L.FINISH:
        return "COMPLETED", attempts
    if kind == L.FAIL:
        return ("FAILED" if attempts >= L.MOST_ATTEMPTS else "RETRY"), attempts
    return "RUNNING", attempts


class Leases(StatefulProcessor):
    """Rows of OUT, one for each lease that ended. Times are microseconds."""

    def __init__(self, keep: int = KEEP):
        self.keep = keep * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts long, lease long, at long")
        # A list, as each call of a state is a message to Spark: a job's events come and go together.
        self.waiting = handle.getListState("waiting", "ts long, event_id long, event_type string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(ts), int(i), kind) for part in rows for ts, i, kind in zip(part["us"], part["event_id"], part["event_type"], strict=True) if ts >= passed]
        yield from self._advance(key, passed, new)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key: tuple, passed: int, new: list[tuple] = []) -> Iterator[pd.DataFrame]:  # noqa: B006
        """Apply what lies behind the watermark, in order; ask for a timer for what is next."""
        status, attempts, lease, at = self.job.get() or (None, 0, None, None)
        known = {(ts, i): kind for ts, i, kind in [*self.waiting.get(), *new]}
        ended, events = [], sorted(known.items(), key=lambda e: e[0])
        ready = [e for e in events if e[0][0] < passed]
        for (ts, i), kind in ready:
            if status == "RUNNING" and lease <= ts:
                ended.append((lease, attempts))
            elif status in RESTING and ts > at + self.keep:  # its state is gone, or would be
                status, attempts = None, 0
            status, attempts = after(status, attempts, kind)
            lease, at = (ts + L.LEASE_SECONDS * 1_000_000 if status == "RUNNING" else None), ts
        rest = [(ts, i, kind) for (ts, i), kind in events[len(ready) :]]
        if ready and rest:
            self.waiting.put(rest)
        elif ready:
            self.waiting.clear()
        elif new:
            self.waiting.appendList(new)
        if status == "RUNNING" and lease < passed:
            ended.append((lease, attempts))
            status = "FAILED" if attempts >= L.MOST_ATTEMPTS else "RETRY"
        wake = [events[len(ready)][0][0]] if len(ready) < len(events) else []
        if status in RESTING and not wake and at + self.keep < passed:
            self.job.clear()
        elif status is not None:
            self.job.update((status, attempts, lease, at))
            wake.append(lease if status == "RUNNING" else at + self.keep)
        if wake:
            self.handle.registerTimer(max(min(wake), passed) // 1000 + 1)
        if ended:
            yield pd.DataFrame({"user_id": key[0], "ended_at": [t for t, _ in ended], "attempts": [a for _, a in ended], "next_status": ["FAILED" if a >= L.MOST_ATTEMPTS else "RETRY" for _, a in ended]})

    def close(self) -> None:
        pass


def ended_leases(spark: SparkSession, path: str, shared: str, late: str = LATE, keep: int = KEEP, files: int | None = None) -> DataFrame:
    """(user_id, ended_at, attempts, next_status) of all leases that ended before the watermark that all files of
    `path` lead to, `files` of them in a micro-batch. State and results are in the shared folder, so that a restarted
    query goes on where it stopped."""
    run = f"{shared}/leases-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(EVENTS)
    events = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    timed = events.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        states = timed.groupBy("user_id").transformWithStateInPandas(Leases(keep), OUT, "Append", "EventTime")

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{run}/out/batch={number}")  # a batch that is run again replaces itself

        states.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.schema(OUT).option("recursiveFileLookup", "true").parquet(f"{run}/out")
    return found.withColumn("ended_at", F.timestamp_micros("ended_at").cast("timestamp_ntz"))


def ended_leases_at_once(events: DataFrame, passed: Column) -> DataFrame:
    """The same from all events, for a watermark `passed`. Events of one id and time are one event."""
    rows = events.where(F.col("ts") < passed).select("user_id", "ts", "event_id", "event_type").distinct()
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumn("epoch", F.count_if(F.col("event_type") == L.ENQUEUE).over(order)).withColumn("next", F.lead("ts").over(order))
    within = Window.partitionBy("user_id", "epoch").orderBy("ts", "event_id")
    rows = rows.withColumn("attempts", F.count_if(F.col("event_type") == L.CLAIM).over(within))
    lease = F.col("ts") + F.expr(f"INTERVAL {L.LEASE_SECONDS} SECONDS")
    running = ~F.col("event_type").isin(L.ENQUEUE, L.FINISH, L.FAIL)
    over = rows.where(running).withColumn("ended_at", lease).where(F.when(F.col("next").isNotNull(), F.col("ended_at") <= F.col("next")).otherwise(F.col("ended_at") < passed))
    status = F.when(F.col("attempts") >= L.MOST_ATTEMPTS, "FAILED").otherwise("RETRY")
    return over.select("user_id", "ended_at", "attempts", status.alias("next_status"))
