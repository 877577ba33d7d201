"""Streaming twins of the ledger: job states kept per key, deliveries deduplicated under a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators import ledger as L

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
OUT = "user_id long, version long, epoch long, attempts long, last_type string, seen array<long>"
STATE = "version long, epoch long, attempts long, last_type string, at long, last long, seen array<long>"
#: Event ids of the last so many days are remembered, so that a delivery that comes again is told.
REMEMBER = 60


def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job's state after the events of a micro-batch; an enqueueing starts it afresh. An event counts once,
    by its id, whatever the order of ids; the clock is (ts, event_id), and an event older than the clock no
    longer changes what was last."""
    version, epoch, attempts, last_type, at, last, seen = state.get if state.exists else (0, 0, 0, None, -1, -1, [])
    known = dict(zip(seen[::2], seen[1::2], strict=True))
    rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
    for kind, i, ts in zip(rows["event_type"], rows["event_id"], rows["ts"].astype("datetime64[us]").astype("int64"), strict=True):
        if i in known:  # delivered again
            continue
        known[int(i)] = int(ts)
        if kind == L.ENQUEUE:
            epoch, attempts = epoch + 1, 0
        attempts += kind == L.CLAIM
        version += 1
        if (ts, i) > (at, last):
            at, last, last_type = int(ts), int(i), kind
    oldest = at - REMEMBER * 86_400_000_000
    seen = [x for pair in known.items() if pair[1] >= oldest for x in pair]
    state.update((version, epoch, attempts, last_type, at, last, seen))
    yield pd.DataFrame([(key[0], version, epoch, attempts, last_type, seen[::2])], columns=["user_id", "version", "epoch", "attempts", "last_type", "seen"])


def job_state(spark: SparkSession, path: str, shared: str) -> DataFrame:
    """The newest state of every job after all files of `path` (a folder, or a pattern of files) went
    through the stream. State and results
    are in the shared folder, so a restarted query goes on where it stopped."""
    run = f"{shared}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(EVENTS).parquet(path)
    states = events.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={number}")  # a batch that is run again replaces itself

    states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    return L.latest(spark.read.schema(OUT).option("recursiveFileLookup", "true").parquet(f"{run}/out"), "user_id", "version")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """A stream without the deliveries that came before, as far back as the watermark reaches."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys).drop("at")
