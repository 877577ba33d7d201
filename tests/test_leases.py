import datetime
import random

import pytest

pytest.importorskip("google.protobuf")

from pyspark.sql import functions as F  # noqa: E402
from sparkloom.operators import ledger as L  # noqa: E402
from sparkloom.streaming import leases  # noqa: E402
from sparkloom.streaming.jobs import EVENTS  # noqa: E402

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain(events, passed):
    """Ends of leases by a loop over each job's events."""
    out = []
    for user in {e[2] for e in events}:
        rows = sorted({(e[1], e[0], e[3]) for e in events if e[2] == user and e[1] < passed})
        status, attempts = None, 0
        for i, (ts, _, kind) in enumerate(rows):
            status, attempts = leases.after(status, attempts, kind)
            end = ts + datetime.timedelta(seconds=L.LEASE_SECONDS)
            if status == "RUNNING" and (rows[i + 1][0] >= end if i + 1 < len(rows) else end < passed):
                out.append((user, end, attempts, "FAILED" if attempts >= L.MOST_ATTEMPTS else "RETRY"))
    return sorted(out)


def test_stream_equals_batch_also_when_a_job_falls_silent(spark, tmp_path):
    rng = random.Random(3)
    kinds = (L.ENQUEUE, L.CLAIM, L.CLAIM, L.BEAT, L.FINISH, L.FAIL)
    events = [(i, at(i * 20 + rng.randrange(0, 40)), rng.randrange(6), rng.choice(kinds), 1.0, None) for i in range(250)]
    events += [(900, at(10), 77, L.CLAIM, 1.0, None)]  # claimed once, and never heard of again
    events += events[20:30]  # delivered again
    last = (1000, at(50_000), 99, L.ENQUEUE, 1.0, None)
    order = sorted(events, key=lambda e: (e[1] + datetime.timedelta(seconds=rng.randrange(0, 60)), e[0]))  # late by up to a minute
    for n, part in enumerate([order[:90], order[90:180], order[180:], [last]]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    got = leases.ended_leases(spark, f"file://{tmp_path}/in/*", f"file://{tmp_path}/shared", late="10 minutes", files=1)
    found = sorted((r.user_id, r.ended_at, r.attempts, r.next_status) for r in got.collect())
    passed = at(50_000 - 600)
    want = plain([*events, last], passed)
    assert (77, at(10 + L.LEASE_SECONDS), 1, "RETRY") in want and len(want) > 20
    assert found == want
    batch = leases.ended_leases_at_once(spark.createDataFrame([*events, last], EVENTS), F.lit(passed).cast("timestamp_ntz"))
    assert sorted((r.user_id, r.ended_at, r.attempts, r.next_status) for r in batch.collect()) == want


def test_state_goes_when_a_job_rests(spark, tmp_path):
    """After KEEP a job's state is dropped: what comes then starts afresh."""
    first = [(1, at(0), 5, L.ENQUEUE, 1.0, None), (2, at(1), 5, L.CLAIM, 1.0, None), (3, at(2), 5, L.CLAIM, 1.0, None), (4, at(3), 5, L.FINISH, 1.0, None)]
    late = [(5, at(90_000), 5, L.CLAIM, 1.0, None), (6, at(100_000), 9, L.ENQUEUE, 1.0, None)]
    for n, part in enumerate([first, [(7, at(50_000), 9, L.ENQUEUE, 1.0, None)], late]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    for keep, attempts in ((3600, 1), (86_400 * 30, 3)):
        got = leases.ended_leases(spark, f"file://{tmp_path}/in/*", f"file://{tmp_path}/s{keep}", late="10 minutes", keep=keep, files=1)
        assert [(r.user_id, r.attempts) for r in got.collect()] == [(5, attempts)]


class Calls:
    """A state that counts the messages it would send."""

    def __init__(self):
        self.calls, self.rows, self.value = 0, [], None

    def get(self):
        self.calls += 1
        return self.value if self.value else iter(self.rows)

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "appendList":
                self.rows = self.rows + args[0]
            if name in ("put", "clear"):
                self.rows = list(args[0]) if args else []

        return call


class Job(Calls):
    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_a_job_of_many_events_sends_few_messages():
    """Each message to the state store costs as much as many events: they go in lists."""
    job, waiting, n = Job(), Calls(), 300

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return job

        def getListState(self, *_):  # noqa: N802
            return waiting

        getMapState = getListState  # noqa: N815

        def registerTimer(self, at):  # noqa: N802
            pass

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    states, clock = leases.Leases(), Clock()
    states.init(Handle())
    rows = leases.pd.DataFrame({"us": [i * 1_000_000 for i in range(n)], "event_id": range(n), "event_type": [L.CLAIM] * n})
    assert not list(states.handleInputRows((1,), iter([rows]), clock)) and len(waiting.rows) == n
    clock.now = n * 1000 + L.LEASE_SECONDS * 1000 + 1
    ended = leases.pd.concat(states.handleExpiredTimer((1,), clock, None))
    assert list(ended["ended_at"]) == [(n - 1 + L.LEASE_SECONDS) * 1_000_000] and list(ended["attempts"]) == [n] and not waiting.rows
    assert job.calls + waiting.calls < 10
