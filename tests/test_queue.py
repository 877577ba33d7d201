import sys
from pathlib import Path

from pyspark.sql import functions as F
from sparkloom import plans
from sparkloom.operators import enrichment, ledger, pruning
from sparkloom.plans import queue
from sparkloom.plans.registry import Tables

sys.path.insert(0, str(Path(__file__).resolve().parent))
import test_pruning  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_pruning_of_orders_equals_plain_loop(spark):
    t = Tables(spark, SMALL)
    found = queue.contexts(t)
    frames = {}
    for name in test_pruning.SCHEMAS:
        rows = getattr(found, name).where("cast(ctx AS int) % 25 = 1")
        order = [f.split(" ")[0] for f in test_pruning.SCHEMAS[name].split(", ")]
        for r in rows.select(*order).collect():
            frames.setdefault(r.ctx, {k: [] for k in test_pruning.SCHEMAS})[name].append(tuple(r))
    steps = {}
    for r in sorted(plans.queries()["pruning_log"](spark, SMALL).collect(), key=lambda r: r.step):
        steps.setdefault(r.ctx, []).append((r.kind, r.id, r.freed, r.left, r.gone))
    assert len(frames) > 20 and any(len(s) > 2 for s in steps.values())
    for ctx, c in frames.items():
        assert steps.get(ctx, []) == test_pruning.plain(c, 200)[1]


def test_records_that_are_deleted():
    def run(*events):
        state = {"record": "NEW", "work": "NONE", "cleanup": "NONE", "attempts": 0, "lease": 0}
        took = [ledger.record_step(state, {"event_type": k, "at": at}, lease=10) for at, k in events]
        return took, state["record"], state["work"], state["cleanup"]

    ask, claim, beat, done, fail = ledger.ENQUEUE, ledger.CLAIM, ledger.BEAT, ledger.FINISH, ledger.FAIL
    assert run((0, ask), (1, claim), (2, done)) == ([True] * 3, "COMPLETED", "COMPLETED", "NONE")
    assert run((0, ask), (1, "delete"), (2, ask), (3, claim), (4, done)) == ([True, True, False, True, True], "DELETED", "SUPERSEDED", "COMPLETED")
    assert run((0, ask), (1, claim), (2, "delete"), (3, done)) == ([True, True, True, False], "DELETED", "INDEXING", "QUEUED")
    assert run((0, ask), (1, claim), (5, claim), (9, beat), (18, beat), (40, beat)) == ([True, True, False, True, True, False], "PROCESSING", "INDEXING", "NONE")
    failing = [(n, k) for n in range(0, 60, 2) for k in (claim, fail)][:6]
    took, record, work, cleanup = run((0, "delete"), *failing, (90, "delete"), (91, claim), (92, done))
    assert (record, cleanup) == ("DELETED", "COMPLETED") and took[-3:] == [True, True, True]


def test_records_over_the_table(spark):
    found = plans.queries()["record_jobs"](spark, SMALL).collect()
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    gone = {r.user_id for r in events.where("value > 90").select("user_id").distinct().collect()}
    assert {r.user_id for r in found if r.record == "DELETED"} == gone
    assert len(found) == events.select("user_id").distinct().count()
    assert sum(r.accepted + r.refused for r in found) == events.count()


def test_a_source_that_changes_between_preview_and_application(spark):
    rows = spark.createDataFrame([(1, "s", None, "a", None), (2, "s", "a", "b", "v1"), (3, "s", "a", "a", "v0"), (4, "s", "a", "a", "v1"), (5, None, None, "a", None)], "doc_id long, source string, seen string, now string, model string")
    plan = enrichment.preview(rows)
    assert {r.doc_id: (r.state, r.action) for r in plan.collect()} == {1: ("NEW", "ENRICH"), 2: ("STALE_SOURCE", "ENRICH"), 3: ("STALE_MODEL", "ENRICH"), 4: ("CURRENT", "SKIP"), 5: ("UNUSABLE", "SKIP")}
    assert {r.doc_id: r.action for r in enrichment.preview(rows, force=True).collect()} == {1: "ENRICH", 2: "ENRICH", 3: "ENRICH", 4: "ENRICH", 5: "SKIP"}
    later = rows.withColumn("now", F.when(F.col("doc_id") == 1, "z").otherwise(F.col("now")))
    got = {r.doc_id: (r.seen, r.model) for r in enrichment.applied(later, plan).collect()}
    assert got == {1: (None, None), 2: ("b", "v1"), 3: ("a", "v1"), 4: ("a", "v1"), 5: (None, None)}


def test_contexts_are_pruned_to_the_budget(spark):
    stays, log = pruning.pruned(queue.contexts(Tables(spark, SMALL)), 200)
    left = stays.groupBy("ctx").agg(F.sum("size").alias("n"))
    assert left.where("n > 200").count() == 0 and log.count() > 0


def test_discovery_of_conversations(spark):
    seeds = {(r.ctx, r.delta): r for r in plans.queries()["discovery_seeds"](spark, SMALL).collect()}
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").where("text IS NOT NULL")
    assert len(seeds) == turns.count()  # no conversation is long enough for a bound on its turns
    queries = plans.queries()["discovery_queries"](spark, SMALL).collect()
    assert sum(r.seeds for r in queries) == 2 * len(seeds) and all(len(r.text) <= 1600 for r in queries)
    assert {r.code for r in plans.queries()["discovery_omitted"](spark, SMALL).collect()} <= {"UNMAPPED_UNIT", "NEIGHBOR_LIMIT", "ENTITY_LIMIT", "QUERY_TEXT_LIMIT"}


def test_a_context_is_cut_where_it_stands(spark):
    """Of a pruning only the lines are shuffled, once, and nothing is joined or written on the way."""
    lines = Tables(spark, SMALL).lineitem
    plan = pruning.log(pruning.cut(queue.gathered_contexts(lines), 200))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in plan


def test_neighbouring_words_are_of_one_turn(spark, tmp_path):
    """Also where turns of a conversation have no number, and so no key to tell them apart by."""
    rows = [(1, None, "user", "firstword secondword"), (1, None, "user", "thirdword fourthword"), (1, 2, None, "firstword"), (1, 3, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    _, entities, mapped, edges = queue._discovery(Tables(spark, str(tmp_path)))
    assert {r.edge for r in edges.collect()} == {"firstword>secondword", "thirdword>fourthword"}
    assert {r.entity for r in entities.collect()} == {"firstword", "secondword", "thirdword", "fourthword"}
    assert [(r.delta, r.entity) for r in mapped.collect()] == [("t0002", "firstword")]
