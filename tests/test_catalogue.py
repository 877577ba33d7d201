from sparkloom import plans
from sparkloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_mentions_are_dealt_by_the_size_of_their_table(spark, monkeypatch):
    """Both tables that mentions meet grow: none is sent whole, and parts grow with the table."""
    monkeypatch.setattr(catalogue, "MENTION_PARTS", 9, raising=False)
    plan = plans.queries()["mention_inventory"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    parts = 9 * spark.read.parquet(f"{SMALL}/lineitem.parquet").rdd.getNumPartitions()
    assert "Broadcast" not in plan and plan.count(f", {parts})") >= 4
