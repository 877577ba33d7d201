"""What queries move: bytes written to shuffles for a row of their tables."""

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def shuffled(spark):
    """Bytes written to shuffles by all stages so far."""
    context = spark.sparkContext
    jvm = context._gateway.jvm
    stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_record_ids_are_not_told_apart_by_their_digests(spark):
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    before = shuffled(spark)
    entry.queries()["record_ids"](spark, SMALL).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 60 * rows
