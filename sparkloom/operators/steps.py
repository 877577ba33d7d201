"""Where a lineage is cut: tables written to the folder that the executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own,
    with a warning, that goes when Python ends; on a cluster the setting is needed, as executors don't see each
    other's folders."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spark-steps-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        warnings.warn(f"{SETTING} is unset; steps are written to {found}", stacklevel=3)
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more. A collection on the driver lets Spark drop the
    shuffle files of the steps that wrote them, too."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.java.lang.System.gc()


def growing(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input and meets the other by a shuffle. Spark judges a written table
    by its packed size, and one just below its limit would pass through the driver at every round, unpacked."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least: a small file is read by one task otherwise. A
    table of more partitions stays as it is, without a shuffle. Meant for tables as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
