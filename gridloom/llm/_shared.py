"""The folder that driver and executors share, and tables kept there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch, where rows are whole texts: batches are held twice on either side.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one the cluster names; only where it names none (tests, one machine) a temporary one is made."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that driver and executors share")
        base = getattr(spark, "_gridloom_shared", None)
        if base is None:
            base = spark._gridloom_shared = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs run meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Spark deletes a job's shuffle files once the job has ended instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it again: what follows doesn't depend on the executors that made it."""
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
