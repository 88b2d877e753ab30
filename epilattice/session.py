"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Results depend on these: day boundaries in UTC, errors instead of silent overflow.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# These only steer the physical plan. Broadcasts are left to Spark's own size checks (at planning
# time and again by AQE on measured shuffle sizes); nothing in the library forces one. The limit is
# the session's: a query may collect several tables of that size on the driver at once, as rows and
# as hash tables, so only who knows the driver's memory can raise it.
EXECUTION = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a running session."""
    for key, value in {**SEMANTICS, **EXECUTION}.items():
        spark.conf.set(key, value)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("epilattice")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


# Scratch folders of local sessions that name no shared folder, by application. They go when the process ends.
_LOCAL_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster the executors would
    not see it. The session's settings stay as they are.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = spark.sparkContext.applicationId
        if own not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[own] = tempfile.TemporaryDirectory(prefix="epilattice-", ignore_cleanup_errors=True)
        root = _LOCAL_FOLDERS[own].name
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives Spark the exact size of the
    table for its broadcast decision.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
