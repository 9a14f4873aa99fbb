"""Session helpers.

Library code never creates a session or sets cluster settings; these helpers
are for tests, the bench and local runs only.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    cpus = str(cpus)
    parts = shuffle_partitions or max(8, 2 * int(cpus if cpus != "*" else os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("recoflow")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session (``spark.checkpoint.dir``).

    On a cluster that setting names a shared folder and is used as is. Only a
    local-mode session without the setting (tests, bench) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; it is needed to cut lineage")
    path = tempfile.mkdtemp(prefix="recoflow-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared checkpoint folder and read back; compressed, unlike a checkpoint."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer held (its cleaner waits for the driver's JVM to collect them)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


ROWS_A_TASK = 1 << 17


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (some ``rows`` rows) dealt by ``keys`` into tasks of about ``ROWS_A_TASK`` rows, so a task's memory does not grow with the table.

    A table that gives every core less than that is left to the planner.
    """
    tasks = -(-rows // ROWS_A_TASK)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df
