"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "headway", cpus: str = "8", shuffle: str = "8") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HEADWAY_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, else one below the warehouse.

    A local master runs everything on one machine, so there a fresh temporary folder will do. On a cluster
    a warehouse on the local disk is refused: each executor would write to its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = own_folder(sc.master, spark.conf.get("spark.sql.warehouse.dir", ""))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def own_folder(master: str, warehouse: str) -> str:
    """Where to checkpoint when the cluster names no folder."""
    if re.fullmatch(r"local(\[.*\])?", master):
        return tempfile.mkdtemp(prefix="headway-checkpoint-")
    if not warehouse or re.match(r"file:|/|[^:/]+(/|$)", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/headway-checkpoints"


#: Spark then removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the files.

    Used where two branches must see exactly the same rows (range slices), and to cut the lineage
    of iterative jobs. The files outlive any executor; shuffle files that led to them go at once.
    """
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    usual = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own: what else is done with df keeps its files
    finally:
        conf.set(CLEANUP, usual)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for tables a job writes and reads back."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
