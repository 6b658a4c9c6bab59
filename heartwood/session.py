"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench. Clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("heartwood")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    own_work_dir(spark)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or what the caller told the context."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured and not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    folder = configured or context.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def own_work_dir(spark: SparkSession) -> None:
    """For a session inside one process, as in tests, that names no shared folder: a folder of its own."""
    context = spark.sparkContext
    alone = context.master == "local" or context.master.startswith("local[")
    if alone and not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="heartwood-"))
