"""Session helpers: recommended settings, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rxlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators were tuned under. Existing values win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed but lies in the same place."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))
    return spark


def local_folder(context) -> str:
    """A temporary folder, only where driver and executors are one machine; anywhere else it must be named."""
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder named by ``spark.checkpoint.dir``.

    Only a session that names no folder (tests on one machine) gets a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
            "spark.checkpoint.dir", None
        )
        context.setCheckpointDir(folder or local_folder(context))
    return df.checkpoint(eager=True)
