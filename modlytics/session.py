"""Session settings and lineage control."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "modlytics", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Dates are UTC days, and skewed joins and oversized or tiny shuffle partitions
    are left to adaptive execution.  Nothing sizes the cluster here; pass that in
    as ``conf`` or to spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # Call-site capture for every column call; it dominates building wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Every date and timestamp rule here is stated in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors can reach, as the session names it.

    A local session without one gets a fresh temporary folder, because there the
    driver's disk is the only disk.  A cluster without one gets none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="modlytics-")
        spark.sparkContext.setCheckpointDir(own)
        return own
    return None


def require_folder(spark: SparkSession) -> str:
    """The shared folder, or an error that says how to name one."""
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def keep(df: DataFrame) -> DataFrame:
    """Hold a frame that several jobs reuse, so a lost executor costs no recomputation.

    Written to the shared folder when there is one; otherwise cached with its
    lineage, which Spark can recompute.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
