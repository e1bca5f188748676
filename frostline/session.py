"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "frostline", folder: str | None = None) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder if folder is None else SparkSession.builder.config(CHECKPOINT_DIR, folder)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps of the data model are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def partitions(spark: SparkSession) -> int:
    """Partitions the session uses for a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Where no checkpoint folder is named, the warehouse holds it: driver and
    executors share that too. A warehouse on the driver's own disk is warned of where executors are elsewhere.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if perhaps_local(warehouse, spark.sparkContext.master):
        warnings.warn(f"work tables go to {warehouse}, which executors may not reach: set {CHECKPOINT_DIR} to a shared folder", stacklevel=2)
    return warehouse.rstrip("/")


def perhaps_local(folder: str, master: str) -> bool:
    """Whether a folder may be one machine's own while the executors run on others."""
    return folder.startswith(("file:", "/")) and not master.startswith("local")


def work_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, in a folder removed when the session ends."""
    folder = f"{shared_folder(spark)}/work-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a result once to the shared folder and read it back.

    For an expensive frame that several branches of one query read: it is
    computed once, later steps read only the columns they need, and a lost
    executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
