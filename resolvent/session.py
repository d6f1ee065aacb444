"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it lies (a cluster ships it with ``--py-files`` instead)."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that driver and executors share.

    It is the session's.  Only a local master, whose executors are the driver, may do without: it gets a temporary one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="resolvent-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def for_application(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is the same for all of an application's jobs, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm)
    fs.deleteOnExit(jvm)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame as files in the shared folder: its partitions and their order stay, whatever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """The session that tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)
