"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docspark")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docspark-"))
        # call sites of column operations are only for error messages, and slow to record
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # rows bucketed by a path join on path and block where they are
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables, shared by all executors.

    Without one, a folder of the warehouse, which every executor writes to as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def stage(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Later steps reuse the rows instead of computing them again, and a lost
    executor costs nothing that was staged. The table goes when the session
    ends, or before with `unstage`.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        fs, folder = _folder(df.sparkSession, df.staged_at)
        fs.delete(folder, True)


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it, or None on another kind of file system."""
    fs, folder = _folder(spark, path)
    return folder.toUri().getPath() if fs.getUri().getScheme() == "file" else None
