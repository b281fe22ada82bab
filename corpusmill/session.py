"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


# What a collection has found is handled by other threads of the driver.
RELEASE_SECONDS = 0.1


def build_session(app_name: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution (coalescing, skew-join splitting) and UTC timestamps."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for written tables: the session's ``spark.checkpoint.dir``.

    Only a local master may run without that setting (tests); on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="corpusmill-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _session_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/corpusmill/{spark.sparkContext.applicationId}"


# Folders of the calls of `materialize_alone` that are under way, the outermost first.
_open_folders: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    return "/".join([_session_scratch(spark), *_open_folders, f"{name}-{uuid.uuid4().hex}"])


def write_scratch(df: DataFrame, name: str = "table") -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Remove a written folder once nothing reads it any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file, in UTF-8, to any path Spark can reach."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop_path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


@dataclass(frozen=True)
class WrittenTable:
    """A table in the scratch area and its size on disk."""

    df: DataFrame
    size: int


def write_table(df: DataFrame, name: str = "table") -> WrittenTable:
    """Write ``df`` once to the scratch area.

    What is read back has no lineage, survives executor loss and is pruned by column.
    """
    spark = df.sparkSession
    path = write_scratch(df, name)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = file_system.getContentSummary(hadoop_path).getLength()
    return WrittenTable(spark.read.schema(df.schema).parquet(path), size)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that nothing refers to any more.

    What the first collection finds to be free still holds the shuffles, so a second one follows.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(RELEASE_SECONDS)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every table this application wrote; tables derived from them can no longer be read."""
    delete_scratch(spark, _session_scratch(spark))


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    return write_table(df, name).df


def materialize_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """Write what ``make`` returns and remove every table that was written on the way to it."""
    folder = scratch_path(spark, "passing")
    _open_folders.append(folder.rsplit("/", 1)[1])
    try:
        df = make()
    finally:
        _open_folders.pop()
    table = materialize(df, name)
    delete_scratch(spark, folder)
    return table
