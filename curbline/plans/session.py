"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "curbline", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all machines share, from spark.checkpoint.dir. Where that is unset a local master, whose only machine this is, gets a
    temporary one that goes when the program ends; on a cluster it must be set."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return shared or current.get()
    if not shared:
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="curbline-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return shared


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files, rather than keeping them until the driver collects its garbage."""
    kept = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, kept)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that are worth a file of their own.
FILE_ROWS = 20_000


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """df of about so many rows in fewer partitions, where it has more than one a core and one for FILE_ROWS rows. A partition that is written is a file,
    and Hadoop starts processes for every file it makes in a file system of the machine. Nothing is shuffled: a task takes partitions one after another."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of df, kept in the shared folder: lineage ends here and a lost executor loses nothing. Spark's cleaner deletes the files once
    nothing refers to the result, where spark.cleaner.referenceTracking.cleanCheckpoints is on. With about so many rows it is kept in few files."""
    checkpoint_dir(df.sparkSession)
    df = df if rows is None else in_few_files(df, rows)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new query, which takes the setting
