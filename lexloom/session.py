"""Session settings that hold on a laptop and on a cluster alike."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, app: str = "lexloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on; size settings are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("LEXLOOM_DRIVER_MEMORY", "8g"),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or one of our own where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as its results are written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """The same when the driver ends; what a lazy result still reads lives until then."""

    def go() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before, and with it the way to the store
            remove(spark, path)

    atexit.register(go)


class Scratch:
    """Tables written to the shared folder: lineage ends there, and they outlive lost executors.

    A table that is consumed is dropped; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.made = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", {}
        remove_at_end(spark, self.top)

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        path = f"{self.top}/{len(self.made)}"
        with shuffles_end(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.made[id(t)][0])


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again until the driver ends."""
    return Scratch(df.sparkSession).keep(df)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files give fewer partitions than there are cores; larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
