"""Session settings, table access and the durable staging used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The settings the operators are written for; a cluster's own settings win where they are already set.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", name: str = "attestra") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where a local session has set none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"attestra-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it again: its lineage ends there, and it outlives executors.

    The result carries its folder in `_staged_at`, for `unstage`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/attestra/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame | None) -> None:
    """Deletes what `staged` wrote, once nothing reads it any more."""
    path = getattr(df, "_staged_at", None)
    if path is None:
        return
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def sorted_join(df: DataFrame) -> DataFrame:
    """df for a join without a broadcast. Spark takes the size of a staged table from its compressed files, so rows of many times
    the broadcast threshold would be gathered on the driver; for sides that grow with the input."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads a table read in fewer pieces than there are cores before work that takes long per row."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(2 * want, *keys)
