"""Journals as streams: exactly-once ingest by idempotency key, and windowed usage with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_journal(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """An append-only folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, key: str, at: str, out: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Appends each key once: repeats within the watermark are dropped by state, a batch that is run again by its number."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(stream: DataFrame, at: str, by: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls and summed value by tumbling window; rows later than the watermark don't count."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return w.select(F.col("w.start").alias("start"), by, "n", "total")
