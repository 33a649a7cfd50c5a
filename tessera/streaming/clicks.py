"""Clicks as a stream: counts of event windows with late data bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """New files of a table, as a stream with the table's schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, event_type, n, value) by tumbling windows.

    A window that ended ``late`` before the latest event is closed: its state is dropped
    and what still comes for it is let go.
    """
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def drain(counts: DataFrame, folder: str | None = None) -> DataFrame:
    """Everything there is, processed once; a row per window and type as it stands at the end.

    The stream updates: each batch writes the windows that it changed to a part of its own
    under ``folder`` (its own place in the shared checkpoint folder if not given), the last
    of which counts. A batch that is repeated after a failure replaces its part. Nothing comes to the
    driver. Called again with the same ``folder`` it goes on from where it was.
    """
    spark = counts.sparkSession
    at = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(part: DataFrame, batch: int) -> None:
        part.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/parts/part={batch}")

    query = counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema("start timestamp, event_type string, n bigint, value double, batch bigint").parquet(f"{at}/parts")
    return parts.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("value", "batch").alias("value"))
