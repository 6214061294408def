"""Structured Streaming over file and queue events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import run_folder


def event_stream(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """Events as a stream with a watermark; event time without a zone is read as UTC."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over all that is there now, into a Parquet table with its checkpoint in the shared folder, and read that table."""
    spark = stream.sparkSession
    where = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/out")
    else:
        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{where}/out")

        query = stream.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def tumbling(events: DataFrame, width: str, key: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def hopping(events: DataFrame, width: str, hop: str, key: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, hop).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """Bursts of a key's events with pauses under ``gap``: a burst is handled once it is quiet."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_within(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(keys)
