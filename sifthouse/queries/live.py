"""Streams with state, and the log of a file table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import folding
from ..session import run_folder, table
from ..streaming import tracking
from ..streaming.filelog import FileLog
from .registry import query


def _come(spark: SparkSession, rows: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``rows`` with an event time ``at`` as a stream over the files they are written to, in any order of time, and its folder.

    A last row of no key, long after the others, moves the watermark past them.
    """
    folder = f"{run_folder(spark)}/live-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    end = rows.agg(F.max("at").alias("at")).filter("at is not null").select(F.lit(-1).cast(rows.schema[key].dataType).alias(key), (F.col("at") + F.expr("interval 3650 days")).alias("at"))
    end.select(*(F.col(c) if c in (key, "at") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in").withWatermark("at", "1825 days"), folder


@query()
def stream_changed_frames(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), folding.hash_column(F.col("event_type")).alias("hash"))
    stream, folder = _come(spark, e, "user_id")
    return tracking.run_on(tracking.changed_frames(stream.fillna(0, ["hash"]), "user_id", gap=86400.0), folder).filter("user_id >= 0")


@query()
def stream_face_tracks(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("face"), looks())
    stream, folder = _come(spark, e, "user_id")
    stream = stream.withColumn("face", F.coalesce("face", F.lit(-1))).withColumn("v", F.coalesce("v", F.array(F.lit(1.0), F.lit(0.0))))
    return tracking.run_on(tracking.face_tracks(stream, "user_id", gap=864000.0, alike=0.9), folder).filter("user_id >= 0")


def looks():
    """A direction for each event, by its value: events of like values look alike."""
    turn = F.col("value") / F.lit(100.0)
    return F.array(F.cos(turn), F.sin(turn)).alias("v")


@query("""WITH o AS (SELECT 'docs/' || (user_id % 300)::VARCHAR || '.txt' AS path, event_id % 4 AS batch, event_id, floor(value)::BIGINT AS size, event_type = 'view' AS change FROM events WHERE event_type <> 'click'),
b AS (SELECT path, batch, bool_or(change) AS there, arg_max(size, event_id) FILTER (change) AS size FROM o GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY batch DESC) AS rn FROM b)
SELECT path, size FROM l WHERE rn = 1 AND there""")
def file_log(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'click'")
    ops = e.select(
        "event_id", F.timestamp_seconds("event_id").alias("ts"), F.when(F.col("event_type") == "view", "change").otherwise("delete").alias("op"),
        F.concat(F.lit("docs/"), (F.col("user_id") % 300).cast("string"), F.lit(".txt")).alias("path"), F.lit(None).cast("string").alias("dest"), F.floor("value").alias("size"), F.lit(1.0).alias("mtime"))
    log = FileLog(spark, f"{run_folder(spark)}/filelog-{uuid.uuid4().hex}", buckets=8, least=100)
    for number in range(4):
        log.apply(ops.filter(F.col("event_id") % 4 == number).drop("event_id"), number)
    return log.read().select("path", "size")
