"""Frames and faces over streams that come out of order, beside the batch operators; stopped and gone on with."""

import random

import pytest
from pyspark.sql import functions as F

from sifthouse.operators import chunking
from sifthouse.streaming import tracking

FRAMES, FACES = "k long, ts double, hash long", "k long, ts double, face long, v array<double>"


def _parts(rows, n, late, rng):
    """Rows in ``n`` files: times that come up to ``late`` seconds out of order, each file in any order."""
    by_arrival = sorted(rows, key=lambda r: r[1] + rng.random() * late)
    size = -(-len(rows) // n)
    parts = [by_arrival[i : i + size] for i in range(0, len(rows), size)]
    for p in parts:
        rng.shuffle(p)
    return parts


def _write(spark, part, schema, folder, name):
    df = spark.createDataFrame(part, schema).withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).coalesce(1)
    df.write.parquet(f"{folder}/{name}")


def _stream(spark, schema, folder, late):
    return spark.readStream.schema(schema + ", at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder).withWatermark("at", f"{late} seconds")


def _run(spark, tmp_path, rows, schema, last, operator, late=30):
    """The stream's result over parts that come one after the other; it stops after two of them and goes on."""
    rng = random.Random(3)
    come, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    parts = _parts(rows, 5, late * 0.9, rng) + [[last]]
    for i, part in enumerate(parts):
        _write(spark, part, schema, come, f"p{i}")
        if i in (1, len(parts) - 1):
            table = tracking.run_on(operator(_stream(spark, schema, come, late)), out)
            if i == 1:
                early = table.count()
    return early, sorted(tuple(r) for r in table.filter("k >= 0").collect())


def test_frames_over_a_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted({(k, rng.randrange(1_600) / 4, rng.choice([0, 1, 3, 255, 1 << 40])) for k in range(4) for _ in range(60)})
    want = sorted(tuple(r) for r in chunking.keep_changed_frames(spark.createDataFrame(rows, FRAMES), "k").collect())
    early, got = _run(spark, tmp_path, rows, FRAMES, (-1, 5_000.0, 0), lambda s: tracking.changed_frames(s, "k"))
    assert got == want and 0 < early < len(want)


def test_tracks_over_a_stream(spark, tmp_path):
    rng = random.Random(2)
    looks = [[1.0, 0.0, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0], [0.0, 0.7, 0.714]]
    rows = [(k, rng.randrange(1_200) / 4, 1000 * k + i, rng.choice(looks)) for k in range(3) for i in range(50)]
    want = sorted(tuple(r) for r in chunking.face_tracks(spark.createDataFrame(rows, FACES), "k").collect())
    early, got = _run(spark, tmp_path, rows, FACES, (-1, 5_000.0, 0, looks[0]), lambda s: tracking.face_tracks(s, "k"))
    assert got == want and 0 < early < len(want)
    assert len({r[3] for r in got}) < len(got)  # likeness joins faces into tracks


def test_streamed_queries_beside_the_batch_operators(spark):
    """The registered streams over whole tables give what the batch operators give."""
    from sifthouse.queries import QUERIES, live
    from sifthouse.session import table

    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(QUERIES["stream_changed_frames"](spark, sf)) == rows(QUERIES["changed_frames"](spark, sf))
    faces = table(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("face"), live.looks())
    want = rows(chunking.face_tracks(faces, "user_id", gap=864000.0, alike=0.9))
    assert rows(QUERIES["stream_face_tracks"](spark, sf)) == want
    assert len({r[3] for r in want}) < len(want)
