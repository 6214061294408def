"""Kept frames and face tracks over streams: events wait in the state of their video until the watermark has passed them, and are then taken in the order of their time.

Results are those of the batch operators over all events that came in time. A video's state holds
the events that still wait and what the batch operator carries from row to row; a timer clears it
once nothing can follow any more.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..operators.chunking import frame_changed, join_track

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fields(**kinds) -> StructType:
    """A schema without a session, which the state's driver worker has none of."""
    return StructType([StructField(n, k) for n, k in kinds.items()])


TIME, NUMBER, VECTOR = DoubleType(), LongType(), ArrayType(DoubleType())


class _InOrder(StatefulProcessor):
    """Holds a video's events until the watermark passes them, then takes them by time and tie."""

    #: What waits of an event, the time first and the tie second.
    waits: StructType

    def __init__(self, key: str, gap: float):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.latest = handle.getValueState("latest", _fields(ts=TIME))
        self.remember(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.waits.names
        for pdf in rows:
            plain = ([x.tolist() if isinstance(x, np.ndarray) else x for x in pdf[n].tolist()] for n in names)
            self.waiting.appendList(list(zip(*plain, strict=True)))
            self.handle.registerTimer(math.ceil(pdf["ts"].min() * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        held = list(self.waiting.get())
        due = sorted((r for r in held if r[0] <= passed), key=lambda r: (r[0], r[1]))
        if due:
            rest = [tuple(r) for r in held if r[0] > passed]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(math.ceil(min(r[0] for r in rest) * 1000))
            else:
                self.waiting.clear()
            self.latest.update((due[-1][0],))
            # what no later event can follow goes then
            self.handle.registerTimer(math.floor((due[-1][0] + self.gap) * 1000) + 1)
            out = self.take(key[0], due)
            if len(out):
                yield out
        elif not held and self.latest.exists() and self.latest.get()[0] + self.gap < passed:
            self.latest.clear()
            self.forget()

    def close(self) -> None:
        pass

    def remember(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def take(self, key, due: list) -> pd.DataFrame:
        raise NotImplementedError


class _Frames(_InOrder):
    waits = _fields(ts=TIME, hash=NUMBER)

    def __init__(self, key: str, most: int, gap: float):
        super().__init__(key, gap)
        self.most = most

    def remember(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _fields(ts=TIME, hash=NUMBER))

    def forget(self) -> None:
        self.last.clear()

    def take(self, key, due: list) -> pd.DataFrame:
        last = tuple(self.last.get()) if self.last.exists() else None
        kept = []
        for ts, h in due:
            if frame_changed(last, ts, h, self.most, self.gap):
                last = ts, h
                kept.append((key, ts, h))
        if kept:
            self.last.update(last)
        return pd.DataFrame(kept, columns=[self.key, "ts", "hash"])


class _Tracks(_InOrder):
    waits = _fields(ts=TIME, face=NUMBER, v=VECTOR)

    def __init__(self, key: str, gap: float, alike: float, every: float):
        super().__init__(key, gap)
        self.alike, self.every = alike, every

    def remember(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", _fields(track=NUMBER), _fields(seen=TIME, v=VECTOR, stored=TIME))

    def forget(self) -> None:
        self.live.clear()

    def take(self, key, due: list) -> pd.DataFrame:
        before = {k[0]: (x[0], np.asarray(x[1], np.float64), x[2]) for k, x in self.live.iterator()}
        live, out = dict(before), []
        for ts, face, v in due:
            track, stored = join_track(live, ts, face, np.asarray(v, np.float64), self.gap, self.alike, self.every)
            out.append((key, ts, face, track, stored))
        for t in before.keys() - live.keys():
            self.live.removeKey((t,))
        for t, x in live.items():
            if before.get(t) is not x:
                self.live.updateValue((t,), (x[0], [float(y) for y in x[1]], x[2]))
        return pd.DataFrame(out, columns=[self.key, "ts", "face", "track", "stored"])


def changed_frames(frames: DataFrame, key: str, most: int = 4, gap: float = 15.0) -> DataFrame:
    """``key, ts, hash`` of a stream ``frames(key, at, hash)`` as ``chunking.keep_changed_frames`` keeps them.

    ``at`` is the event time with its watermark, ``ts`` the same in seconds. A frame is decided
    when the watermark has passed it, frames of one time by their hashes; later ones are dropped.
    """
    kind = frames.schema[key].dataType.simpleString()
    rows = frames.withColumn("ts", F.unix_micros("at") / F.lit(1e6)).select(key, "at", "ts", "hash")
    return rows.groupBy(key).transformWithStateInPandas(_Frames(key, most, gap), StructType.fromDDL(f"{key} {kind}, ts double, hash long"), "Append", "EventTime")


def face_tracks(faces: DataFrame, key: str, gap: float = 12.0, alike: float = 0.6, every: float = 60.0) -> DataFrame:
    """``key, ts, face, track, stored`` of a stream ``faces(key, at, face, v)`` as ``chunking.face_tracks`` gives them; ``at`` is the event time with its watermark."""
    kind = faces.schema[key].dataType.simpleString()
    rows = faces.select(key, "at", (F.unix_micros("at") / F.lit(1e6)).alias("ts"), "face", F.transform("v", lambda x: x.cast("double")).alias("v"))
    return rows.groupBy(key).transformWithStateInPandas(_Tracks(key, gap, alike, every), StructType.fromDDL(f"{key} {kind}, ts double, face long, track long, stored boolean"), "Append", "EventTime")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which these operators need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_on(stream: DataFrame, folder: str) -> DataFrame:
    """Run over all that is there now into a table in ``folder``, from where its checkpoint there ends, and read the table."""
    spark = stream.sparkSession
    with state_store(spark):
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
