"""The file log beside the table that is rewritten each time, its replays, compaction and repair."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sifthouse.streaming import files
from sifthouse.streaming.filelog import FileLog, follow

OPS = "ts timestamp, op string, path string, dest string, size long, mtime double"


def _ops(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, op string, path string, dest string, size long, mtime double").select(F.timestamp_seconds("n").alias("ts"), "op", "path", "dest", "size", "mtime")


def _table(log):
    return sorted(tuple(r) for r in log.read().collect())


def _batches(seed):
    rng = random.Random(seed)
    folders = ["a", "a/b", "c", "c/d", "e"]
    path = lambda: f"{rng.choice(folders)}/f{rng.randrange(8)}.txt"
    out = []
    for _ in range(5):
        batch = []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.random()
            if kind < 0.7:
                batch.append(("change", path(), None, rng.randrange(100), float(rng.randrange(100))))
            elif kind < 0.8:
                batch.append(("delete", rng.choice([path(), rng.choice(folders)]), None, None, None))
            elif kind < 0.9:
                batch.append(("move", path(), path(), None, None))
            else:
                batch.append(("move", rng.choice(folders), f"g{rng.randrange(3)}", None, None))
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", [2])
def test_log_equals_the_whole_table(spark, tmp_path, seed):
    """Batches applied to the log, each twice and some by a writer that starts anew, with buckets compacted on the way."""
    folder = f"file://{tmp_path}/log"
    log, whole = FileLog(spark, folder, buckets=3, least=2), spark.createDataFrame([], files.FILES)
    for number, batch in enumerate(_batches(seed)):
        ops = _ops(spark, batch)
        log.apply(ops, number)
        log.apply(ops, number)
        if number % 2:
            log = FileLog(spark, folder, least=2)
            log.apply(ops, number)
        whole = spark.createDataFrame(files.apply_operations(whole, ops).collect(), files.FILES)
        assert _table(log) == sorted(tuple(r) for r in whole.collect())
    assert any(s.base for s in log._state.values())
    names = os.listdir(f"{tmp_path}/log")
    assert sorted(n for n in names if n.startswith("manifest")) == [f"manifest-{log._number - 1}", f"manifest-{log._number}"]
    # what no manifest names any more is gone
    used = {x for state in (log._state, log._manifest(log._number - 1)[1]) for s in state.values() for x in (s.base, *s.changes)}
    assert {n for n in names if not n.startswith("manifest")} <= used


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    log = FileLog(spark, f"file://{tmp_path}/log", buckets=4, least=50)
    log.apply(_ops(spark, [("change", f"a/{i}.txt", None, i, 1.0) for i in range(300)]), 0)
    assert all(s.base and not s.changes for s in log._state.values())  # compacted at once
    bases = {b: s.base for b, s in log._state.items()}
    log.apply(_ops(spark, [("change", "a/7.txt", None, 70, 2.0), ("change", "a/8.txt", None, 8, 1.0), ("delete", "a/9.txt", None, None, None)]), 1)
    written = spark.read.parquet(*{f"{tmp_path}/log/{c}" for s in log._state.values() for c in s.changes})
    assert {r["path"] for r in written.collect()} == {"a/7.txt", "a/8.txt", "a/9.txt"} and {b: s.base for b, s in log._state.items()} == bases
    assert log.read().count() == 299 and log.read().filter("path = 'a/7.txt'").first()["size"] == 70


def test_a_failed_batch_leaves_the_log(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/log"
    log = FileLog(spark, folder, buckets=2)
    log.apply(_ops(spark, [("change", "a/1.txt", None, 1, 1.0)]), 0)
    monkeypatch.setattr(FileLog, "_compact", lambda *a: 1 / 0)
    log.least = 0
    with pytest.raises(ZeroDivisionError):
        log.apply(_ops(spark, [("change", "a/2.txt", None, 2, 1.0)]), 1)
    monkeypatch.undo()
    assert _table(log) == _table(FileLog(spark, folder)) == [("a/1.txt", 1, 1.0)]
    log.apply(_ops(spark, [("change", "a/2.txt", None, 2, 1.0)]), 1)
    assert len(_table(log)) == 2


def test_a_scan_repairs_the_log(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    log = FileLog(spark, folder, buckets=3)
    log.apply(_ops(spark, [("change", p, None, 1, 1.0) for p in ("a/1.txt", "a/2.txt", "b/3.txt", "b/x/4.txt", "c/5.txt")]), 0)
    found = lambda *r: spark.createDataFrame(list(r), files.FILES)
    assert log.reconcile(found(("a/1.txt", 1, 1.5), ("a/2.txt", 9, 1.0), ("a/new.txt", 3, 3.0), ("a/new.txt", 2, 2.0)), "a") == {"added": 1, "changed": 1, "gone": 0}
    assert log.reconcile(found(("b/other.txt", 1, 1.0)), "b", unreadable=["b/x"]) == {"added": 1, "changed": 0, "gone": 1}
    assert log.reconcile(found(), "c") == {"added": 0, "changed": 0, "gone": 0}  # a folder that vanished removes nothing
    want = [("a/1.txt", 1, 1.0), ("a/2.txt", 9, 1.0), ("a/new.txt", 3, 3.0), ("b/other.txt", 1, 1.0), ("b/x/4.txt", 1, 1.0), ("c/5.txt", 1, 1.0)]
    assert _table(log) == _table(FileLog(spark, folder)) == want and log.batch == 0


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    schema = "ts timestamp, event string, path string, dest string, is_dir boolean, size long, mtime double"
    source, folder = f"{tmp_path}/events", f"file://{tmp_path}/log"
    rows = lambda *r: spark.createDataFrame([(t, *x, False, t, float(t)) for t, *x in r], "t long, event string, path string, dest string, is_dir boolean, size long, mtime double").select(F.timestamp_seconds("t").alias("ts"), "event", "path", "dest", "is_dir", "size", "mtime")
    rows((1, "created", "a/one.txt", None), (2, "created", "a/two.txt", None)).write.parquet(source)
    assert _table(follow(spark.readStream.schema(schema).parquet(source), folder, 2)) == [("a/one.txt", 1, 1.0), ("a/two.txt", 2, 2.0)]
    rows((3, "deleted", "b/two.txt", None), (4, "moved", "a", "b"), (5, "created", "a/three.txt", None)).write.mode("append").parquet(source)
    log = follow(spark.readStream.schema(schema).parquet(source), folder, 2)
    assert _table(log) == [("a/three.txt", 5, 5.0), ("b/one.txt", 1, 1.0)] and log.batch == 1
