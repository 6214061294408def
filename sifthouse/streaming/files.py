"""Events of a file system as a stream: what they mean, when a file is quiet, and how a table of files follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import kind_of
from ..operators.facets import ancestors
from ..sources.readers import IGNORED

#: Seconds without a change after which a file is looked at.
QUIET = "2 seconds"


def ignored(path: Column) -> Column:
    """Whether a part of a path is hidden or of a name that scans pass over."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") | F.lower(p).isin(IGNORED))


def operations(events: DataFrame) -> DataFrame:
    """``ts, op, path, dest`` of ``events(ts, event, path, dest, is_dir)``: move, delete, scan (of a folder that came) and change.

    A move out of sight is a deletion, one into sight a change or a scan of what came; events of
    ignored paths, and changes of folders, are nothing.
    """
    seen, came = ~ignored(F.col("path")), F.col("dest").isNotNull() & ~ignored(F.col("dest"))
    moved, folder = F.col("event") == "moved", F.col("is_dir")
    op = (F.when(moved & seen & came, "move").when(moved & seen, "delete").when(moved & came, F.when(folder, "scan").otherwise("change")).when(moved | ~seen, None)
          .when(F.col("event") == "deleted", "delete").when(folder & (F.col("event") == "created"), "scan").when(~folder, "change"))
    path = F.when(moved & ~seen, F.col("dest")).otherwise(F.col("path"))
    return events.withColumn("op", op).withColumn("at", path).filter("op is not null").select(
        *[c for c in events.columns if c not in ("path", "dest", "event", "is_dir")], "op", F.col("at").alias("path"), F.when(F.col("op") == "move", F.col("dest")).alias("dest"))


def quiet_changes(changes: DataFrame, quiet: str = QUIET) -> DataFrame:
    """``path, since, n, size, mtime, stable`` of each burst of ``changes(ts, path, size, mtime)`` once no more come for ``quiet``: what was seen last, and whether the last two looks agree."""
    looks = F.array_sort(F.collect_list(F.struct("ts", "size", "mtime")))
    bursts = changes.groupBy(F.session_window("ts", quiet).alias("w"), "path").agg(F.count("*").alias("n"), looks.alias("looks"))
    last, before = F.element_at("looks", -1), F.try_element_at("looks", F.lit(-2))
    same = F.coalesce((last["size"] == before["size"]) & (last["mtime"] == before["mtime"]), F.lit(False))
    return bursts.select("path", F.col("w.start").alias("since"), "n", last["size"].alias("size"), last["mtime"].alias("mtime"), same.alias("stable"))


def apply_operations(files: DataFrame, ops: DataFrame) -> DataFrame:
    """``files(path, size, mtime)`` after a batch of ``operations``, with ``size`` and ``mtime`` of changed files: first moves, then deletions, then changes.

    A move or deletion of a folder takes what is below it; of several moves the one of the
    deepest folder counts, and what moves onto a file replaces it. A file that is deleted and changed in one batch was saved anew and
    stays; a file moved to a kind that isn't known goes. What was moved without being there
    counts as changed under its new name.
    """
    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("old"))
    moves = ops.filter("op = 'move'").groupBy(F.col("path").alias("old")).agg(F.max_by("dest", "ts").alias("new"))
    hit = up.join(moves, "old").groupBy("path").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("m"))
    target = F.concat(F.col("m.new"), F.expr("substring(path, length(m.old) + 1)"))
    placed = files.join(hit, "path", "left").select(F.coalesce(target, F.col("path")).alias("path"), "size", "mtime", F.col("m").isNotNull().alias("moved"))
    # what moves onto a file replaces it
    placed = placed.filter(~F.col("moved") | known(F.col("path"))).groupBy("path").agg(F.max_by(F.struct("size", "mtime"), F.struct("moved", "mtime", "size")).alias("x")).select("path", "x.*")
    changed = ops.filter("op = 'change'").groupBy("path").agg(F.max_by(F.struct("size", "mtime"), "ts").alias("s")).select("path", "s.*")
    lost = moves.join(hit.select(F.col("m.old").alias("old")).distinct(), "old", "left_anti").select(F.col("new").alias("path"))
    fresh = lost.join(changed, "path", "left_anti").join(placed.select("path"), "path", "left_anti").select("path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("mtime"))
    changed = changed.unionByName(fresh).filter(known(F.col("path")))
    gone = ops.filter("op = 'delete'").select(F.col("path").alias("up")).distinct()
    below = placed.select("path", F.explode(ancestors(F.col("path"))).alias("up")).join(gone, "up", "left_semi").select("path").distinct()
    return placed.join(below, "path", "left_anti").join(changed, "path", "left_anti").unionByName(changed)


def known(path: Column) -> Column:
    """Whether a file's extension is of a known kind."""
    return kind_of(F.regexp_extract(path, r"\.([^./]+)$", 1)) != "unsupported"


def follow(events: DataFrame, folder: str) -> DataFrame:
    """Run a stream of events to its present end, and give the table of files as it is then.

    Each micro-batch writes the whole table under its number and reads that of the batch before,
    so a batch that runs again after a failure writes the same once more; a later call with the
    same ``folder`` goes on from the checkpoint there. Older tables may be removed at any time
    but the last two.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = _table(spark, f"{folder}/files-{number - 1}") if number else spark.createDataFrame([], FILES)
        after = apply_operations(before, operations(batch))
        after.select("path", "size", "mtime").write.mode("overwrite").parquet(f"{folder}/files-{number}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/last")

    events.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return _table(spark, f"{folder}/files-{spark.read.parquet(f'{folder}/last').first()[0]}")


FILES = "path string, size long, mtime double"


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def claim(queue: DataFrame, worker: str, n: int, most: int = 3) -> DataFrame:
    """``queue(id, priority, size, status, attempts, worker)`` with the ``n`` first queued rows, by priority and then the smaller size, claimed by a worker."""
    picked = queue.filter((F.col("status") == "queued") & (F.col("attempts") < most)).orderBy(F.desc("priority"), "size", "id").limit(n).select("id", F.lit(True).alias("mine"))
    mine = F.col("mine").isNotNull()
    return queue.join(picked, "id", "left").select(
        "id", "priority", "size", F.when(mine, "processing").otherwise(F.col("status")).alias("status"), (F.col("attempts") + mine.cast("int")).alias("attempts"), F.when(mine, worker).otherwise(F.col("worker")).alias("worker"))


def finish(queue: DataFrame, results: DataFrame, most: int = 3) -> DataFrame:
    """The queue after ``results(id, worker, ok)``: done, or queued again until ``most`` attempts have failed; a result counts only while its worker holds the row."""
    held = queue.join(results.withColumnRenamed("worker", "by"), "id", "left")
    counts = (F.col("status") == "processing") & (F.col("by") == F.col("worker"))
    status = F.when(counts & F.col("ok"), "done").when(counts & (F.col("attempts") >= most), "failed").when(counts, "queued").otherwise(F.col("status"))
    return held.select("id", "priority", "size", status.alias("status"), "attempts", F.when(counts, None).otherwise(F.col("worker")).alias("worker"))


def failures(events: DataFrame, key: str, failed: Column, minutes: int = 15, most: int = 10) -> DataFrame:
    """Events at which a key has failed ``most`` times or more within the last ``minutes``: a sliding range, counted at each event."""
    back = Window.partitionBy(key).orderBy(F.unix_micros("ts")).rangeBetween(-minutes * 60_000_000, 0)
    return events.withColumn("n_failed", F.count_if(failed).over(back)).filter(F.col("n_failed") >= most)
