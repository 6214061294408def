"""A table of files as a log: base files by path bucket, change files for each batch, merged when read and compacted by bucket.

A batch writes only the rows it changes, then a manifest that names the files of every bucket. The
manifest is the commit: what was written before it counts for nothing until it stands, and it says
which batch of a stream it includes, so a batch that runs again changes nothing. Files that
neither the last manifest nor the one before names are removed, so readers of the table as it was
a commit ago can end.
"""

from __future__ import annotations

import copy
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.facets import ancestors
from ..session import remove_folder, settle
from .files import FILES, apply_operations, operations

_CHANGES = f"{FILES}, gone boolean"
_MANIFEST = "bucket int, base string, rows long, changes array<string>, changed long, batch long"


@dataclass
class _Bucket:
    base: str | None = None
    rows: int = 0
    changes: list[str] = field(default_factory=list)
    changed: int = 0


class FileLog:
    """The log in ``folder``; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, least: int = 1_000):
        self.spark, self.folder, self.least = spark, folder.rstrip("/"), least
        self.buckets = buckets
        self._number, self.batch, self._state = self._last()
        if self._state:
            self.buckets = len(self._state)  # a log keeps the buckets it began with
        else:
            self._state = {b: _Bucket() for b in range(buckets)}

    def _names(self) -> list[str]:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(there)] if system.exists(there) else []

    def _complete(self, name: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def _manifest(self, number: int) -> tuple[int, dict[int, _Bucket]]:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest-{number}").collect()  # a row a bucket
        return rows[0]["batch"], {r["bucket"]: _Bucket(r["base"], r["rows"], list(r["changes"]), r["changed"]) for r in rows}

    def _last(self) -> tuple[int, int, dict[int, _Bucket]]:
        numbers = sorted((int(n.split("-")[1]) for n in self._names() if n.startswith("manifest-")), reverse=True)
        for n in numbers:
            if self._complete(f"manifest-{n}"):
                return n, *self._manifest(n)
        return 0, -1, {}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """``path, size, mtime`` of the files as they are now (of some buckets alone): of a path's rows the last commit's counts."""
        some = {b: s for b, s in self._state.items() if only is None or b in only}
        bases = [f"{self.folder}/{s.base}/bucket={b}" for b, s in some.items() if s.base]
        base = self.spark.read.schema(FILES).parquet(*bases) if bases else self.spark.createDataFrame([], FILES)
        order = list(dict.fromkeys(c for s in some.values() for c in s.changes))
        if not order:
            return base
        # changes of one commit lie in one folder; the number in its name orders them
        paths = [f"{self.folder}/{c}/bucket={b}" for b, s in some.items() for c in s.changes]
        place = F.regexp_extract(F.input_file_name(), r"/changes-(\d+)-", 1).cast("long")
        changes = self.spark.read.schema(_CHANGES).parquet(*paths).withColumn("place", place)
        rows = base.select("*", F.lit(False).alias("gone"), F.lit(-1).cast("long").alias("place")).unionByName(changes)
        last = rows.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "gone"), "place").alias("x"))
        return last.filter("not x.gone").select("path", "x.size", "x.mtime")

    def _commit(self, changes: DataFrame, batch: int) -> None:
        """Write ``changes(path, size, mtime, gone)`` (a row a path), compact buckets with many, and commit; a failure before the commit leaves the log as it was."""
        before = copy.deepcopy(self._state)
        try:
            self._write(changes, self._number + 1, batch)
        except BaseException:
            self._state = before
            raise
        self._number, self.batch = self._number + 1, batch
        self._sweep()

    def _write(self, changes: DataFrame, number: int, batch: int) -> None:
        name = f"changes-{number}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        changes.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        if any(n.startswith("bucket=") for n in self._list(name)):
            counts = self.spark.read.parquet(f"{self.folder}/{name}").groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row a bucket
        else:
            counts = []
        for r in counts:
            state = self._state[r["bucket"]]
            state.changes.append(name)
            state.changed += r["n"]
        many = [b for b, s in self._state.items() if s.changed > max(self.least, s.rows // 4)]
        if many:
            self._compact(many, number)
        rows = [(b, s.base, s.rows, s.changes, s.changed, batch) for b, s in self._state.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest-{number}")

    def _list(self, name: str) -> list[str]:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return [f.getPath().getName() for f in there.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(there)]

    def _compact(self, many: list[int], number: int) -> None:
        """New base files of the buckets ``many``, in order of path; other buckets keep theirs."""
        name = f"base-{number}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        laid = self.read(many).withColumn("bucket", bucket).repartitionByRange("bucket", "path").sortWithinPartitions("bucket", "path")
        laid.write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        held = {}
        if any(n.startswith("bucket=") for n in self._list(name)):
            held = {r["bucket"]: r["n"] for r in self.spark.read.parquet(f"{self.folder}/{name}").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        for b in many:
            self._state[b] = _Bucket(name if b in held else None, held.get(b, 0))

    def _sweep(self) -> None:
        """Remove what neither this commit nor the one before names, and what never was committed."""
        used = {f"manifest-{self._number}", f"manifest-{self._number - 1}", "state"}
        states = [self._state]
        if f"manifest-{self._number - 1}" in self._names():
            states.append(self._manifest(self._number - 1)[1])
        for state in states:
            for s in state.values():
                used |= {s.base, *s.changes}
        for name in self._names():
            if name not in used and name.split("-")[0] in ("manifest", "changes", "base"):
                remove_folder(self.spark, f"{self.folder}/{name}")

    def apply(self, ops: DataFrame, batch: int) -> None:
        """Apply a batch of ``operations``; one that the log includes already changes nothing.

        Files that are only changed are written without reading the table. For moves and
        deletions the files below their folders are read, and those at names that a move gives.
        """
        if batch <= self.batch:
            return
        ops = settle(ops.select("ts", "op", "path", "dest", "size", "mtime"))
        struck = ops.filter("op <> 'change'")
        if struck.isEmpty():
            before = self.spark.createDataFrame([], FILES)
        else:
            roots = struck.select(F.col("path").alias("up")).distinct()
            table = self.read()
            below = table.select("path", F.explode(ancestors(F.col("path"))).alias("up")).join(roots, "up", "left_semi").select("path").distinct()
            given = struck.filter("dest is not null").select(F.col("dest").alias("path")).distinct()
            before = settle(table.join(below.union(given).distinct(), "path", "left_semi"))
        after = settle(apply_operations(before, ops))
        gone = before.join(after, "path", "left_anti").withColumn("gone", F.lit(True))
        # rows that stayed as they were are no change
        kept = after.join(before.withColumnRenamed("size", "s").withColumnRenamed("mtime", "m").withColumn("was", F.lit(True)), "path", "left")
        new = kept.filter("was is null or not (size <=> s) or not (mtime <=> m)").select("path", "size", "mtime", F.lit(False).alias("gone"))
        self._commit(new.unionByName(gone), batch)

    def reconcile(self, found: DataFrame, under: str = "", unreadable: list[str] | None = None) -> dict[str, int]:
        """Make the files below ``under`` those of ``found(path, size, mtime)``, a scan; counts of what differed: added, changed, gone.

        The scan is the truth: it repairs what events missed or came too late for. A time that
        differs by less than a second is no change. What a scan could not see is not gone: files
        below an ``unreadable`` folder stay, and all do where the scan found nothing. A path that
        the scan gives more than once has its last time.
        """
        scope = F.lit(True) if not under else (F.col("path") == under) | F.col("path").startswith(under.rstrip("/") + "/")
        unseen = F.lit(found.filter(scope).isEmpty())
        for folder in unreadable or ():
            unseen = unseen | F.col("path").startswith(folder.rstrip("/") + "/")
        seen = found.filter(scope & F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("x")).select("path", F.col("x.size").alias("s"), F.col("x.mtime").alias("m"), F.lit(True).alias("seen"))
        both = self.read().filter(scope).withColumn("held", F.lit(True)).join(seen, "path", "full")
        differs = ~F.col("size").eqNullSafe(F.col("s")) | F.coalesce(F.abs(F.col("mtime") - F.col("m")) >= 1, F.col("mtime").isNull() != F.col("m").isNull())
        kind = F.when(F.col("held").isNull(), "added").when(F.col("seen").isNull() & ~unseen, "gone").when(F.col("seen") & differs, "changed")
        diff = settle(both.withColumn("kind", kind).filter("kind is not null").select("path", F.col("s").alias("size"), F.col("m").alias("mtime"), (F.col("kind") == "gone").alias("gone"), "kind"))
        counts = {r["kind"]: r["count"] for r in diff.groupBy("kind").count().collect()}
        if counts:
            self._commit(diff.drop("kind"), self.batch)
        return {k: counts.get(k, 0) for k in ("added", "changed", "gone")}


def follow(events: DataFrame, folder: str, buckets: int = 16, least: int = 1_000) -> FileLog:
    """Run a stream of events to its present end into the log in ``folder``; a later call goes on from the checkpoint there."""
    log = FileLog(events.sparkSession, folder, buckets, least)
    query = events.writeStream.foreachBatch(lambda batch, number: log.apply(operations(batch), number)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return log
