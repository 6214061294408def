"""Sessions, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Whether the files of a query's shuffles go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", name: str = "sifthouse") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one (gone at exit) where a local run leaves that unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sifthouse-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        where = _own["dir"] = "file://" + path
    return where.rstrip("/")


_own: dict[str, str] = {}
#: Where settled tables stand.
_places: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def run_folder(spark: SparkSession) -> str:
    """The folder of this process's settled tables, which goes when it ends."""
    base = shared_dir(spark)
    if base not in _own:
        _own[base] = f"{base}/settled-{uuid.uuid4().hex}"

        def clear(path: str = _own[base]) -> None:
            with contextlib.suppress(Exception):  # the session may have ended before
                remove_folder(spark, path)

        atexit.register(clear)
    return _own[base]


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and read it back.

    That cuts the lineage and outlives lost executors. The table is Parquet: its columns take
    less room than checkpointed rows. Shuffles that led to it are needed no more once it is
    written, so their files go then. ``discard`` removes it when nothing will read it again,
    else it goes when the process ends.
    """
    spark, path = df.sparkSession, f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _places[table] = path
    relieve(spark)
    return table


def relieve(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown to over half of what it may take.

    A driver plans and tracks thousands of small tasks between two settled tables. What that
    leaves is garbage, but the heap grows over it to its limit and stays so; a collection gives
    the room back, and lets Spark's cleaner free the shuffles and broadcasts of plans that ended.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() * 2 > runtime.maxMemory():
        spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that no later job reads."""
    for table in tables:
        if path := _places.pop(table, None):
            remove_folder(table.sparkSession, path)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions")) or os.cpu_count() or 1
