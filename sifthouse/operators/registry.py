"""The table of sources and what hangs on it: registering files, listing them in pages, samples, corrections of people, and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import kind_of

# How long a file's time may differ without a change, in seconds.
SAME_TIME = 1.0
# End of fixed values.


def register(sources: DataFrame, found: DataFrame, excluded: Column | None = None) -> DataFrame:
    """``sources(rel_path, name, ext, kind, size, mtime, status, priority, attempts, fingerprint)`` after files ``found(rel_path, size, mtime, priority, fingerprint)`` were seen.

    A file of an unknown kind, or with ``excluded`` (over ``rel_path``), is passed over. A new
    file is queued; one whose size or time changed, or that was missing, is queued again with the
    greater of both priorities, its attempts forgotten; any other stays. Of a path found more
    than once the last time counts, of a path registered more than once every row.
    """
    name = F.regexp_extract(F.translate("rel_path", "\\", "/"), r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    seen = found.filter(F.col("rel_path").isNotNull() & (kind_of(ext) != "unsupported"))
    if excluded is not None:
        seen = seen.filter(~excluded)
    seen = seen.groupBy("rel_path").agg(F.max_by(F.struct("size", "mtime", "priority", "fingerprint"), F.struct("mtime", "size")).alias("n")).withColumn("come", F.lit(True))
    both = sources.withColumn("held", F.lit(True)).join(seen, "rel_path", "full")
    same = F.col("size").eqNullSafe(F.col("n.size")) & (F.abs(F.col("mtime") - F.col("n.mtime")) < SAME_TIME) & (F.col("status") != "missing")
    takes = F.col("come").isNotNull() & ~(F.col("held").isNotNull() & F.coalesce(same, F.lit(False)))
    new = lambda column, value: F.when(takes, value).otherwise(F.col(column)).alias(column)
    made = lambda column, value: F.coalesce(F.col(column), value).alias(column)
    return both.select(
        "rel_path", made("name", name), made("ext", ext), made("kind", kind_of(ext)), new("size", F.col("n.size")), new("mtime", F.col("n.mtime")), new("status", F.lit("queued")),
        new("priority", F.greatest("priority", F.col("n.priority"))), new("attempts", F.lit(0)), new("fingerprint", F.col("n.fingerprint")))


def listing(sources: DataFrame, order: list[Column], offset: int = 0, limit: int = 50, text: str = "", names: tuple[str, ...] = ("name", "rel_path"), **equal: str) -> tuple[DataFrame, int]:
    """A page of the sources whose columns are ``equal`` to what is asked and that hold ``text`` in one of their ``names``, in any letter case, and how many there are in all."""
    for column, value in equal.items():
        sources = sources.filter(F.col(column) == value)
    if text:
        inside = F.lit(False)
        for n in names:
            inside = inside | F.coalesce(F.lower(F.col(n)).contains(text.lower()), F.lit(False))
        sources = sources.filter(inside)
    return sources.orderBy(*order).offset(offset).limit(limit), sources.count()


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, or all where there are fewer, drawn by a hash of their keys: the same for every order and partitioning of the rows."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def assign(faces: DataFrame, decisions: DataFrame, people: DataFrame) -> DataFrame:
    """``faces(id, person_id, person_locked)`` after ``decisions(id, person_id, at)``: each face belongs to the person decided last, or to nobody, and is locked there.

    Decisions for people that ``people(person_id)`` doesn't have are passed over.
    """
    fine = decisions.join(people.select("person_id", F.lit(True).alias("known")), "person_id", "left").filter("person_id is null or known")
    last = fine.groupBy("id").agg(F.max_by(F.struct("person_id"), "at").alias("d"))
    return faces.join(last, "id", "left").select("id", F.when(F.col("d").isNotNull(), F.col("d.person_id")).otherwise(F.col("person_id")).alias("person_id"), (F.col("person_locked") | F.col("d").isNotNull()).alias("person_locked"))


def merge(faces: DataFrame, people: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``faces`` and ``people(person_id, name)`` after ``pairs(source, target)`` were found to be one person each.

    Faces of the source go to the target, and those of both are locked, so that a later grouping
    parts them no more. A target without a name takes the source's; the source is gone. Pairs of
    one person, or with a target that isn't there, are passed over; targets are no sources.
    """
    ids = people.select(F.col("person_id").alias("target"))
    fine = pairs.filter("source <> target").join(ids, "target", "left_semi").groupBy("source").agg(F.min("target").alias("target"))
    ends = fine.select(F.col("source").alias("person_id"), "target").union(fine.select(F.col("target").alias("person_id"), "target").distinct())
    moved = faces.join(ends, "person_id", "left").select("id", F.coalesce("target", "person_id").alias("person_id"), (F.col("person_locked") | F.col("target").isNotNull()).alias("person_locked"))
    given = fine.join(people.select(F.col("person_id").alias("source"), "name"), "source").filter("name <> ''").groupBy(F.col("target").alias("person_id")).agg(F.min_by("name", "source").alias("given"))
    left = people.join(fine.select(F.col("source").alias("person_id")), "person_id", "left_anti").join(given, "person_id", "left")
    return moved, left.select("person_id", F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.col("given")).otherwise(F.col("name")).alias("name"))


def job_key(session: Column, files: Column) -> Column:
    """The name of a job: its session and its files, structs of library and source, in their order."""
    return F.concat(session, F.lit(":"), F.array_join(F.transform(files, lambda f: F.concat_ws("/", *(f[i] for i in ("library_id", "source_id")))), ","))


def shared_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``request, job, created`` of ``requests(request, key, user, at, force)``: one for the same files and user shares the job there is.

    ``jobs(job, key, user, status, cancelled, at)``: of those that weren't cancelled or failed the
    first counts; ``force`` shares only a job that has not ended. Requests for what no job does
    make one, the first of them, and the others share it.
    """
    live = jobs.filter(~F.col("cancelled") & ~F.col("status").isin("error", "cancelled"))
    by = ["key", "user"]
    any_ = live.groupBy(*by).agg(F.min_by("job", F.struct("at", "job")).alias("old"), F.min_by("job", F.when(F.col("status").isin("queued", "running"), F.struct("at", "job"))).alias("going"))
    asked = requests.join(any_, by, "left").withColumn("found", F.when(F.col("force"), F.col("going")).otherwise(F.col("old")))
    first = asked.filter("found is null").groupBy(*by).agg(F.min_by("request", F.struct("at", "request")).alias("first"))
    return asked.join(first, by, "left").select("request", F.coalesce("found", F.concat(F.lit("job-"), F.col("first").cast("string"))).alias("job"), (F.col("found").isNull() & (F.col("request") == F.col("first"))).alias("created"))
