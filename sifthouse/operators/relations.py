"""Joins, set operations and upkeep of the index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .ranks import numbered, running_sum


#: Starts of a block that an interval is copied to.
STARTS = 512


def _starts_within(left: DataFrame, right: DataFrame, key: str, after: bool) -> DataFrame:
    """``left`` and ``right`` rows (``_l``, ``_r``) where the right one's ``start`` lies in the left interval, at its own start only if not ``after``.

    All starts of a key are ranked in one order with the left intervals' ends; so an interval
    knows the first and the last rank in it, and is copied to the blocks of ``STARTS`` ranks between
    these: every block but two gives that many pairs, and an interval without any goes.
    """
    point = lambda rows, at, turn, one, idx: rows.select(F.col("key"), F.col(at).alias("at"), F.lit(turn).alias("turn"), F.lit(one).alias("one"), F.col(idx).alias("id"))
    begin = 2 if after else 0
    points = point(right, "start", 1, 1, "id").unionByName(point(left, "start", begin, 0, "id")).unionByName(point(left, "end", 3, 0, "id"))
    counted = settle(running_sum(points, ["key"], [F.col("at"), F.col("turn"), F.col("id")], "one", "rank"))
    spans = counted.filter("one = 0").groupBy("id").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).filter("high > low")
    asked = left.join(spans, "id").withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / STARTS), F.floor((F.col("high") - 1) / STARTS))))
    ranked = right.join(counted.filter("one = 1").select("id", "rank"), "id").withColumn("block", F.floor((F.col("rank") - 1) / STARTS))
    met = asked.select("key", "block", "low", "high", F.col("row").alias("_l")).join(ranked.select("key", "block", "rank", F.col("row").alias("_r")), ["key", "block"])
    return met.filter("rank > low and rank <= high").select("_l", "_r")


def interval_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of equal ``key`` whose closed intervals ``[ls, le]`` and ``[rs, re]`` meet, each pair once.

    Of two intervals that meet, one holds the start of the other. Both cases are found by the
    ranks of the starts, over keys of any size and intervals of any length; work and copies are
    in proportion to rows and pairs. Rows with a null key or bound, and intervals that end
    before they start, meet nothing.
    """
    def tidy(rows: DataFrame, start: str, end: str) -> DataFrame:
        fine = rows.filter(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))
        return settle(fine.select(F.col(key).alias("key"), F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"), F.struct(*(F.col(c) for c in rows.columns)).alias("row"), F.monotonically_increasing_id().alias("id")))

    a, b = tidy(left, "ls", "le"), tidy(right, "rs", "re")
    one, other = _starts_within(a, b, key, False), _starts_within(b, a, key, True)
    both = one.unionByName(other.select(F.col("_r").alias("_l"), F.col("_l").alias("_r")))
    return both.select(*(F.col(f"_l.{c}").alias(c) for c in left.columns), *(F.col(f"_r.{c}").alias(c) for c in right.columns if c != key))


def under_scopes(rows: DataFrame, folder: str, scopes: list[str]) -> DataFrame:
    """Rows in one of the folders or below; the scopes come from one query."""
    inside = F.lit(False)
    for s in scopes:
        inside = inside | (F.col(folder) == s) | F.col(folder).startswith(s + "/")
    return rows.filter(inside)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, unreadable: list[str] | None = None) -> DataFrame:
    """``key, change, renamed_from`` between ``(key, size, mtime, fingerprint)`` snapshots: new, changed, unchanged, renamed, removed, missing.

    A removed and a new row of equal size and fingerprint are a renaming, one to one in key order.
    What is gone below an ``unreadable`` folder is missing and nothing else, and so is everything
    where ``new`` is empty but ``old`` isn't: a root that vanished removes nothing. Sizes, times and
    fingerprints may be null: presence is a mark of its own.
    """
    fields = lambda d, s: d.select(F.col(key).alias("k"), F.col("size").alias(f"size_{s}"), F.col("mtime").alias(f"mtime_{s}"), F.col("fingerprint").alias(f"fp_{s}"), F.lit(True).alias(f"in_{s}"))
    both = fields(old, "o").join(fields(new, "n"), "k", "full_outer")
    moved = ~F.col("size_o").eqNullSafe(F.col("size_n")) | F.coalesce(F.abs(F.col("mtime_o") - F.col("mtime_n")) >= 1, F.col("mtime_o").isNull() != F.col("mtime_n").isNull())
    lost = F.lit(new.isEmpty())
    for folder in unreadable or ():
        lost = lost | F.col("k").cast("string").startswith(folder.rstrip("/") + "/")
    state = F.when(F.col("in_o").isNull(), "new").when(F.col("in_n").isNull() & lost, "missing").when(F.col("in_n").isNull(), "removed").when(moved, "changed").otherwise("unchanged")
    both = both.withColumn("change", state)
    # a fingerprint that very many files share is numbered over ranges; what has none is no renaming
    ordered = lambda d, s: numbered(d.select("k", F.col(f"size_{s}").alias("size"), F.col(f"fp_{s}").alias("fp")).filter("size is not null and fp is not null"), ["size", "fp"], [F.col("k")]).select("k", "size", "fp", F.col("rn").alias("i"))
    gone, come = ordered(both.filter("change = 'removed'"), "o"), ordered(both.filter("change = 'new'"), "n")
    pairs = gone.withColumnRenamed("k", "was").join(come, ["size", "fp", "i"]).select("k", "was")
    taken = pairs.select(F.col("was").alias("k"), F.lit(True).alias("taken"))
    return (both.join(pairs, "k", "left").join(taken, "k", "left").filter("taken is null")
            .select(F.col("k").alias(key), F.when(F.col("was").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), F.col("was").alias("renamed_from")))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, changed: Column) -> DataFrame:
    """Existing rows, replaced by incoming ones where ``changed`` (over aliases ``e`` and ``i``) holds, and new rows; nulls are values as any others."""
    joined = existing.withColumn("here", F.lit(True)).alias("e").join(incoming.withColumn("here", F.lit(True)).alias("i"), key, "full_outer")
    had, comes = F.col("e.here").isNotNull(), F.col("i.here").isNotNull()
    take = comes & (~had | F.coalesce(changed, F.lit(True)))
    columns = [c for c in existing.columns if c != key]
    return joined.select(key, *(F.when(take, F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in columns),
                         F.when(~had, "inserted").when(take, "updated").otherwise("kept").alias("action"))


def keep_latest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")


def exact_aliases(rows: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """``key, canonical``: rows whose content an earlier key has; minima are combined before the shuffle, so no group is gathered."""
    marked = rows.select(key, fingerprint.alias("fp"))
    first = marked.groupBy("fp").agg(F.min(key).alias("canonical"))
    return marked.join(first, "fp").filter(F.col(key) != F.col("canonical")).select(key, "canonical")


def move_prefix(path: Column, old: str, new: str) -> Column:
    return F.when(path == old, F.lit(new)).when(path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1_000_000))).otherwise(path)


def even_sample(rows: DataFrame, by: list[str], order: list[Column], count: int) -> DataFrame:
    """``count`` rows of each group, evenly spread over its order: the places ``floor(i n / count)``."""
    held = numbered(rows, by, order)
    i = F.col("rn") - 1
    picked = F.floor(F.ceil(i * count / F.col("n")) * F.col("n") / count) == i
    return held.filter((F.col("n") <= count) | picked).drop("rn", "n")


def spread_picks(rows: DataFrame, by: list[str], order: list[Column], most: int = 3) -> DataFrame:
    """Every ``n / most``-th row of each group, ``most`` at most."""
    held = numbered(rows, by, order)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return held.filter((((F.col("rn") - 1) % step) == 0) & ((F.col("rn") - 1) / step < most)).drop("rn", "n")


def replace_kind(chunks: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Chunks ``(source_id, kind, ord, text)`` with those of a kind replaced by ``new(source_id, i, text)`` for its sources, numbered behind the ones that stay."""
    touched = new.select("source_id").distinct()
    stays = chunks.join(touched.withColumn("t", F.lit(True)), "source_id", "left").filter((F.col("kind") != kind) | F.col("t").isNull()).drop("t")
    last = stays.groupBy("source_id").agg(F.max("ord").alias("last"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("i"))
    added = new.withColumn("p", place).join(last, "source_id", "left").select("source_id", F.lit(kind).alias("kind"), (F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("p") - 1).cast("int").alias("ord"), "text")
    return stays.select("source_id", "kind", F.col("ord").cast("int").alias("ord"), "text").unionByName(added)


def purge(derived: DataFrame, sources: DataFrame) -> DataFrame:
    """Derived rows without those of ``sources(source_id)``."""
    return derived.join(sources.select("source_id").distinct(), "source_id", "left_anti")


def remove_under(sources: DataFrame, path: Column, prefix: str) -> DataFrame:
    """Sources that aren't the file or folder ``prefix`` nor below it."""
    return sources.filter(~((path == prefix) | path.startswith(prefix.rstrip("/") + "/")))


def recovered(status: Column, attempts: Column, most: int = 3) -> Column:
    """What was being worked on when the process ended goes back to the queue, or has failed after ``most`` attempts."""
    return F.when((status == "processing") & (attempts < most), "queued").when(status == "processing", "failed").when(status == "running", "pending").otherwise(status)


def next_status(status: Column, event: Column) -> Column:
    """Of a pass over a file: pending, running, and done or failed; any other event leaves it."""
    return (F.when((status == "pending") & (event == "claim"), "running").when((status == "running") & (event == "finish"), "done")
            .when((status == "running") & (event == "fail"), "failed").when((status == "failed") & (event == "retry"), "pending").otherwise(status))


def unique_names(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Rows with their names made unique: the first of equal ones stays, later ones get a number before the extension."""
    held = numbered(rows, [name], order)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    numbered_ = F.concat(stem, F.lit(" ("), (F.col("rn") - 1).cast("string"), F.lit(")"), ext)
    return held.withColumn(name, F.when(F.col("rn") == 1, F.col(name)).otherwise(numbered_)).drop("rn", "n")


def already_there(uploads: DataFrame, files: DataFrame, apart: float = 2.0) -> DataFrame:
    """Uploads of which a file of the same ``name`` and ``size`` is there whose ``mtime`` is less than ``apart`` seconds away; joined by slots of that width."""
    slot = F.floor(F.col("mtime") / apart)
    near = files.select("name", "size", F.col("mtime").alias("there"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    held = uploads.withColumn("slot", slot)
    same = [held[c] == near[c] for c in ("name", "size", "slot")]
    return held.join(near, [*same, F.abs(held["mtime"] - near["there"]) < apart], "left_semi").drop("slot")


def with_parent(signals: DataFrame, sources: DataFrame) -> DataFrame:
    """Signals of parts of files with their file's columns; ids are the same with and without ``src-`` before them."""
    bare = F.regexp_replace("source_id", "^src-", "")
    return signals.withColumn("source_id", bare).join(sources.withColumn("source_id", bare), "source_id", "left")


def linked_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, change`` of files that are linked one by one: one that isn't found is missing, and none is new, renamed or removed."""
    found = snapshot_diff(old, new.join(old.select(key), key, "left_semi"), key)
    return found.select(key, F.when(F.col("change") == "removed", "missing").otherwise(F.col("change")).alias("change"))


def find_source(sources: DataFrame, locator: str) -> DataFrame:
    """Sources by an id, with or without ``src-`` before it, or by their path."""
    return sources.filter((F.col("source_id") == locator.removeprefix("src-")) | (F.col("rel_path") == locator))
