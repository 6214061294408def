"""Dashboard aggregates: tallies, histograms, bins, rollups and cross-filtered facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def tally(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("label")).agg(F.count("*").alias("n"))


def tally_values(rows: DataFrame, values: Column) -> DataFrame:
    """A row counts each of its values once."""
    return rows.select(F.explode(F.array_distinct(values)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def score_bin(score: Column) -> Column:
    return F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(0.9999)) * 20) / 20


def filled_bins(rows: DataFrame, number: Column) -> DataFrame:
    """Counts by whole number with the empty ones between the least and the greatest."""
    counts = rows.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).filter("lo is not null")
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def filled_months(rows: DataFrame, ts: Column) -> DataFrame:
    counts = rows.filter(ts.isNotNull()).groupBy(F.date_trunc("month", ts).cast("date").alias("month")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).filter("lo is not null")
    every = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return every.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The first step whose bound exceeds the value."""
    out = None
    for bound, label in steps:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return out.otherwise(last)


def ancestors(path: Column) -> Column:
    """Every prefix of a ``/`` path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def folder_rollup(rows: DataFrame, folder: Column, size: Column) -> DataFrame:
    """Files and bytes of each folder with all below it; ancestors are exploded after a first grouping by folder."""
    first = rows.groupBy(folder.alias("f")).agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    return first.select(F.explode(ancestors(F.col("f"))).alias("folder"), "n", "size").groupBy("folder").agg(F.sum("n").alias("files"), F.sum("size").alias("bytes"))


def cross_filter(rows: DataFrame, facets: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``facet, label, n``: each facet ``(key, chosen)`` counts the rows that pass every other facet's choice; one scan, one grouping."""
    flagged = rows.select(*(k.cast("string").alias(f"k_{n}") for n, (k, _) in facets.items()), *(c.alias(f"c_{n}") for n, (_, c) in facets.items()))
    cells = []
    for name in facets:
        others = [F.col(f"c_{n}") for n in facets if n != name]
        cells.append(F.struct(F.lit(name).alias("facet"), F.col(f"k_{name}").alias("label"), reduce(lambda a, b: a & b, others, F.lit(True)).alias("counts")))
    return flagged.select(F.explode(F.array(*cells)).alias("x")).filter("x.counts").groupBy("x.facet", "x.label").agg(F.count("*").alias("n"))


def common_values(rows: DataFrame, values: Column) -> DataFrame:
    """``tally_values``, without values of one row where there are ten rows or more and any value has two."""
    held = tally_values(rows, values)
    limit = held.agg(F.max("n").alias("most")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("rows"))))  # one row each
    return held.crossJoin(F.broadcast(limit)).filter((F.col("n") >= 2) | (F.col("rows") < 10) | (F.col("most") < 2)).select("label", "n")


#: Bars of a time histogram that are filled up.
MOST_BARS = 240


def filled_dates(rows: DataFrame, ts: Column, unit: str) -> DataFrame:
    """Counts by ``year``, ``month`` or ``day``; empty years and months between the first and the last are there too, if that makes ``MOST_BARS`` at most."""
    counts = rows.filter(ts.isNotNull()).groupBy(F.date_trunc(unit, ts).cast("date").alias("day")).agg(F.count("*").alias("n"))
    if unit == "day":
        return counts
    span = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter("lo is not null")
    bars = F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))
    every = span.select(F.explode(F.when(F.size(bars) <= MOST_BARS, bars)).alias("day")).join(counts, "day", "left_anti")
    return counts.unionByName(every.withColumn("n", F.lit(0).cast("long")))


def orientation(width: Column, height: Column) -> Column:
    """Square within a twentieth of the longer side."""
    return F.when(width * 20 < height * 19, "portrait").when(height * 20 < width * 19, "landscape").otherwise("square")


def video_quality(width: Column, height: Column) -> Column:
    return ladder(-F.least(width, height), [(-1999, "4K"), (-999, "1080p"), (-699, "720p")], "lower")


def category_place(category: Column, order: list[str]) -> Column:
    """Where a category stands in a given order; others stand last."""
    place = F.array_position(F.array(*map(F.lit, order)), category)
    return F.when(place > 0, place).otherwise(len(order) + 1)
