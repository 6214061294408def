"""Row numbers and running sums within groups of any size.

A window over a group sorts all of it in one task. Here rows are dealt by ranges of group and
order, numbered within their range, and the counts (or sums) of the ranges before are added; those
are one narrow row for each group in a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle


def _ranged(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` in order, settled, with the range of each (``_range``) and its place in all ranges (``_place``)."""
    keys = [*(F.col(c) for c in by), *order]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settle(sorted_.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))


def _carried(ranged: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """Per group and range: the ``_first`` place in it, the ``_before`` of all earlier ranges, and the group's ``_total``."""
    sums = ranged.groupBy(*by, "_range").agg(F.min("_place").alias("_first"), amount.alias("_sum"))
    w = Window.partitionBy(*by)
    running = F.sum("_sum").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sums.select(*by, "_range", "_first", (running - F.col("_sum")).alias("_before"), F.sum("_sum").over(w).alias("_total"))


def numbered(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``rn`` (from 1, by a total ``order``) and ``n``, the rows of their group of ``by`` (not null)."""
    ranged = _ranged(rows, by, order)
    carried = _carried(ranged, by, F.count("*"))
    return (ranged.join(carried, [*by, "_range"]).withColumn("rn", F.col("_place") - F.col("_first") + F.col("_before") + 1)
            .withColumn("n", F.col("_total")).select(*rows.columns, "rn", "n"))


def running_sum(rows: DataFrame, by: list[str], order: list[Column], value: str, name: str = "total") -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each, within its group of ``by`` (not null)."""
    ranged = _ranged(rows, by, order)
    carried = _carried(ranged, by, F.coalesce(F.sum(value), F.lit(0)))
    here = F.sum(value).over(Window.partitionBy(*by, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("_here", here).join(carried, [*by, "_range"]).select(*rows.columns, (F.coalesce("_here", F.lit(0)) + F.col("_before")).alias(name))
