"""An index of names: their trigrams in sorted files for substrings, and the names in order for beginnings.

A name holds a term only if it holds all its trigrams, so the candidates are the names of the
term's rarest ones; each candidate is verified once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Of a term's trigrams, how many of the rarest the candidates must hold.
RAREST = 2


def build(rows: DataFrame, path: str, key: str, name: str) -> None:
    """Write the index of ``rows`` to ``path``: ``names(key, name)`` in order of the lower-cased name, and ``grams(gram, key)`` in order of the gram.

    Keys are unique; rows without a key or name are left out. A gram that very many names hold
    is split over files, as these are ranges of gram and key.
    """
    low = rows.filter(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(name)).alias("name"))
    low.repartitionByRange("name", "key").sortWithinPartitions("name", "key").write.parquet(f"{path}/names")
    every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substr(F.col("name"), i, F.lit(3))))
    grams = low.filter(F.length("name") >= 3).select("key", F.explode(every).alias("gram"))
    grams.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(f"{path}/grams")


def _grams(term: str) -> list[str]:
    return sorted({term[i : i + 3] for i in range(len(term) - 2)})


class NameIndex:
    """The index at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.names, self.grams = spark.read.parquet(f"{path}/names"), spark.read.parquet(f"{path}/grams")

    def _candidates(self, terms: list[str]) -> DataFrame:
        """Keys of names that may hold any of ``terms``: for each its rarest trigrams, all of them."""
        asked = sorted({g for t in terms for g in _grams(t)})
        often = {r["gram"]: r["n"] for r in self.grams.filter(F.col("gram").isin(asked)).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row a trigram of the query
        parts = []
        for t in terms:
            rare = sorted(_grams(t), key=lambda g: (often.get(g, 0), g))[:RAREST]
            if all(often.get(g) for g in rare):
                held = self.grams.filter(F.col("gram").isin(rare))
                parts.append(held.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("key") if len(rare) > 1 else held.select("key"))
        if not parts:
            return self.grams.select("key").limit(0)
        return reduce(lambda a, b: a.union(b), parts).distinct()

    def search(self, terms: list[str], limit: int = 50) -> DataFrame:
        """``key, score``: the share of ``terms`` (of three characters or more) that a name holds anywhere, as ``retrieval.name_search`` gives it over all names."""
        used = [t.lower() for t in terms if len(t) >= 3]
        if not used:
            return self.names.select("key", F.lit(0.0).alias("score")).limit(0)
        share = reduce(lambda a, b: a + b, (F.when(F.col("name").contains(t), 1).otherwise(0) for t in used)) / float(len(used))
        found = self.names.join(self._candidates(list(dict.fromkeys(used))), "key", "left_semi").select("key", share.alias("score"))
        return found.filter("score > 0").orderBy(F.desc("score"), "key").limit(limit)

    def containing(self, term: str) -> DataFrame:
        """``key, name`` of all names that hold ``term`` (``LIKE '%term%'`` without case); a term under three characters is looked for in every name."""
        low = term.lower()
        names = self.names if len(low) < 3 else self.names.join(self._candidates([low]), "key", "left_semi")
        return names.filter(F.col("name").contains(low)).select("key", "name")

    def starting(self, beginning: str) -> DataFrame:
        """``key, name`` of all names that begin with ``beginning`` (``LIKE 'x%'`` without case): the filter leaves one range of the sorted files."""
        return self.names.filter(F.col("name").startswith(beginning.lower())).select("key", "name")
