"""A keyword index: postings by term as a Parquet table, and ranked search that reads only its terms' blocks.

The documents of each append make a segment. A segment's documents are dealt into slices of about
``SLICE``; a row of the table is a block: the postings of one term in one slice, with its
greatest count and least document length. Rows are kept in folders by a hash of the term and
sorted by term and slice, so a reader's filter on terms leaves the row groups of those terms.

A search first reads the narrow columns of its terms' blocks, which bound the score that any
document of a slice can reach. It scores the most promising slices, and then only those whose
bound is not below the last place so far.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

from ..functions.text import tokens
from ..session import discard, settle
from .retrieval import K1, B

#: Documents of a slice, about, and folders that the terms are dealt into.
SLICE, BUCKETS = 1_024, 64
#: Characters of a slice, about, at most, and files of a folder.
SLICE_CHARS, PIECES = 1 << 23, 16
#: Slices that are scored first.
SEEDS = 32
#: Room between the places of two columns, so that no phrase runs from one into the next.
COLUMN = 1 << 40

_BLOCKS = "segment string, slice int, term string, n long, max_tf double, min_len double"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def append(docs: DataFrame, path: str, key: str, columns: dict[str, float], slice_rows: int = SLICE) -> str:
    """Add ``docs`` to the index at ``path`` as a segment, and give its name.

    ``columns`` are the text columns and the weights of their counts, the same in every segment.
    Keys are unique in the index; rows without one are left out. The segment's row of statistics
    is written last: a segment without it is not read, so a build that fails leaves the index as
    it was and can be run again. Texts are shuffled once, by slice; a slice, whose size is bounded,
    is inverted by sorting its words.
    """
    segment = uuid.uuid4().hex
    docs = docs.filter(F.col(key).isNotNull())
    texts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    one = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(map(F.length, texts), F.lit(0))), F.lit(0)).alias("chars")).first()
    slices = max(1, -(-one["n"] // slice_rows), -(-one["chars"] // SLICE_CHARS))
    number = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(slices)).cast("int")
    dealt = docs.select(F.col(key).alias("key"), number.alias("slice"), *(t.alias(f"t{at}") for at, t in enumerate(texts))).repartition("slice")
    said = dealt.select("key", "slice", *(tokens(F.col(f"t{at}")).alias(f"w{at}") for at in range(len(texts))))
    words = said.withColumn("len", sum((F.size(f"w{at}") for at in range(len(texts))), F.lit(0)).cast("double"))
    weights = list(map(float, columns.values()))
    kind = docs.schema[key].dataType.simpleString()
    blocks = words.groupBy("slice").applyInArrow(
        lambda table: _inverted(table, weights), f"slice int, term string, n long, max_tf double, min_len double, docs array<struct<key:{kind},len:double,tf:double,places:array<bigint>>>")
    where = f"{path}/segments/{segment}"
    # a bucket's slices go to several files, so that no frequent term is one task's
    laid = blocks.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod("slice", F.lit(PIECES))).sortWithinPartitions("bucket", "term", "slice")
    laid.write.partitionBy("bucket").parquet(f"{where}/blocks")
    words.select("key", "slice", "len").write.parquet(f"{where}/lengths")
    sums = docs.sparkSession.read.parquet(f"{where}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0.0)).alias("words"))
    sums.withColumn("segment", F.lit(segment)).coalesce(1).write.mode("append").parquet(f"{path}/stats")
    return segment


def _inverted(table: pa.Table, weights: list[float]) -> pa.Table:
    """The blocks of a slice: its documents' words in the order of word, document and place."""
    table = table.combine_chunks().sort_by("key").combine_chunks()
    terms, docs, places = [], [], []
    for at in range(len(weights)):
        words = table.column(f"w{at}").combine_chunks()
        often = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        terms.append(words.flatten())
        docs.append(np.repeat(np.arange(len(often)), often))
        places.append(np.arange(len(terms[-1])) - np.repeat(np.cumsum(often) - often, often) + at * COLUMN)
    coded = pa.chunked_array(terms, pa.string()).combine_chunks().dictionary_encode()
    code, doc, place = coded.indices.to_numpy(zero_copy_only=False), np.concatenate(docs), np.concatenate(places)
    order = np.lexsort((place, doc, code))
    code, doc, place = code[order], doc[order], place[order]
    first = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(doc, prepend=-1))
    counts = [np.add.reduceat(place // COLUMN == at, first, dtype=np.int64) if len(first) else np.zeros(0) for at in range(len(weights))]
    # as a scan of the texts weighs them, so that equal scores are equal here too
    tf = reduce(lambda a, b: a + b, (c * w for c, w in zip(counts, weights)))
    code, doc = code[first], doc[first]
    size = table.column("len").to_numpy()[doc]
    begin = np.flatnonzero(np.diff(code, prepend=-1))
    upto = lambda starts, end: pa.array(np.append(starts, end), pa.int32())
    listed = pa.ListArray.from_arrays(upto(first, len(place)), pa.array(place, pa.int64()))
    key = table.column("key").combine_chunks().take(pa.array(doc))
    posting = pa.StructArray.from_arrays([key, pa.array(size, pa.float64()), pa.array(tf, pa.float64()), listed], ["key", "len", "tf", "places"])
    return pa.table({
        "slice": pa.array(np.full(len(begin), table.column("slice")[0].as_py()), pa.int32()), "term": coded.dictionary.take(pa.array(code[begin])), "n": pa.array(np.diff(np.append(begin, len(code))), pa.int64()),
        "max_tf": pa.array(np.maximum.reduceat(tf, begin) if len(begin) else [], pa.float64()), "min_len": pa.array(np.minimum.reduceat(size, begin) if len(begin) else [], pa.float64()),
        "docs": pa.ListArray.from_arrays(upto(begin, len(code)), posting)})


def _earlier(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _weighted(places: str, weights: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda total, p: total + F.get(weights, F.floor(p / COLUMN).cast("int")))


class Index:
    """The segments of the index at ``path`` as they are now."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, float]):
        stats = spark.read.schema("n long, words double, segment string").parquet(f"{path}/stats").collect()  # a row a segment
        self.spark, self.path, self.columns = spark, path, columns
        self.segments = sorted(r["segment"] for r in stats)
        self.documents = sum(r["n"] for r in stats)
        self.average = sum(r["words"] for r in stats) / max(self.documents, 1) or 1.0

    def key_type(self) -> DataType:
        return self.spark.read.parquet(f"{self.path}/segments/{self.segments[0]}/lengths").schema["key"].dataType

    def blocks(self, words: list[str]) -> DataFrame:
        """The blocks of ``words``: the filters name their folders and terms, so only their row groups are read."""
        listed = F.col("term").isin(words) & F.col("bucket").isin(sorted({r[0] for r in self.spark.range(1).select(F.explode(F.array(*(_bucket(F.lit(w)) for w in words)))).collect()}))
        parts = (self.spark.read.parquet(f"{self.path}/segments/{s}/blocks").filter(listed).withColumn("segment", F.lit(s)) for s in self.segments)
        return reduce(lambda a, b: a.unionByName(b), parts)

    def phrase(self, words: list[str]) -> DataFrame:
        """Blocks of a phrase as those of a word: from the slices and documents that hold all its words, by their places."""
        distinct = list(dict.fromkeys(words))
        found = self.blocks(distinct).select("segment", "slice", "term", F.explode("docs").alias("d")).select("segment", "slice", "term", "d.*")
        held = found.groupBy("segment", "slice", "key").agg(F.max("len").alias("len"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at")).filter(F.size("at") == len(distinct))
        begins = reduce(F.array_intersect, (_earlier(F.element_at("at", F.lit(w)), i) for i, w in enumerate(words)))
        weights = F.array(*(F.lit(float(w)) for w in self.columns.values()))
        whole = held.withColumn("places", begins).filter(F.size("places") > 0).withColumn("tf", _weighted("places", weights))
        grouped = whole.groupBy("segment", "slice").agg(
            F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.collect_list(F.struct("key", "len", "tf")).alias("docs"))
        return grouped.withColumn("term", F.lit(" ".join(words)))


def bm25(index: Index, terms: list[str], key: str, limit: int = 200) -> DataFrame:
    """``key, score`` as ``retrieval.bm25`` gives them over all documents of the index: rows that hold all terms, filled up by rows with any where those are under a quarter of ``limit``."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    spark = index.spark
    if not index.documents:
        return spark.createDataFrame([], "key long, score double").withColumnRenamed("key", key)
    single, phrases = [t for t in terms if " " not in t], [t for t in terms if " " in t]
    narrow = lambda d: d.select(*(c.split(" ")[0] for c in _BLOCKS.split(", ")))
    docs = lambda d: d.select("segment", "slice", "term", F.col("docs.key").alias("k"), F.col("docs.len").alias("l"), F.col("docs.tf").alias("t"))
    made = [settle(index.phrase(p.split(" "))) for p in phrases]
    sources = [index.blocks(single)] * bool(single) + made
    meta = settle(reduce(lambda a, b: a.unionByName(b), map(narrow, sources)))
    held = {r["term"]: r["n"] for r in meta.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
    idf = {t: max(math.log((index.documents - held.get(t, 0) + 0.5) / (held.get(t, 0) + 0.5)), 1e-6) for t in terms}
    weight = F.element_at(F.create_map(*(x for t in terms for x in (F.lit(t), F.lit(idf[t])))), F.col("term"))
    # as a scan of the texts writes it, so that equal scores are equal here too
    part = lambda tf, size: weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / index.average))
    bound = F.sum(part(F.col("max_tf"), F.col("min_len")))
    slices = settle(meta.groupBy("segment", "slice").agg(bound.alias("bound"), (F.count("*") == len(terms)).alias("full"), F.min("n").alias("least")))

    def scored(of: DataFrame) -> DataFrame:
        rows = reduce(lambda a, b: a.unionByName(b), map(docs, sources)).join(of.select("segment", "slice"), ["segment", "slice"], "left_semi")
        each = rows.select("segment", "slice", "term", F.explode(F.arrays_zip("k", "l", "t")).alias("x")).select("segment", "slice", "term", "x.*")
        # terms are summed in their own order, as a scan of the texts sums them
        order = F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, terms)), F.col("term")).alias("j"), part(F.col("t"), F.col("l")).alias("s"))))
        summed = each.groupBy("segment", "slice", F.col("k").alias(key)).agg(order.alias("parts"))
        return summed.select(key, F.aggregate("parts.s", F.lit(0.0), lambda a, x: a + x).alias("score"), (F.size("parts") == len(terms)).alias("full"))

    enough = -(-limit // 4)
    everything = slices
    first = slices.orderBy(F.desc("full"), F.desc("bound"), "segment", "slice").limit(SEEDS)
    best = settle(scored(first))
    full = best.filter("full").limit(enough).count() >= limit / 4
    if not full:
        # the seeds don't settle it: all slices that hold every term are looked at, for documents with all of them
        rest = slices.filter("full").join(first.select("segment", "slice"), ["segment", "slice"], "left_anti")
        both = scored(rest).filter("full").limit(enough).count() + best.filter("full").count()
        full = both >= limit / 4
    if full:
        best, everything = best.filter("full"), slices.filter("full")
    last = best.orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
    least = last["s"] - 1e-9 if last["n"] == limit else -1.0
    more = everything.filter(F.col("bound") >= least).join(first.select("segment", "slice"), ["segment", "slice"], "left_anti")
    further = scored(more).filter("full") if full else scored(more)
    out = settle(best.unionByName(further).select(key, "score").orderBy(F.desc("score"), key).limit(limit))
    discard(meta, slices, *made)
    return out
