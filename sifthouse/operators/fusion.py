"""Fusing ranked lists: weights, file ranks, relevance and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import calibrated
from ..session import settle

# Weights of the retrievers in the fused score, those whose equal scores share a rank, and the constant of reciprocal ranks.
WEIGHTS = {
    "bm25": 1.0, "dense": 1.0, "transcript": 0.0, "extra": 0.8, "clip_text": 0.8, "clip_image": 1.3, "compose": 0.9, "face": 1.6, "dupe": 1.6,
    "name": 0.7, "sound": 1.3, "sound_audio": 1.5, "folder": 1.2, "folder_dense": 1.0, "folder_bm25": 0.8, "folder_clip": 1.0, "filter": 1.0,
}
TIED = ("folder", "filter")
RRF_K = 60
# End of fixed values.

#: Files that a list gives to the fusion, and those of lists with shared ranks.
MOST, MOST_TIED = 200, 5_000


def merge_max(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys).agg(F.max("score").alias("score"))


def file_ranks(hits: DataFrame, tied: bool = False, most: int | None = None) -> DataFrame:
    """``retriever, file, score, rank`` from 0 of the ``most`` best files of each retriever: the best hit of each file ranks it.

    Equal scores share a rank where ``tied``. Tasks cut their own lists to ``most`` before these
    are gathered, so no task holds a whole list.
    """
    best = merge_max(hits, ["retriever", "file"])
    place = F.row_number().over(Window.partitionBy("retriever").orderBy(F.desc("score"), "file"))
    top = best.withColumn("rank", place).filter(F.col("rank") <= (most or (MOST_TIED if tied else MOST)))
    if tied:
        return top.withColumn("rank", F.dense_rank().over(Window.partitionBy("retriever").orderBy(F.desc("score"))) - 1)
    return top.withColumn("rank", F.col("rank") - 1)


def transcript_list(hits: DataFrame, spoken: DataFrame) -> DataFrame:
    """``retriever, entity, score``: the chunks of speech (``spoken(entity)``) that the keyword and vector lists found, as a list of their own."""
    found = hits.filter(F.col("retriever").isin("dense", "bm25")).join(spoken.select("entity").distinct(), "entity", "left_semi")
    return found.groupBy("entity").agg(F.max("score").alias("score")).withColumn("retriever", F.lit("transcript"))


def weight_of(retriever: Column, weights: dict[str, float] | None = None) -> Column:
    out = F.lit(1.0)
    for name, w in (weights or WEIGHTS).items():
        out = F.when(retriever == name, w).otherwise(out)
    return out


def rrf(ranks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return ranks.groupBy("file").agg(F.sum(weight_of(F.col("retriever"), weights) / (RRF_K + F.col("rank") + 1)).alias("fused"), F.count("*").alias("n_lists"))


def relevance(rerank: Column, best_visual: Column, fused_norm: Column) -> Column:
    """With a rerank verdict, that blended with the fused score; without, the keyword formula; a better picture match wins."""
    judged = 0.7 * rerank + 0.3 * F.greatest(best_visual, fused_norm * 0.8 * F.least(F.lit(1.0), 4 * rerank))
    return F.greatest(F.when(rerank.isNotNull(), judged).otherwise(0.25 + 0.4 * fused_norm), best_visual)


VISUAL = ("clip_text", "clip_image", "compose", "face", "dupe", "name", "sound", "sound_audio", "folder_clip")
#: Lists whose scores stand for a relevance of their own.
MEANT = (*VISUAL, "dense", "extra", "folder_dense")


def scored_files(ranks: DataFrame, fused: DataFrame, verdicts: DataFrame | None = None, has_faces: bool = False, other_words: bool = False) -> DataFrame:
    """``file, relevance, evidence, fused, n_lists`` of every fused file.

    ``ranks`` has each list's best score of a file, ``verdicts(file, rerank)`` those of a
    reranker. A verdict counts most, and a stronger picture, face or sound overrules it; without
    a verdict the best calibrated score counts, helped by the second; keywords alone rank by the
    fusion. A query face (``has_faces``) among other words lifts a file, a named folder lifts its
    files, and lists them after those that match where there are ``other_words``.
    """
    score = lambda r: F.max(F.when(F.col("retriever") == r, F.col("score")))
    best = ranks.groupBy("file").agg(*(score(r).alias(r) for r in (*MEANT, "folder")))
    for r in MEANT:
        meant = calibrated(F.lit(r), F.col(r) if r != "dupe" else 64 - F.col(r))
        best = best.withColumn(r, F.when(F.col("folder").isNull(), meant) if r == "name" else meant)
    rows = fused.join(best, "file")
    rows = rows.join(verdicts.select("file", "rerank"), "file", "left") if verdicts is not None else rows.withColumn("rerank", F.lit(None).cast("double"))
    top = fused.agg(F.max("fused").alias("top"))  # one row
    rows = rows.crossJoin(F.broadcast(top)).withColumn("norm", F.coalesce(F.col("fused") / F.nullif("top", F.lit(0.0)), F.lit(0.0)))
    pairs = lambda names: F.array_sort(F.filter(F.array(*(F.struct((-F.col(r)).alias("s"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(names))), lambda x: x["s"].isNotNull()))
    rows = rows.withColumn("seen", pairs(VISUAL)).withColumn("meant", pairs(MEANT))
    visual = F.coalesce(-F.get("seen", F.lit(0))["s"], F.lit(0.0))
    judged = 0.7 * F.col("rerank") + 0.3 * F.greatest(visual, F.col("norm") * 0.8 * F.least(F.lit(1.0), 4 * F.col("rerank")))
    first, second = -F.get("meant", F.lit(0))["s"], -F.get("meant", F.lit(1))["s"]
    plain = F.least(F.lit(0.99), first + F.coalesce(0.1 * second * (1 - first), F.lit(0.0)))
    words = 0.25 + 0.4 * F.col("norm")
    base = F.when(F.col("rerank").isNotNull(), F.greatest(judged, visual)).when(first.isNotNull(), plain).otherwise(words)
    why = (F.when(F.col("rerank").isNotNull() & (visual > judged), F.get("seen", F.lit(0))["r"]).when(F.col("rerank").isNotNull(), "reranked passage")
           .when(first.isNotNull(), F.get("meant", F.lit(0))["r"]).otherwise("keywords"))
    rows = rows.withColumn("relevance", base).withColumn("evidence", why)
    if has_faces:
        rows = rows.withColumn("relevance", F.when(F.col("face").isNotNull(), F.least(F.lit(0.99), F.col("relevance") + 0.15 * F.col("face") * (1 - F.col("relevance")))).otherwise(F.col("relevance")))
    inside = 0.45 + 0.4 * F.col("folder")
    lifted = F.col("relevance") + 0.35 * inside * (1 - F.col("relevance"))
    floor = inside * 0.4 if other_words else inside
    named = F.col("folder").isNotNull()
    evidence = F.when(named & ((floor > lifted) | (F.col("evidence") == "keywords")), "folder").otherwise(F.col("evidence"))
    return rows.select("file", F.when(named, F.least(F.lit(0.99), F.greatest(lifted, floor))).otherwise(F.col("relevance")).alias("relevance"), evidence.alias("evidence"), "fused", "n_lists")


def rerank_pool(files: DataFrame, n: int, in_folder: Column | None = None) -> DataFrame:
    """The ``n`` best files by ``fused``; where folders were named, up to a third of the places go to the best files outside them."""
    order = [F.desc("fused"), F.col("file")]
    if in_folder is None:
        return files.orderBy(*order).limit(n)
    outside = settle(files.filter(~in_folder).orderBy(*order).limit(n // 3))
    return outside.unionByName(files.filter(in_folder).orderBy(*order).limit(n - outside.count()))


def passages(hits: DataFrame, order: list[str], most: int = 3) -> DataFrame:
    """``file, entity, place`` of up to ``most`` hits of each file, interleaved: every list's best first, lists in ``order``."""
    turn = F.array_position(F.array(*map(F.lit, order)), F.col("retriever"))
    depth = F.row_number().over(Window.partitionBy("file", "retriever").orderBy(F.desc("score"), "entity"))
    deep = hits.withColumn("depth", depth).filter(F.col("depth") <= most)
    first = deep.groupBy("file", "entity").agg(F.min(F.struct("depth", turn.alias("turn"))).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("at", "entity"))).filter(F.col("place") <= most).select("file", "entity", "place")


def relative_cut(rows: DataFrame, relative: float, floor: float | Column = 0.0, by: list[str] | None = None) -> DataFrame:
    """Rows within ``relative`` of the best score (of their bucket), and at least ``floor``.

    The best scores are one row, or one for each bucket, combined before they are shuffled.
    """
    floor = F.lit(floor) if isinstance(floor, float) else floor
    if by:
        held = rows.join(rows.groupBy(*by).agg(F.max("score").alias("top")), by)
    else:
        held = rows.crossJoin(F.broadcast(rows.agg(F.max("score").alias("top"))))  # one row
    return held.filter(F.col("score") >= F.greatest(floor, F.round(F.col("top") - relative, 4))).select(rows.columns)


def bucket_floor(kind: Column, pure_visual: bool = False) -> Column:
    """The least score of a bucket: where only pictures were asked for, documents need more."""
    return F.when(kind == "document", 0.5 if pure_visual else 0.2).otherwise(0.2)


def kind_caps(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best rows of each ``kind`` by ``score``, ties to the smaller ``file``."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "file"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def unjudged_floor(rows: DataFrame) -> DataFrame:
    """``rows(score, judged)``: a row that wasn't judged scores no higher than the least of those that were."""
    least = rows.agg(F.min(F.when(F.col("judged"), F.col("score"))).alias("least"))  # one row
    held = rows.crossJoin(F.broadcast(least))
    return held.withColumn("score", F.when(F.col("judged"), F.col("score")).otherwise(F.least("score", F.coalesce("least", "score")))).select(rows.columns)


def best_with_boost(hits: DataFrame, key: str) -> DataFrame:
    """``key, score``: the best score, and for each further hit, up to five, a hundredth of what is missing to one."""
    best = hits.groupBy(key).agg(F.max("score").alias("most"), F.count("*").alias("n"))
    more = F.when(F.col("n") > 1, 0.01 * F.least(F.col("n") - 1, F.lit(5)) * (1 - F.col("most"))).otherwise(0.0)
    return best.select(key, (F.col("most") + more).alias("score"))


def with_precedence(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))
