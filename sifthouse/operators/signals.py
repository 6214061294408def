"""Scores of a file from the best of its signals, and picture hashes: what an older index gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import hamming, hash_similarity

# Similarity from which a face is a match and what it and a picture's similarity then stand for, and the least score of a file.
FACE_FROM, FACE_SPAN, FACE_AT, FACE_RISE, FACE_MOST = 0.48, 0.42, 0.75, 0.23, 0.98
PICTURE_FROM, PICTURE_SPAN, PICTURE_AT, PICTURE_RISE, PICTURE_MOST = 0.35, 0.50, 0.65, 0.31, 0.96
VISUAL_FROM, LEAST = 0.60, 0.20
# End of fixed values.


def face_strength(x: Column) -> Column:
    lifted = FACE_AT + (x - FACE_FROM) / FACE_SPAN * FACE_RISE
    return F.when(x < FACE_FROM, x).otherwise(F.least(F.lit(FACE_MOST), F.greatest(x, lifted)))


def picture_strength(x: Column) -> Column:
    lifted = PICTURE_AT + (x - PICTURE_FROM) / PICTURE_SPAN * PICTURE_RISE
    return F.when(x < PICTURE_FROM, x).otherwise(F.least(F.lit(PICTURE_MOST), F.greatest(x, lifted)))


def composite(signals: DataFrame) -> DataFrame:
    """``file, score`` at ``LEAST`` or more from the greatest signals of each file.

    ``signals(file, visual, text, image, face, hash, words, title, exact, face_query, face_match)``,
    null for a signal that isn't there. An equal picture counts most, then a face that matches,
    then what a picture or video shows; else the stronger of meaning and words, with a tenth of
    the weaker one in what is missing to one.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    face = F.when(F.col("face_query"), zero("face")).otherwise(0.0)
    meaning, words = F.greatest(zero("text"), zero("image"), face), F.greatest(zero("words"), zero("title"))
    seen = F.greatest(picture_strength(zero("image")), F.when(F.col("face_query"), face_strength(face)).otherwise(0.0))
    shown = F.when(words > 0, F.least(F.lit(0.99), seen + 0.05 * words * (1 - seen))).otherwise(seen)
    best = F.greatest(meaning, words)
    both = F.least(F.lit(0.99), best + 0.10 * F.least(meaning, words) * (1 - best))
    score = (F.when(F.col("exact") | (zero("hash") >= 0.95), F.when(zero("hash") > 0, zero("hash")).otherwise(0.98))
             .when(F.col("face_query") & F.col("face_match") & (face >= FACE_FROM), face_strength(face))
             .when(F.col("visual") & (seen >= VISUAL_FROM), shown).when((meaning > 0) & (words > 0), both).when(best > 0, best).otherwise(zero("hash")))
    return signals.select("file", score.alias("score")).filter(F.col("score") >= LEAST)


def hash_matches(pictures: DataFrame, p: int, d: int) -> DataFrame:
    """``id, similarity, exact`` of ``pictures(id, p, d)``, of which one of the two hashes is within eight bits of the query's, the most similar first."""
    rows = pictures.select("id", hamming(F.col("p"), F.lit(p)).alias("dp"), hamming(F.col("d"), F.lit(d)).alias("dd")).filter("dp <= 8 or dd <= 8")
    return rows.select("id", hash_similarity(F.col("dp"), F.col("dd")).alias("similarity"), ((F.col("dp") <= 3) & (F.col("dd") <= 3)).alias("exact")).filter("similarity >= 0.6")


def text_likelihood(pictures: DataFrame, prompts: DataFrame, first: int, scale: float = 20.0) -> DataFrame:
    """``id, share``: how much of the softmax over the prompts' similarities falls on the ``first`` ones.

    ``pictures(id, prompt, cosine)`` has a row for each prompt of ``prompts(prompt, place)``.
    """
    rows = pictures.join(F.broadcast(prompts), "prompt")  # a fixed list of prompts
    top = F.max("cosine").over(Window.partitionBy("id"))
    weighed = rows.withColumn("w", F.exp(scale * (F.col("cosine") - top)))
    return weighed.groupBy("id").agg((F.sum(F.when(F.col("place") < first, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"))


def reranked_pictures(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``files(file, rerank)`` with the best verdict on a file's pictures where that is better, or there was none."""
    best = verdicts.groupBy("file").agg(F.max("score").alias("picture"))
    return files.join(best, "file", "left").select("file", F.greatest("rerank", "picture").alias("rerank"), F.coalesce(F.col("picture") > F.coalesce("rerank", F.lit(-1.0)), F.lit(False)).alias("by_picture"))
