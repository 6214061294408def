"""Vector, hash and calibration functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector counts as of length one."""
    size = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return dot(a, b) / (size(a) * size(b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 64 where a hash is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64)).cast("int")


# Similarity of pictures by the differing bits of both their hashes, and then of the closer one.
BOTH_WITHIN = [(0, 1.00), (2, 0.99), (3, 0.98), (5, 0.95)]
ONE_WITHIN = [(4, 0.94), (6, 0.90), (8, 0.80), (10, 0.65)]
# End of fixed values.


def hash_similarity(p: Column, d: Column) -> Column:
    """Similarity of two pictures from the differing bits of two kinds of hashes."""
    out = F.lit(0.0)
    for bits, similarity in reversed(ONE_WITHIN):
        out = F.when(F.least(p, d) <= bits, similarity).otherwise(out)
    for bits, similarity in reversed(BOTH_WITHIN):
        out = F.when(F.greatest(p, d) <= bits, similarity).otherwise(out)
    return out


def through(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Straight lines between ``(x, y)`` knots in ascending order, level before the first and after the last; null for null."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(knots[0][1])).when(x.isNotNull(), out)


# What a retriever's scores stand for as relevance, as knots, and the score from which two faces are one person's.
CALIBRATION = {
    "dense": [(0.30, 0.0), (0.40, 0.20), (0.70, 0.95)],
    "clip_text": [(0.22, 0.0), (0.30, 0.15), (0.60, 0.92)],
    "clip_image": [(0.50, 0.0), (0.65, 0.25), (0.92, 0.98)],
    "sound": [(0.08, 0.0), (0.15, 0.20), (0.35, 0.92)],
    "sound_audio": [(0.45, 0.0), (0.60, 0.30), (0.92, 0.98)],
}
CALIBRATED_AS = {"extra": "dense", "folder_dense": "dense", "folder_clip": "clip_text"}
FACE_MATCH = 0.42
FACE_BELOW, FACE_ABOVE = [(0.25, 0.0), (0.42, 0.45)], [(0.42, 0.70), (0.75, 0.98)]
# End of fixed values.


def calibrated(retriever: Column, score: Column) -> Column:
    """Relevance that a retriever's score stands for. ``dupe`` scores are differing bits; a face's relevance leaps where it becomes a match."""
    out = F.when(score.isNull(), None).when(retriever == "dupe", F.greatest(F.lit(0.0), 1 - score / 32))
    out = out.when(retriever == "face", F.when(score < FACE_MATCH, through(score, FACE_BELOW)).otherwise(through(score, FACE_ABOVE)))
    out = out.when(retriever == "compose", through(score, CALIBRATION["clip_image"]) * 0.95).when(retriever == "name", 0.35 + 0.5 * score)
    for name in [*CALIBRATION, *CALIBRATED_AS]:
        out = out.when(retriever == name, through(score, CALIBRATION[CALIBRATED_AS.get(name, name)]))
    return out.otherwise(score)


def rank_to_score(v: Column) -> Column:
    return F.round(F.least(F.lit(0.99), F.log1p(v) / (1 + F.log1p(v))), 4)


def threshold(value: Column, default: float) -> Column:
    """30 or 0.3 to 0.3 within [0, 1]; what can't be read becomes the default."""
    v = value.try_cast("double")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v)))
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(share)
