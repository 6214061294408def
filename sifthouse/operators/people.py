"""Grouping face vectors into people: mutual neighbours, components, centroids and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import norm
from ..functions.text import tokens
from ..session import settle
from . import descent, retrieval
from .graph import anchored_components, connected_components


def mutual_neighbours(vectors: DataFrame, k: int = 12, floor: float = 0.5, approximate: bool = False) -> DataFrame:
    """``src < dst, score`` where each of ``vectors(id, v)`` is among the other's ``k`` nearest at ``floor`` or more.

    Exact, over blocks of bounded size, which compares all pairs; or ``approximate`` by descent,
    in work that grows with the vectors. The neighbours are settled once and met with themselves.
    """
    if approximate:
        near = settle(descent.nearest(vectors.toDF("id", "v"), k, floor))
        back = near.filter("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return near.filter("src < dst").join(back, ["src", "dst"], "left_semi").select("src", "dst", "score")
    blocks = retrieval.packed_blocks(vectors.toDF("id", "v"))
    best = retrieval.block_best(blocks, blocks, k, floor)
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    near = settle(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
    back = near.filter("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return near.filter("src < dst").join(back, ["src", "dst"], "left_semi").select("src", "dst", "score")


def cluster(vectors: DataFrame, locked: DataFrame | None = None, k: int = 12, floor: float = 0.5, least: int = 2, approximate: bool = False) -> DataFrame:
    """``id, person``: groups of mutual neighbours with ``least`` members or more, named by their smallest face.

    ``locked(id, person_id)`` holds hand-made decisions. Groups join by their edges in order of
    likeness (then ids), but a group never takes in faces locked to two people; faces locked to
    the same person belong together, and their group stays however small. A face locked to no
    person is excluded: it joins nothing and is in no group.
    """
    if locked is None:
        parts = connected_components(mutual_neighbours(vectors, k, floor, approximate).select("src", "dst")).withColumn("anchored", F.lit(False))
    else:
        edges = mutual_neighbours(vectors, k, floor, approximate)
        excluded = locked.filter("person_id is null").select("id")
        for end in ("src", "dst"):
            edges = edges.join(excluded.withColumnRenamed("id", end), end, "left_anti")
        anchors = locked.filter("person_id is not null").select(F.col("id").alias("node"), F.col("person_id").alias("anchor"))
        parts = anchored_components(edges, anchors).join(anchors, "node", "left").withColumn("anchored", F.col("anchor").isNotNull())
    kept = parts.groupBy("component").agg(F.count("*").alias("n"), F.max("anchored").alias("anchored")).filter((F.col("n") >= least) | F.col("anchored"))
    return parts.join(kept.select("component"), "component").select(F.col("node").alias("id"), F.col("component").alias("person"))


def centroids(members: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean of each group's vectors at unit length."""
    mean = (members.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
            .groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")))
    c = F.col("c.m")
    return mean.select(group, F.transform(c, lambda x: x / norm(c)).alias("centroid"))


def cover(members: DataFrame, group: str, id_column: str, quality: Column, has_crop: Column) -> DataFrame:
    return members.groupBy(group).agg(F.max_by(id_column, F.struct(has_crop.alias("c"), quality.alias("q"), (-F.col(id_column)).alias("i"))).alias("cover"))


def assign_ids(groups: DataFrame, faces: DataFrame, known: DataFrame) -> DataFrame:
    """``person, person_id`` of every group: its hand-made anchor, else the known id most of its faces had that no larger group took, else a new one.

    ``groups(id, person)`` are faces in groups, ``faces(id, person_id, locked)`` what they were,
    ``known(person_id)`` ids that exist. Groups without anchor vote in rounds: every open group
    asks for the best id it has left, the largest group (then the smallest name) gets it. A new
    id is made from the group's own name, so a second run gives the same.
    """
    held = groups.join(faces, "id")
    sizes = groups.groupBy("person").agg(F.count("*").alias("size"))
    anchors = held.filter("locked and person_id is not null").groupBy("person").agg(F.min("person_id").alias("person_id"))
    given = settle(anchors)
    votes = settle(held.filter("not locked and person_id is not null").join(known, "person_id", "left_semi").join(anchors, "person", "left_anti")
                   .groupBy("person", "person_id").agg(F.count("*").alias("votes")).join(sizes, "person"))
    while True:
        open_ = votes.join(given.select("person"), "person", "left_anti").join(given.select("person_id"), "person_id", "left_anti")
        wish = open_.groupBy("person", "size").agg(F.min(F.struct((-F.col("votes")).alias("v"), "person_id")).alias("w")).select("person", "size", "w.person_id")
        won = wish.groupBy("person_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "person")).alias("w")).select("w.person", "person_id")
        more = settle(given.unionByName(won))
        if more.count() == given.count():
            break
        given = more
    fresh = F.concat(F.lit("p-"), F.substring(F.sha2(F.col("person").cast("string"), 256), 1, 16))
    return sizes.join(given, "person", "left").select("person", F.coalesce("person_id", fresh).alias("person_id"))


def signature(faces: DataFrame) -> DataFrame:
    """One row that changes with the faces and their corrections: ``n, last, locked, decided``."""
    return faces.agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.count_if("locked").alias("locked"), F.count_if(F.col("locked") & F.col("person_id").isNotNull()).alias("decided"))


def named_in(texts: DataFrame, key: str, text: str, people: DataFrame) -> DataFrame:
    """``key, person_id`` of the people whose whole name stands in a text, joined on the first word of the name."""
    words = tokens(F.col(text))
    named = people.select("person_id", tokens(F.col("name")).alias("n")).filter(F.size("n") > 0).select("person_id", "n", F.col("n")[0].alias("w"))
    said = texts.select(F.col(key), words.alias("t")).select(key, F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("line"), F.explode(F.array_distinct("t")).alias("w"))
    return said.join(named, "w").filter(F.col("line").contains(F.concat(F.lit(" "), F.array_join("n", " "), F.lit(" ")))).select(key, "person_id").distinct()


def best_faces(faces: DataFrame, most: int = 6) -> DataFrame:
    """The ``most`` best faces of each person by ``quality``, ties to the smaller ``id``."""
    place = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("quality"), "id"))
    return faces.withColumn("place", place).filter(F.col("place") <= most)
