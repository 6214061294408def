"""A whole search as one plan: every list a query asks for, fused; the best files judged by their passages and pictures; then scored, folded and cut to a page.

Lists are composed lazily from the tables that are there and the signals that a query has, and
are settled once, cut to their best rows; all that follows works on those few rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import FACE_MATCH
from ..functions.text import search_terms
from ..operators import folders, folding, fusion, postings, retrieval
from ..operators.chunking import focus_window
from ..session import settle
from .query_plan import QueryPlan, allowed_sources, parse_query, weights

# Rows of a list, of the lists by other passages, and of those by names and by hashes; differing bits of a copy;
# files whose passages and pictures are judged, those of them judged by several passages, and how many; characters of a passage;
# the least relevance; the order in which lists give passages; lists of pictures, the likelier first; the share of words in a composed vector.
TOP, TOP_EXTRA, TOP_NAMES, TOP_COPIES, COPY_BITS = 200, 100, 50, 50, 10
JUDGED, JUDGED_PICTURES, DEEP, PASSAGES, PASSAGE_SIZE = 30, 12, 10, 3, 900
LEAST = 0.15
TEXT_LISTS = ("dense", "bm25", "extra", "transcript", "folder_dense", "folder_bm25")
PICTURE_LISTS = ("folder_clip", "clip_text", "compose", "clip_image")
COMPOSED = 0.6
# End of fixed values.


@dataclass(frozen=True)
class Tables:
    """What there is to search; of the tables only ``sources`` and ``chunks`` must be there.

    ``chunks(source_id, chunk_id, kind, text, heading)``, ``vectors(chunk_id, v)``,
    ``pictures(source_id, picture_id, v, hash, caption)``, ``faces(source_id, face_id, v)``,
    ``sounds(source_id, segment_id, v)``; vectors are of unit length. An ``index`` over the chunks
    stands in for reading their texts, where no filter or folder narrows them.
    """

    sources: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None
    pictures: DataFrame | None = None
    faces: DataFrame | None = None
    sounds: DataFrame | None = None
    excluded: DataFrame | None = None
    index: postings.Index | None = None


@dataclass(frozen=True)
class Signals:
    """Vectors and hashes of a query: of its words for texts, pictures and sounds, of further passages, of its own picture, faces and sound."""

    text: list[float] | None = None
    extra: tuple[list[float], ...] = ()
    seen: list[float] | None = None
    image: list[float] | None = None
    hash: int | None = None
    faces: tuple[list[float], ...] = ()
    heard: list[float] | None = None
    sound: list[float] | None = None


#: Scores ``(file, entity, query, passage)`` rows with ``score`` from 0 to 1.
Judge = Callable[[DataFrame], DataFrame]


def word_share(rows: DataFrame) -> DataFrame:
    """The share of a query's words that a passage holds: a stand-in for a model's verdict."""
    asked, said = search_terms(F.col("query")), search_terms(F.col("passage"))
    return rows.withColumn("score", F.coalesce(F.try_divide(F.size(F.array_intersect(asked, said)), F.size(asked)), F.lit(0.0)))


def _vector(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _hits(found: DataFrame, name: str, kind: str, entity: str | None) -> DataFrame:
    """A list's rows; one without entities stands for files."""
    one = F.col(entity).cast("long") if entity else F.lit(None).cast("long")
    return found.select(F.lit(name).alias("retriever"), F.col("source_id").alias("file"), one.alias("entity"), F.lit(kind).alias("kind"), F.col("score").cast("double").alias("score"))


def _nearest(rows: DataFrame, queries: tuple, key: str, name: str, kind: str, most: int) -> DataFrame:
    """The best rows for any of the query vectors: each vector's ``most`` best, an entity by its best score."""
    tops = [retrieval.dense_topk(rows, _vector(q), key, "v", most) for q in queries]
    best = fusion.merge_max(reduce(lambda a, b: a.unionByName(b), tops), [key]).orderBy(F.desc("score"), key).limit(most)
    return _hits(best.join(rows.select(key, "source_id"), key), name, kind, key)


def _composed(signals: Signals) -> list[float]:
    mixed = [x + COMPOSED * y for x, y in zip(signals.image, signals.seen, strict=True)]
    size = sum(x * x for x in mixed) ** 0.5 or 1.0
    return [x / size for x in mixed]


def lists(tables: Tables, plan: QueryPlan, signals: Signals, allowed: DataFrame, narrowed: bool, scopes: DataFrame | None, content: QueryPlan | None) -> DataFrame:
    """``retriever, file, entity, kind, score`` of every list that the query has signals for and the tables serve."""
    inside = lambda rows: rows.join(allowed.select("source_id"), "source_id", "left_semi")
    chunks, out = inside(tables.chunks), []
    words = [*plan.terms, *(" ".join(re.findall(r"[\wऀ-ॿ]+", p.lower())) for p in plan.phrases)]
    if plan.terms:
        if tables.index is not None and not narrowed:
            found = postings.bm25(tables.index, words, "chunk_id", TOP).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        else:
            found = retrieval.bm25(chunks, words, "chunk_id", {"text": 1.0, "heading": 0.4}, TOP)
        out.append(_hits(found.join(tables.chunks.select("source_id", "chunk_id"), "chunk_id"), "bm25", "chunk", "chunk_id"))
        if any(len(t) >= 3 for t in plan.terms):
            out.append(_hits(retrieval.name_search(allowed, list(plan.terms), "source_id", "rel_path", TOP_NAMES), "name", "source", None))
    owned = lambda rows: rows.join(tables.vectors, "chunk_id").select("source_id", "chunk_id", "v")
    if tables.vectors is not None:
        if signals.text is not None:
            out.append(_nearest(owned(chunks), (signals.text,), "chunk_id", "dense", "chunk", TOP))
        if signals.extra:
            out.append(_nearest(owned(chunks), signals.extra, "chunk_id", "extra", "chunk", TOP_EXTRA))
    if tables.pictures is not None:
        pictures = inside(tables.pictures)
        asked = {"clip_text": signals.seen, "clip_image": signals.image, "compose": _composed(signals) if signals.image and signals.seen else None}
        out += [_nearest(pictures, (q,), "picture_id", name, "visual", TOP) for name, q in asked.items() if q is not None]
        if signals.hash is not None:
            near = retrieval.hash_search(pictures, signals.hash, "picture_id", "hash", COPY_BITS, TOP_COPIES)
            # the fewer bits differ the higher the score
            scored = near.join(pictures.select("picture_id", "source_id"), "picture_id").withColumn("score", 64 - F.col("distance"))
            out.append(_hits(scored, "dupe", "visual", "picture_id"))
    if tables.faces is not None and signals.faces:
        out.append(_nearest(inside(tables.faces), signals.faces, "face_id", "face", "face", TOP))
    if tables.sounds is not None:
        out += [_nearest(inside(tables.sounds), (q,), "segment_id", name, "audio", TOP) for name, q in (("sound", signals.heard), ("sound_audio", signals.sound)) if q is not None]
    if scopes is not None:
        members = settle(folders.scope_members(allowed, scopes))
        out.append(_hits(members, "folder", "source", None))
        within = lambda rows: rows.join(members.select("source_id"), "source_id", "left_semi")
        if content is not None and content.terms:
            found = retrieval.bm25(within(chunks), list(content.terms), "chunk_id", {"text": 1.0, "heading": 0.4}, TOP)
            out.append(_hits(found.join(tables.chunks.select("source_id", "chunk_id"), "chunk_id"), "folder_bm25", "chunk", "chunk_id"))
            if tables.vectors is not None and signals.text is not None:
                out.append(_nearest(owned(within(chunks)), (signals.text,), "chunk_id", "folder_dense", "chunk", TOP))
            if tables.pictures is not None and signals.seen is not None:
                out.append(_nearest(within(tables.pictures), (signals.seen,), "picture_id", "folder_clip", "visual", TOP))
    if not out:  # filters only: the files in the order of their paths
        out.append(_hits(allowed.orderBy("rel_path", "source_id").limit(fusion.MOST_TIED).withColumn("score", F.lit(1.0)), "filter", "source", None))
    hits = settle(reduce(lambda a, b: a.unionByName(b), out))
    spoken = tables.chunks.filter("kind = 'transcript'").join(hits.filter("retriever in ('dense', 'bm25')").select(F.col("entity").alias("chunk_id")), "chunk_id", "left_semi")
    speech = fusion.transcript_list(hits, spoken.select(F.col("chunk_id").alias("entity")))
    owner = hits.filter("kind = 'chunk'").select("entity", "file").distinct()
    return hits.unionByName(speech.join(owner, "entity").select("retriever", "file", "entity", F.lit("chunk").alias("kind"), "score"))


def _windows(text: Column, words: Column) -> Column:
    """The part of each text that holds most of its words."""
    @F.pandas_udf("string")
    def shown(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            yield pd.Series([focus_window(t, set(w), PASSAGE_SIZE) for t, w in zip(texts, wanted, strict=True)])

    return shown(text, words)


def judged_passages(tables: Tables, hits: DataFrame, pool: DataFrame, judge: Judge, text: str, content: str) -> DataFrame:
    """``file, entity, score``: the verdicts on the passages of the files of ``pool(file, place, in_folder)``.

    The best files show up to three passages, the others one, taken from the lists in turn; a file
    without a passage shows the words of its best picture, or its name. A name stands before a
    passage only where it shares a word with the query: one that says nothing misleads a judge.
    In a named folder the words that the folder leaves are judged.
    """
    in_text = hits.filter(F.col("retriever").isin(*TEXT_LISTS) & (F.col("kind") == "chunk")).join(pool.select("file"), "file", "left_semi")
    picked = fusion.passages(in_text, list(TEXT_LISTS), PASSAGES).join(pool, "file").filter(F.col("place") <= F.when(F.col("rank") < DEEP, PASSAGES).otherwise(1)).select("file", "entity")
    shown = picked.join(tables.chunks.select(F.col("chunk_id").alias("entity"), F.concat(F.when(F.length("heading") > 0, F.concat("heading", F.lit("\n"))).otherwise(""), F.col("text")).alias("said")), "entity").withColumn("kind", F.lit("chunk"))
    rest = pool.join(picked.select("file").distinct(), "file", "left_anti").select("file")
    if tables.pictures is not None:
        likely = hits.filter(F.col("retriever").isin(*PICTURE_LISTS)).join(rest, "file", "left_semi")
        words = tables.pictures.filter(F.trim("caption") != "").select(F.col("picture_id").alias("entity"), F.col("caption").alias("said"))
        order = F.struct(F.array_position(F.array(*map(F.lit, PICTURE_LISTS)), F.col("retriever")).alias("l"), (-F.col("score")).alias("s"), "entity")
        best = likely.groupBy("file", "retriever").agg(F.min(order).alias("o")).select("file", "o.*")
        told = best.join(words, "entity").groupBy("file").agg(F.min_by(F.struct("entity", "said"), F.struct("l", "s", "entity")).alias("x")).select("file", "x.*", F.lit("visual").alias("kind"))
        shown, rest = shown.unionByName(told), rest.join(told.select("file"), "file", "left_anti")
    named = hits.filter("retriever = 'name'").join(rest, "file", "left_semi").select("file", F.lit(None).cast("long").alias("entity"), F.lit("").alias("said"), F.lit("name").alias("kind"))
    titles = tables.sources.select(F.col("source_id").alias("file"), F.col("rel_path").alias("title"))
    rows = shown.unionByName(named).filter(F.col("kind").eqNullSafe("name") | (F.trim("said") != "")).join(titles, "file").join(pool.select("file", "in_folder"), "file")
    query = F.when(F.col("in_folder") & F.lit(bool(content)), F.lit(content)).otherwise(F.lit(text))
    rows = rows.withColumn("query", query).withColumn("words", search_terms(query))
    told = F.size(F.array_intersect(F.split(F.lower(F.regexp_replace("title", r"[^\wऀ-ॿ]+", " ")), " "), "words")) > 0
    head = F.when(told | (F.col("kind") == "name"), F.concat(F.lit("Title: "), "title", F.when(F.col("kind") == "name", "").otherwise("\n"))).otherwise("")
    asked = rows.withColumn("passage", F.concat(head, _windows(F.col("said"), F.col("words")))).select("file", "entity", "query", "passage")
    return judge(asked).select("file", "entity", "score")


def judged_pictures(tables: Tables, hits: DataFrame, pool: DataFrame, judge: Judge, text: str, content: str) -> DataFrame:
    """``file, entity, score``: the verdicts on the best picture of each file of ``pool``; a file that only its folder lists is left to the folder."""
    able = hits.filter(F.col("retriever").isin("clip_text", "compose", "folder_clip")).join(pool, "file").filter((F.col("retriever") != "folder_clip") | F.col("in_folder")).filter(~F.col("in_folder") | F.lit(bool(content)))
    best = able.groupBy("file", "in_folder").agg(F.max_by("entity", F.struct("score", (-F.col("entity")).alias("e"))).alias("entity"))
    asked = best.withColumn("query", F.when(F.col("in_folder"), F.lit(content)).otherwise(F.lit(text))).join(tables.pictures.select(F.col("picture_id").alias("entity"), F.coalesce("caption", F.lit("")).alias("passage")), "entity")
    return judge(asked.select("file", "entity", "query", "passage")).select("file", "entity", "score")


def search(tables: Tables, text: str, signals: Signals = Signals(), limit: int = 20, judge: Judge | None = word_share, judge_pictures: Judge | None = None) -> DataFrame:
    """``kind, place, file, relevance, evidence, matched_by, entity, copies``: the ``limit`` best files of each kind.

    ``text`` has words, phrases and filters. Files that only a query face matches stay out where
    there are words too: there the face is the point. ``entity`` is what was judged best,
    ``copies`` counts the pictures folded into a nearly equal one.
    """
    plan = parse_query(text)
    allowed = settle(allowed_sources(tables.sources, plan.filters, tables.excluded))
    narrowed = bool(plan.filters != type(plan.filters)()) or tables.excluded is not None
    scopes = settle(folders.match_folders(allowed, plan.text)) if plan.terms and not plan.filters.folder else None
    named = scopes.collect() if scopes is not None else []  # folders.MOST_SCOPES at most
    content = folders.content_text(plan.text, {t for r in named for t in r["matched"]}) if named else ""
    hits = settle(lists(tables, plan, signals, allowed, narrowed, scopes if named else None, parse_query(content) if content else None))
    tied = F.col("retriever").isin(*fusion.TIED)
    # a file's rank in a list is among all its files, as each list is cut already
    ranks = settle(fusion.file_ranks(hits.filter(~tied)).unionByName(fusion.file_ranks(hits.filter(tied), tied=True)))
    fused = fusion.rrf(ranks, weights(plan, pictures=signals.image is not None)).withColumn("fused", F.coalesce("fused", F.lit(0.0)))
    if signals.faces and (plan.text or signals.extra):
        fused = fused.join(ranks.filter((F.col("retriever") == "face") & (F.col("score") >= FACE_MATCH)).select("file"), "file", "left_semi")
    fused = settle(fused)
    marked = fused.join(ranks.filter("retriever = 'folder'").select("file", F.lit(True).alias("in_folder")), "file", "left").withColumn("in_folder", F.coalesce("in_folder", F.lit(False)))
    order = Window.orderBy(F.desc("fused"), "file")  # of a pool, JUDGED files at most
    pool = lambda n: fusion.rerank_pool(marked, n, F.col("in_folder") if named else None).withColumn("rank", F.row_number().over(order) - 1).select("file", "rank", "in_folder")
    verdicts = []
    if judge is not None and plan.terms:
        verdicts.append(judged_passages(tables, hits, settle(pool(JUDGED)), judge, plan.text, content))
    if judge_pictures is not None and tables.pictures is not None and plan.text:
        verdicts.append(judged_pictures(tables, hits, settle(pool(JUDGED_PICTURES)), judge_pictures, plan.text, content))
    best = None
    if verdicts:
        every = reduce(lambda a, b: a.unionByName(b), verdicts)
        best = settle(every.groupBy("file").agg(F.max("score").alias("rerank"), F.max_by("entity", F.struct("score", (-F.coalesce("entity", F.lit(0))).alias("e"))).alias("entity")))
    scored = fusion.scored_files(ranks, fused, best, bool(signals.faces and (plan.text or signals.extra)), bool(content)).filter(F.col("relevance") >= LEAST)
    if best is not None:
        scored = scored.join(best.select("file", "entity"), "file", "left")
    else:
        scored = scored.withColumn("entity", F.lit(None).cast("long"))
    matched = ranks.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("retriever")), ",").alias("matched_by"))
    rows = settle(scored.join(matched, "file").join(tables.sources.select(F.col("source_id").alias("file"), F.col("kind")), "file"))
    rows = rows.withColumn("copies", F.lit(0).cast("long"))
    if tables.pictures is not None:
        # of a photo's pictures the first has its hash
        photo = tables.pictures.filter("hash is not null").groupBy(F.col("source_id").alias("file")).agg(F.min_by("hash", "picture_id").alias("hash"))
        photos = rows.filter("kind = 'image'").join(photo, "file").select("kind", F.col("file").alias("id"), "hash", "relevance")
        into = settle(folding.collapse_bursts(photos, "kind").filter("kept_id <> id"))
        more = into.groupBy(F.col("kept_id").alias("file")).agg(F.count("*").alias("more"))
        rows = rows.join(into.select(F.col("id").alias("file")), "file", "left_anti").join(more, "file", "left").withColumn("copies", F.coalesce("more", F.lit(0)))
    capped = fusion.kind_caps(rows.withColumn("score", F.col("relevance")), limit)
    return capped.select("kind", "place", "file", F.round("relevance", 4).alias("relevance"), "evidence", "matched_by", "entity", "copies")
