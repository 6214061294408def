"""Choosing and preparing sources for an answer: passages, segments, budgets, caches and titles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import REPORT_WORDS, name_tokens, tokens
from ..session import settle

#: Points from which a kind's best source is taken first.
LEAST_POINTS = 50
#: Tokens of a prompt around the sources, and around each source.
PROMPT_TOKENS, SOURCE_TOKENS = 200, 30


def is_report(title: Column, description: Column) -> Column:
    """Whether a title or description calls itself a report."""
    text = F.lower(F.concat_ws(" ", title, description))
    return text.rlike("|".join(REPORT_WORDS))


def split_reports(articles: DataFrame, order: list[Column]) -> DataFrame:
    """``articles(topic, id, title, description)`` with ``kind``: reports apart from articles; where a topic has none but more than two articles, its last two are both."""
    told = articles.withColumn("kind", F.when(is_report(F.col("title"), F.col("description")), "report").otherwise("article"))
    counts = told.groupBy("topic").agg(F.count_if(F.col("kind") == "report").alias("reports"), F.count("*").alias("n"))
    last = Window.partitionBy("topic").orderBy(*order)
    ends = told.withColumn("back", F.row_number().over(last)).filter("back <= 2").drop("back")
    also = ends.join(counts.filter("reports = 0 and n > 2"), "topic", "left_semi").withColumn("kind", F.lit("report"))
    return told.unionByName(also)


def overlap_passages(asked: DataFrame, key: str, question: str, passages: DataFrame, order: list[str], text: str, most: int = 6) -> DataFrame:
    """``key, *order, n``: the ``most`` passages of each question that share most distinct words with it, ties in ``order``; joined on words."""
    q = asked.select(key, F.explode(F.array_distinct(tokens(F.col(question)))).alias("w"))
    p = passages.select(*order, F.explode(F.array_distinct(tokens(F.col(text)))).alias("w"))
    shared = q.join(p, "w").groupBy(key, *order).agg(F.count("*").cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), *order))
    return shared.withColumn("place", place).filter(F.col("place") <= most)


def best_segment(segments: DataFrame, key: str, start: str, text: str, terms: list[str]) -> DataFrame:
    """``key, start`` of the segment with most of the terms, the first of equals."""
    hits = F.size(F.array_intersect(F.array_distinct(tokens(F.col(text))), F.array(*map(F.lit, terms))))
    held = segments.select(key, start, hits.alias("hits")).filter("hits > 0")
    return held.groupBy(key).agg(F.max_by(start, F.struct("hits", (-F.col(start)).alias("first"))).alias(start))


def listed(rows: DataFrame, words: str, kind: str | None, order: list[Column]) -> DataFrame:
    """Sources whose title, description or provider holds the words in any letter case, of one kind, in order."""
    inside = F.lit(False)
    for c in ("title", "description", "provider"):
        inside = inside | F.coalesce(F.lower(c).contains(words.lower()), F.lit(False))
    out = rows.filter(inside)
    return (out.filter(F.col("kind") == kind) if kind else out).orderBy(*order)


def title_chunks(sources: DataFrame, key: str) -> DataFrame:
    """``key, kind, text, heading``: a chunk of each file's name without its extension, under its folder."""
    return sources.select(key, F.lit("title").alias("kind"), name_tokens(F.col("name")).alias("text"), F.col("folder").alias("heading"))


def cached_first(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """``fresh(source_id, fingerprint, origin)``, with the cached origin where the file has not changed since."""
    old = cached.select("source_id", "fingerprint", F.col("origin").alias("old"))
    return fresh.join(old, ["source_id", "fingerprint"], "left").select("source_id", "fingerprint", F.coalesce("old", "origin").alias("origin"))


def payload_status(status: Column) -> Column:
    """A status as callers know it."""
    return F.when(status == "queued", "uploaded").when(status == "indexed", "completed").otherwise(status)


def select_for_budget(sources: DataFrame, most: int = 8, budget: int = 8_000) -> DataFrame:
    """``topic, id, place, why``: up to ``most`` sources of each topic within ``budget`` tokens.

    ``sources(topic, id, kind, score, chosen, tokens)``. The user's own come first and the first
    of them always fits; then the best of each kind not there yet, at ``LEAST_POINTS`` or more;
    then the best left. A source that doesn't fit is passed over. One that is taken fits later
    than better ones of its kind that need no more tokens, so these were taken too: of the
    sources of one kind that need the same tokens only the ``most`` best can come in question,
    and tasks cut to those before a topic is gathered. A topic's rows are then at most ``most``
    times the budget's tokens for each of its kinds.
    """
    room = budget - PROMPT_TOKENS
    needs = F.col("tokens") + SOURCE_TOKENS
    fits = sources.filter(F.col("chosen") | (needs <= room))
    # what is too large counts only as the user's first
    place = F.row_number().over(Window.partitionBy("topic", "chosen", "kind", F.least(needs, F.lit(room + 1))).orderBy(F.desc("score"), "id"))
    return _chosen(settle(fits.withColumn("place", place).filter(F.col("place") <= most).drop("place")), most, budget)


def _chosen(ranked: DataFrame, most: int, budget: int) -> DataFrame:
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "id"], ascending=[False, True])
        taken: list[tuple] = []
        kinds: set[str] = set()
        used = PROMPT_TOKENS

        def take(row, why: str) -> None:
            nonlocal used
            taken.append((row.topic, row.id, len(taken) + 1, why))
            kinds.add(row.kind)
            used += row.tokens + SOURCE_TOKENS

        rest = []
        for row in rows.itertuples(index=False):
            if row.chosen:
                if len(taken) < most and (used + row.tokens + SOURCE_TOKENS <= budget or not taken):
                    take(row, "chosen")
            else:
                rest.append(row)
        for why in ("kind", "score"):
            held = {t[1] for t in taken}
            for row in rest:
                if len(taken) < most and row.id not in held and used + row.tokens + SOURCE_TOKENS <= budget and (why == "score" or (row.kind not in kinds and row.score >= LEAST_POINTS)):
                    take(row, why)
        return pd.DataFrame(taken, columns=["topic", "id", "place", "why"])

    kind = ranked.schema["topic"].dataType.simpleString()
    return ranked.groupBy("topic").applyInPandas(choose, f"topic {kind}, id long, place int, why string")
