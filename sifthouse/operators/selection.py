"""Scores that order web sources and catalog records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names that mark an institution.
TRUSTED = ["gov", "niti aayog", "pib", "nature", "ieee", "arxiv", "science", "reuters", "bloomberg", "isro"]
# End of fixed values.


def source_priority(chosen: Column, relevance: Column, quality: Column, kind: Column, text: Column, citations: Column, transcript: Column, duration: Column, provider: Column, url: Column) -> Column:
    """Points of a source: the user's choice first, then relevance (50 where there is none), quality, what its kind offers, and a known institution."""
    points = lambda when, n: F.when(when, n).otherwise(0)
    long_text = lambda n: F.length(F.coalesce(text, F.lit(""))) > n
    cited = F.coalesce(citations, F.lit(0))
    video = points(transcript, 20) + points(duration > 0, 5)
    paper = points(long_text(100), 20) + F.when(cited > 5, F.least(F.lit(15), F.floor(cited / 5))).otherwise(0)
    offers = F.when(kind == "video", video).when(kind == "paper", paper).when(kind == "report", 15).when(kind == "article", points(long_text(200), 10)).otherwise(0)
    known = F.lit(False)
    for name in TRUSTED:
        for place in (provider, url):
            known = known | F.coalesce(F.lower(place).contains(name), F.lit(False))
    return (points(chosen, 10000) + F.when(relevance != 0, relevance).otherwise(50) + F.when(quality == "high", 25).when(quality == "medium", 12).otherwise(0)
            + offers + points(known, 15)).cast("double")


def catalog_keywords(terms: list[str], title: Column, body: Column) -> Column:
    """Mean over the terms: 1 in the title, 0.6 in the body; a term of four letters or more also as the start of a word. A phrase in the title adds 0.15."""
    def held(term: str, words: Column) -> Column:
        return F.exists(words, lambda w: w.startswith(term)) if len(term) >= 4 else F.array_contains(words, term)

    if not terms:
        return F.lit(0.0)
    score = sum((F.when(held(t, title), 1.0).when(held(t, body), 0.6).otherwise(0.0) for t in terms), F.lit(0.0)) / len(terms)
    if len(terms) > 1:
        score = F.when(F.array_join(title, " ").contains(" ".join(terms)), F.least(F.lit(1.0), score + 0.15)).otherwise(score)
    return score


def catalog_score(keywords: Column, native: Column, semantic: Column, reranked: Column) -> Column:
    """Relevance of a record from the best signals it has: a reranker's verdict, else meaning, else words and the catalog's own order."""
    plain = F.when(keywords > 0, 0.25 + 0.4 * keywords + 0.1 * native).otherwise(0.1 * native)
    best = F.coalesce(0.7 * reranked + 0.3 * F.greatest(F.coalesce(semantic, F.lit(0.0)), keywords), 0.75 * semantic + 0.25 * keywords, plain)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), best)), 4)
