"""Texts that a model reads: a file's sampled chunks, a source's fields, and what is told of results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import estimate_tokens
from .relations import even_sample

#: Bytes that a fingerprint takes from the begin, the middle and the end of a large file.
SAMPLE = 1 << 20


def fingerprint(content: bytes) -> str:
    """A digest of a file's size and of all its bytes, or of three samples of a large one."""
    size = len(content)
    parts = [content] if size <= 3 * SAMPLE else [content[:SAMPLE], content[size // 2 - SAMPLE // 2 :][:SAMPLE], content[-SAMPLE:]]
    return hashlib.blake2b(str(size).encode() + b"".join(parts), digest_size=16).hexdigest()


def fingerprints(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key, fingerprint`` of binary contents."""
    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: fingerprint(bytes(b)), na_action="ignore")

    return files.select(key, digest(F.col(content)).alias("fingerprint"))


def sampled_chunks(chunks: DataFrame, most: int) -> DataFrame:
    """Chunks ``(source_id, ord, text, ...)`` of files that fit ``most`` characters, and of longer files as many as would, spread evenly over them."""
    sizes = chunks.groupBy("source_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
    wanted = sizes.withColumn("count", F.when(F.col("chars") <= most, F.col("n")).otherwise(F.greatest(F.lit(1), F.least("n", F.floor(most / F.greatest(F.lit(1.0), F.col("chars") / F.col("n")))))))
    held = chunks.join(wanted.select("source_id", "n", "count"), "source_id")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("ord")) - 1
    i = F.col("place")
    picked = F.floor(F.ceil(i * F.col("count") / F.col("n")) * F.col("n") / F.col("count")) == i
    return held.withColumn("place", place).filter(picked).select(*chunks.columns)


def document_context(chunks: DataFrame, matched: DataFrame, most: int) -> DataFrame:
    """``source_id, context``: the passage that matched (``matched(source_id, passage)``), and a file's sampled chunks in order behind their kind, page and time."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(" p."), F.col("page").cast("string"))).otherwise("")
    at = F.floor("ts_start").cast("long")
    time = F.when(F.col("ts_start").isNotNull(), F.concat(F.lit(" "), F.floor(at / 60).cast("string"), F.lit(":"), F.lpad((at % 60).cast("string"), 2, "0"))).otherwise("")
    line = F.concat(F.lit("["), F.col("kind"), page, time, F.lit("] "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    lines = sampled_chunks(chunks, most).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    told = F.when(F.col("passage").isNotNull(), F.concat(F.lit("Best matching passage: "), F.col("passage")))
    return lines.join(matched, "source_id", "left").select("source_id", F.substring(F.concat_ws("\n", told, F.col("lines.line")), 1, most).alias("context"))


def source_context(most: int) -> Column:
    """What is told of a web source ``(kind, title, provider, date, author, duration, transcript, journal, citations, abstract, description)``, cut behind ``most`` characters."""
    told = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.substring(c, 1, most)))
    kind = F.coalesce("kind", F.lit("source"))
    head = F.concat(F.lit("["), F.upper(kind), F.lit('] "'), F.coalesce("title", F.lit("Untitled Source")), F.lit('"'),
                    F.coalesce(F.concat(F.lit(" | "), F.col("provider")), F.lit("")), F.coalesce(F.concat(F.lit(" | "), F.substring("date", 1, 10)), F.lit("")))
    author = F.concat(F.lit("Author(s): "), F.col("author"))
    of = lambda name, *parts: [F.when(kind == name, p) for p in parts]
    lines = F.concat_ws(
        "\n", head, author,
        *of("video", F.concat(F.lit("Duration: "), F.col("duration")), F.coalesce(told("Transcript:\n", "transcript"), told("Key Video Notes:\n", "description"))),
        *of("paper", F.concat(F.lit("Publication/Venue: "), F.col("journal")), F.concat(F.lit("Citations: "), F.col("citations").cast("string")), F.coalesce(told("Abstract:\n", "abstract"), told("Summary:\n", "description"))),
        *of("report", told("Report Executive Summary & Directives:\n", "description")), F.when(~kind.isin("video", "paper", "report"), told("Content Excerpt:\n", "description")))
    return F.when(F.length(lines) > most, F.concat(F.substring(lines, 1, most), F.lit("… [content truncated]"))).otherwise(lines)


def numbered_context(sources: DataFrame, order: list[str], most: int = 32_000) -> DataFrame:
    """``topic, context``: the numbered contexts of each topic's sources, which share ``most`` characters but get a thousand at least. The sources of a prompt are few."""
    counts = sources.groupBy("topic").agg(F.count("*").alias("n"))
    shares = [r["n"] for r in counts.select("n").distinct().collect()]  # one width for each number of sources in a topic
    place = F.row_number().over(Window.partitionBy("topic").orderBy(*order))
    held = sources.join(counts, "topic").withColumn("place", place)
    text = None
    for n in shares:
        one = source_context(max(1000, most // max(1, n)))
        text = F.when(F.col("n") == n, one) if text is None else text.when(F.col("n") == n, one)
    line = F.concat(F.lit("--- SOURCE "), F.col("place").cast("string"), F.lit(" (ID: "), F.col("id").cast("string"), F.lit(") ---\n"), text if text is not None else F.lit(""))
    told = held.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return told.select("topic", F.array_join("lines.line", "\n\n").alias("context"))


def budget_groups(texts: list[str], costs: list[int], budget: int) -> list[list[str]]:
    """Consecutive runs of texts that each fit a budget; a text that doesn't is a run of its own."""
    out: list[list[str]] = []
    used = 0
    for text, cost in zip(texts, costs, strict=True):
        if not out or used + cost > budget:
            out.append([])
            used = 0
        out[-1].append(text)
        used += cost
    return out


def summary_groups(summaries: DataFrame, budget: int) -> DataFrame:
    """``job, part, texts``: the summaries ``(job, place, text)`` of a job, which are few, in order and in runs that fit ``budget`` tokens."""
    held = summaries.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("place", "text", estimate_tokens(F.col("text")).alias("cost")))).alias("x"))

    @F.pandas_udf("array<array<string>>")
    def runs(texts: pd.Series, costs: pd.Series) -> pd.Series:
        return pd.Series([budget_groups(list(t), list(c), budget) for t, c in zip(texts, costs)])

    return held.select("job", F.posexplode(runs(F.col("x.text"), F.col("x.cost"))).alias("part", "texts"))


def spoken_pieces(words: list[tuple[float, float, str]], longest: float = 14.0, from_: float = 8.0) -> list[tuple[float, float, str]]:
    """The words ``(begin, end, word)`` of a long segment in pieces that end at punctuation from ``from_`` seconds on, or at ``longest``."""
    if not words or words[-1][1] - words[0][0] <= longest:
        return [(round(words[0][0], 2), round(words[-1][1], 2), text)] if words and (text := "".join(w for _, _, w in words).strip()) else []
    pieces: list[list[tuple[float, float, str]]] = [[]]
    for word in words:
        pieces[-1].append(word)
        lasts = word[1] - pieces[-1][0][0]
        if lasts >= longest or (lasts >= from_ and word[2].strip().endswith((".", "?", "!", "।", "॥", "…"))):
            pieces.append([])
    return [(round(p[0][0], 2), round(p[-1][1], 2), text) for p in pieces if p and (text := "".join(w for _, _, w in p).strip())]


def split_segments(words: DataFrame, key: str) -> DataFrame:
    """``key, begin, end, text`` of segments with their words ``(key, begin, end, word)``."""
    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["begin", "end"])
        return pd.DataFrame([(pdf[key].iloc[0], *p) for p in spoken_pieces(list(zip(rows["begin"], rows["end"], rows["word"])))], columns=[key, "begin", "end", "text"])

    return words.groupBy(key).applyInPandas(cut, f"{key} {words.schema[key].dataType.simpleString()}, begin double, end double, text string")


def thinned_frames(frames: DataFrame, key: str, most: int = 120, every: float = 0.25) -> DataFrame:
    """Frames ``(key, ts)`` no closer than ``every`` seconds apart in slots of that width, evenly thinned to ``most`` of each video."""
    slot = F.floor(F.col("ts") / every)
    first = frames.groupBy(key, slot.alias("slot")).agg(F.min("ts").alias("ts")).select(key, "ts")
    return even_sample(first, [key], [F.col("ts")], most)


def thumbnails(frames: DataFrame, key: str, first: int = 12) -> DataFrame:
    """``key, ts`` of the frame with the greatest variance times brightness among the first of each video."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ts"))
    held = frames.withColumn("place", place).filter(F.col("place") <= first)
    return held.groupBy(key).agg(F.max_by("ts", F.struct((F.col("variance") * F.col("brightness")).alias("s"), (-F.col("ts")).alias("t"))).alias("ts"))


def result_rows(scored: DataFrame, sources: DataFrame, moments: DataFrame) -> DataFrame:
    """What a caller sees of ``scored(file, relevance, evidence, matched_by)``: name, path and kind of the file, and where a moment matched (``moments(file, ts)``), its begin and fifteen seconds on."""
    shown = scored.join(sources, "file").join(moments, "file", "left")
    end = F.when(F.col("ts").isNotNull(), F.col("ts") + 15)
    return shown.select("file", "name", "rel_path", "kind", F.round("relevance", 4).alias("relevance"), "evidence", F.array_sort(F.split("matched_by", ",")).alias("matched_by"), F.col("ts").alias("start_time"), end.alias("end_time"))


def markdown_note(title: Column, url: Column, text: Column) -> Column:
    """A web source as a Markdown file."""
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("Source: "), url), text)


def catalog_filtered(records: DataFrame, kinds: list[str], after: str | None, before: str | None) -> DataFrame:
    """Catalog records that pass a search's filters: they are documents, and dated by their year; one without a year passes."""
    year = F.col("year").cast("string")
    out = records.filter(F.lit(not kinds or "document" in kinds))
    if after:
        out = out.filter(year.isNull() | (year >= after[:4]))
    return out.filter(year.isNull() | (F.concat(year, F.lit("-01-01")) < before)) if before else out


def timeline_filtered(events: DataFrame, words: str, importance: str | None = None) -> DataFrame:
    """Events whose title, description or date holds the words in any letter case, of one importance, by date."""
    held = F.lit(False)
    for c in ("title", "description", "date"):
        held = held | F.coalesce(F.lower(c).contains(words.lower()), F.lit(False))
    out = events.filter(held)
    return (out.filter(F.col("importance") == importance) if importance else out).orderBy("date", "id")
