"""Substring deduplication with repeated-phrase automata.

1. *Sketch*: of every window of 50 words the phrase of least hash (12 words) is a seed, so equal
   windows have equal seeds. Documents with one word sequence are folded to the smallest id.
2. *Confirm*: seeds that occur in two documents lead to the windows around them; windows of equal
   words in two documents are confirmed as recurring, and the document of smallest id owns them.
3. *Compile*: the owner's runs of confirmed windows are passages, cut into pieces of bounded length.
   Each piece is cut into aligned blocks of 25 words, of which every window of 50 words holds one,
   and the blocks of a shard of pieces are compiled into an Aho-Corasick automaton.
4. *Stream*: every document that shares a window's hash with an owner streams through the automata
   of the shards that hold those passages; in any other shard it can have no window. The automaton
   finds the blocks, and the windows around each are compared with the passages' own words, each once.

A passage in very many documents splits its shard's documents over several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .shared import Words, buffers, chunks, int64, list_array, mix, phrase_hashes, sequence_hashes, text_column

WINDOW, PHRASE = 50, 12
BLOCK = WINDOW // 2
#: Starts of windows in a piece of a passage.
PIECE = 4_096
#: Bytes of passages in a shard, and of documents that stream through one task's automaton.
SHARD_BYTES, STREAM_BYTES = 1 << 20, 3 << 20


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def _window_seeds(h: np.ndarray, first: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the least phrase hash of each."""
    n = np.diff(first)
    counts = np.maximum(n - window + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(phrase_hashes(h, phrase), window - phrase + 1, np.minimum)
    start = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return start, least[start]


def sketch(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Per row: ``doc_id, n_words, one, two`` (hashes of the sequence), ``sha`` of its words joined by blanks, and its distinct ``seeds``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets):
                words = Words(data, offsets[start : stop + 1])
                h = words.hashes()
                one, two = sequence_hashes(h, words.first)
                at, seed = _window_seeds(h, words.first, window, phrase)
                doc = np.searchsorted(words.first, at, side="right") - 1
                change = np.r_[True, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])] if len(seed) else np.zeros(0, bool)
                seed, doc = seed[change], doc[change]
                order = np.lexsort((seed, doc))
                seed, doc = seed[order], doc[order]
                new = np.r_[True, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])] if len(seed) else np.zeros(0, bool)
                seed, doc = seed[new], doc[new]
                edges = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=stop - start))])
                sha = [hashlib.sha256(b" ".join(data[a:b].tobytes().split())).hexdigest() for a, b in zip(offsets[start:stop].tolist(), offsets[start + 1 : stop + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(np.diff(words.first), pa.int64()), pa.array(int64(one)), pa.array(int64(two)),
                     pa.array(sha, pa.string()), list_array(int64(seed), edges, pa.int64())],
                    ["doc_id", "n_words", "one", "two", "sha", "seeds"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, one long, two long, sha string, seeds array<long>")


def _recurring_windows(held: DataFrame, window: int, phrase: int) -> DataFrame:
    """Windows of ``held(doc_id, text, seeds)`` under a recurring seed: ``w`` and ``seed`` name their words, ``doc_id, at`` say where."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            seeds = batch.column("seeds")
            for start, stop in chunks(offsets):
                words = Words(data, offsets[start : stop + 1])
                h = words.hashes()
                at, seed = _window_seeds(h, words.first, window, phrase)
                if not len(at):
                    continue
                doc = np.searchsorted(words.first, at, side="right") - 1
                mine = seeds.slice(start, stop - start)
                wanted = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(stop - start), mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                mixed = mix(wanted.view(np.uint64) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keep = np.isin(mix(seed + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), mixed)
                at, seed, doc = at[keep], seed[keep], doc[keep]
                ids = batch.column("doc_id").slice(start, stop - start).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(int64(phrase_hashes(h, window)[at])), pa.array(int64(seed)), pa.array(ids[doc], pa.int64()), pa.array(at - words.first[doc], pa.int32())],
                    ["w", "seed", "doc_id", "at"])

    return held.select("doc_id", "text", "seeds").mapInArrow(run, "w long, seed long, doc_id long, at int")


def _passages(owned: DataFrame, window: int) -> DataFrame:
    """``owner, piece, text``: the words of each run of the windows that a document owns, joined by blanks; windows that start in different stretches of ``PIECE`` words are in different pieces."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, text = [], [], []
            for doc_id, raw, starts in zip(batch.column("doc_id").to_pylist(), text_column(batch).to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = raw.encode().split()
                places = sorted(set(starts))
                head = before = places[0]
                for place in [*places[1:], None]:
                    if place is None or place > before + 1 or place // PIECE > head // PIECE:
                        owner.append(doc_id)
                        number.append(head // PIECE)
                        text.append(b" ".join(words[head : before + window]).decode("utf-8"))
                        head = place
                    before = place
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(number, pa.int32()), pa.array(text, pa.string())], ["owner", "piece", "text"])

    return owned.select("doc_id", "text", "starts").mapInArrow(run, "owner long, piece int, text string")


def compile_automaton(passages: list[list[str]], block: int = BLOCK):
    """An Aho-Corasick automaton of the aligned blocks of all passages."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for words in passages:
        for at in range(0, len(words) - block + 1, block):
            automaton.add_word(" " + " ".join(words[at : at + block]) + " ", True)
    automaton.make_automaton()
    return automaton


def _line(words: list[str]) -> tuple[str, list[int]]:
    """The words between blanks, and where the blank before each word stands."""
    return " " + " ".join(words) + " ", np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()


def window_owners(passages: list[list[str]], owners: list[int], window: int = WINDOW) -> dict[str, int]:
    """The smallest id that owns each window of the passages."""
    out: dict[str, int] = {}
    for words, owner in zip(passages, owners, strict=True):
        line, edges = _line(words)
        for at in range(len(words) - window + 1):
            key = line[edges[at] : edges[at + window] + 1]
            out[key] = min(owner, out.get(key, owner))
    return out


def locate(automaton, owned: dict[str, int], doc_id: int, words: list[str], window: int = WINDOW, block: int = BLOCK) -> list[tuple[int, int]]:
    """Word ranges of a document covered by windows that smaller ids own.

    Only windows around a block found are compared, and each once, however many passages hold the block.
    """
    line, edges = _line(words)
    out: list[tuple[int, int]] = []
    place = np.array(edges)
    unseen = 0
    for end, _ in automaton.iter(line):
        at = int(np.searchsorted(place, end)) - block
        for start in range(max(unseen, at + block - window), min(at, len(words) - window) + 1):
            if owned.get(line[edges[start] : edges[start + window] + 1], doc_id) < doc_id:
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], start + window)
                else:
                    out.append((start, start + window))
        unseen = max(unseen, at + 1)
    return out


def _stream(shards: DataFrame, streams: DataFrame, window: int, block: int) -> DataFrame:
    """``doc_id, one, a, b``: the ranges found by the automaton of each shard in the documents dealt to it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        passages = [t.split(" ") for t in left.column("text").to_pylist()]
        owners = left.column("owner").to_pylist()
        out: list[tuple[int, int, int, int]] = []
        if passages and right.num_rows:
            automaton, owned = compile_automaton(passages, block), window_owners(passages, owners, window)
            for doc_id, one, text in zip(*(right.column(c).to_pylist() for c in ("doc_id", "one", "text")), strict=True):
                words = [w.decode() for w in text.encode().split()]
                out += [(doc_id, one, a, b) for a, b in locate(automaton, owned, doc_id, words, window, block)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "one", "a", "b"), columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})

    return shards.groupBy("shard", "salt").cogroup(streams.groupBy("shard", "salt")).applyInArrow(run, "doc_id long, one long, a int, b int")


def repeated_ranges(docs: DataFrame, marked: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``doc_id, one, a, b``: ranges of words to remove from the folded documents of ``marked`` (see ``sketch``)."""
    heads = marked.filter(F.col("doc_id").isNotNull() & (F.size("seeds") > 0)).groupBy("one", "two", "n_words", "seeds").agg(F.min("doc_id").alias("doc_id"))
    seeds = settle(heads.select("doc_id", "one", F.explode("seeds").alias("seed")))
    twice = seeds.groupBy("seed").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("seed")
    wanted = seeds.join(twice, "seed", "left_semi").groupBy("doc_id", "one").agg(F.collect_list("seed").alias("seeds"))
    held = settle(_with_sequence(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")).join(wanted, ["doc_id", "one"]).dropDuplicates(["doc_id", "one"]))
    windows = settle(_recurring_windows(held, window, phrase))
    confirmed = settle(
        windows.groupBy("w", "seed").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last"))
        .filter("first.doc_id < last").select("w", "seed", F.col("first.doc_id").alias("owner"), F.col("first.at").alias("start")))
    owned = confirmed.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("start").alias("starts"))
    passages = settle(_passages(held.join(owned, "doc_id"), window))
    size = passages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_of = lambda owner, piece: F.pmod(F.xxhash64(owner, piece), F.lit(max(1, size // SHARD_BYTES))).cast("int")
    placed = confirmed.select("w", "seed", "owner", shard_of("owner", F.floor(F.col("start") / PIECE).cast("int")).alias("shard"))
    routed = settle(windows.join(placed, ["w", "seed"]).filter("doc_id > owner").select("doc_id", "shard").distinct())
    passages = passages.select("owner", "text", shard_of("owner", "piece").alias("shard"))
    streams = held.select("doc_id", "one", "text").join(routed, "doc_id")
    salts = routed.join(held.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id").groupBy("shard").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("bytes") / F.lit(STREAM_BYTES))).cast("int").alias("salts"))
    streams = streams.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    shards = passages.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", "owner", "text")
    return _stream(shards, streams.select("shard", "salt", "doc_id", "one", "text"), window, BLOCK if window == WINDOW else window // 2), held


def _with_sequence(docs: DataFrame) -> DataFrame:
    """``doc_id, text, one``: rows with the hash of their word sequence, as ``sketch`` has it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch)
            data, offsets = buffers(column)
            for start, stop in chunks(offsets):
                words = Words(data, offsets[start : stop + 1])
                one, _ = sequence_hashes(words.hashes(), words.first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), column.slice(start, stop - start).cast(pa.string()), pa.array(int64(one))], ["doc_id", "text", "one"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, one long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept_text`` (null where nothing is removed).

    A word goes if it is covered by a window of ``window`` words that also starts in a document
    of smaller ``doc_id``, judged on the input. A document whose word sequence a smaller id has
    too goes whole if it has a window at all. Null texts have no words; rows that repeat a
    ``doc_id`` are judged by their own texts against other ids; rows without ``doc_id`` are kept
    whole and cause no removal.
    """
    docs = docs.select("doc_id", "text")
    marked = settle(sketch(docs, window, phrase))
    ranges, held = repeated_ranges(docs, marked, window, phrase)
    per_doc = ranges.groupBy("doc_id", "one").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for text, spans in zip(text_column(batch).to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int32)
                for span in spans:
                    gone[span["a"]] += 1
                    gone[span["b"]] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                left = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                removed.append(int((~keep).sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("one"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "one", "removed", "left_sha", "kept_text"])

    shortened = held.select("doc_id", "one", "text").join(per_doc, ["doc_id", "one"]).mapInArrow(cut, "doc_id long, one long, removed long, left_sha string, kept_text string")
    # settled, so that the rows of a sequence in very many documents can be split when they meet it
    first = settle(marked.filter(F.col("doc_id").isNotNull()).groupBy("one", "two").agg(F.min("doc_id").alias("head")))
    whole = (F.col("n_words") >= window) & (F.col("doc_id") > F.col("head"))
    return (
        marked.drop("seeds").join(first, ["one", "two"], "left").join(shortened, ["doc_id", "one"], "left")
        .select(
            "doc_id", "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
            F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
            F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    )
