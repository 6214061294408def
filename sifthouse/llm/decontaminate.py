"""Benchmark decontamination by Wu-Manber search over words.

Every benchmark item gives windows of 13 words (an item of fewer words is one window). For each
window length one matcher is built: a block is ``B`` consecutive words, the shift table says how
far a block lets the search skip, and windows whose last block allows no skip stand in buckets
by the hash of that block; a direct comparison of words confirms each occurrence. Text that
shares no words with a benchmark is passed over some eleven words at a time.

Matchers are flat arrays, some six bytes for each byte of item text, and are broadcast in shards
of bounded size. Documents pass through one shard in one stage without a shuffle; where there are
several, the result is settled after each and the shard's broadcast destroyed, so that a worker
holds one shard at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .shared import Words, buffers, chunks, free_prefix, phrase_hashes, text_column, with_fields

#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII; capitals A-Z become small.
_BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
WINDOW = 13


def words_in(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, _BREAKS, lower=True)


class Cut:
    """The words of a few texts, with what searches of any window length share."""

    def __init__(self, words: Words):
        self.words, self.hashes = words, words.hashes()
        self.blocks: dict[int, np.ndarray] = {}

    def block_hashes(self, block: int) -> np.ndarray:
        if block not in self.blocks:
            self.blocks[block] = phrase_hashes(self.hashes, block)
        return self.blocks[block]

    def phrase(self, at: int, length: int) -> bytes:
        w = self.words
        return b" ".join(w.bytes[a:b].tobytes() for a, b in zip(w.start[at : at + length].tolist(), w.end[at : at + length].tolist(), strict=True))


@dataclass
class WuManber:
    """Finds all windows of one length. ``text`` holds the items' words between blanks, and window ``i`` is ``text[begin[i]:end[i]]`` of ``item[i]``."""

    length: int
    shift: bytes  # by the slot of a block's hash: how far the search may skip, the least of the blocks in it
    suffix: np.ndarray  # hash of each window's last block, ascending
    begin: np.ndarray
    end: np.ndarray
    item: np.ndarray
    text: bytes

    @property
    def block(self) -> int:
        return min(3, self.length)

    @staticmethod
    def build(cut: Cut, starts: np.ndarray, items: np.ndarray, text: bytes, place: np.ndarray, length: int) -> "WuManber":
        """From the first words ``starts`` of all windows; ``place`` says where in ``text`` each word begins."""
        block = min(3, length)
        hashes = cut.block_hashes(block)
        farthest = length - block + 1
        bits = max(8, int(4 * len(starts)).bit_length())
        shift = np.full(1 << bits, farthest, np.uint8)
        for left in range(farthest - 1, -1, -1):  # the nearer to the end, the later written
            shift[hashes[starts + farthest - 1 - left] >> np.uint64(64 - bits)] = left
        suffix = hashes[starts + farthest - 1]
        order = np.argsort(suffix, kind="stable")
        starts = starts[order]
        sizes = cut.words.end - cut.words.start
        last = starts + length - 1
        return WuManber(length, shift.tobytes(), suffix[order], place[starts], place[last] + sizes[last], items[order], text)

    def search(self, cut: Cut, first: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """The words ``first`` to ``stop`` of a text: each occurrence's first word, and the items it belongs to."""
        hashes = cut.block_hashes(self.block)
        slots = memoryview((hashes[first:stop] >> np.uint64(64 - (len(self.shift) - 1).bit_length())).astype(np.uint32))
        shift, ahead = self.shift, self.length - self.block
        at, last = 0, stop - first - self.length
        while at <= last:
            skip = shift[slots[at + ahead]]
            if skip:
                at += skip
                continue
            suffix = hashes[first + at + ahead]
            low = int(np.searchsorted(self.suffix, suffix))
            if low < len(self.suffix) and self.suffix[low] == suffix:
                high = int(np.searchsorted(self.suffix, suffix, side="right"))
                here = cut.phrase(first + at, self.length)
                same = [i for i, a, b in zip(range(low, high), self.begin[low:high].tolist(), self.end[low:high].tolist(), strict=True) if self.text[a:b] == here]
                if same:
                    yield first + at, self.item[same]
            at += 1


def build_matchers(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[WuManber]:
    column = pa.array([t or "" for _, t in items], pa.large_string())
    cut = Cut(words_in(*buffers(column)))
    words, ids = cut.words, np.array([i for i, _ in items], np.int64)
    counts = np.diff(words.first)
    text = b" ".join(words.bytes[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True))
    place = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])[:-1].astype(np.int64)
    out = []
    for length in sorted({min(window, n) for n in counts.tolist() if n}):
        mine = np.flatnonzero(counts >= window if length == window else counts == length)
        n = counts[mine] - length + 1
        starts = np.repeat(words.first[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(WuManber.build(cut, starts, np.repeat(ids[mine], n), text, place, length))
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = 16 << 20, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (hit word ranges, end excluded) and ``item_ids`` of the items found in each whole text, behind ``prefix``.

    Equal items all count; null texts have no words, items without words, id or text are never
    found; an empty benchmark hits nothing. Rows that repeat or lack a ``doc_id`` are treated as
    any others. Other columns are kept, but those named as the new ones. ``shard_bytes`` bounds
    the item text that one broadcast holds, up to its longest item.
    """
    spark = docs.sparkSession
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    own = [f"{prefix}{n}" for n in ("n_words", "spans", "item_ids")]
    base = docs.drop(*own)
    names, schema = base.columns, with_fields(base, f"`{own[0]}` long, `{own[1]}` array<struct<a:int,b:int>>, `{own[2]}` array<long>")
    result = base
    span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for shard in range(shards):
        items = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).toLocalIterator()
        matchers = spark.sparkContext.broadcast(build_matchers([(r["item_id"], r["text"]) for r in items], window))
        later = shard > 0

        def run(batches: Iterable[pa.RecordBatch], matchers=matchers, later=later) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = buffers(text_column(batch))
                for start, stop in chunks(offsets):
                    part = batch.slice(start, stop - start)
                    cut = Cut(words_in(data, offsets[start : stop + 1]))
                    first = cut.words.first.tolist()
                    earlier = zip(part.column(own[1]).to_pylist(), part.column(own[2]).to_pylist(), strict=True) if later else None
                    spans, found = [], []
                    for a, b in zip(first, first[1:]):
                        old, ids = next(earlier) if earlier is not None else ((), ())
                        hits, owners = [(x["a"], x["b"]) for x in old], set(ids)
                        for matcher in matchers.value:
                            for at, of in matcher.search(cut, a, b):
                                hits.append((at - a, at - a + matcher.length))
                                owners.update(of.tolist())
                        spans.append([{"a": x, "b": y} for x, y in _merge(hits)])
                        found.append(sorted(owners))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(n) for n in names), pa.array(np.diff(cut.words.first), pa.int64()), pa.array(spans, span_type), pa.array(found, pa.list_(pa.int64()))], [*names, *own])

        result = result.mapInArrow(run, schema)
        if shards > 1:
            result = settle(result)
            matchers.destroy()
    return result


def hit_words(spans: Column) -> Column:
    """How many words stand in ``spans``."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]).cast("long"))


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """Whether a ``share``-th of the words, and one at least, is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    own = free_prefix(docs, "hit_")
    found = find_contamination(docs, benchmark, prefix=own)
    return found.filter(~contaminated(hit_words(F.col(f"{own}spans")), F.col(f"{own}n_words"))).select(docs.columns)


def contamination_report(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` (a ``share``-th of its words hit)."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    found = found.select("doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"))
    return found.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words"), share))
