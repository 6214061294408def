"""Vectorised views of Arrow text columns that several operators share.

Words are found in the UTF-8 bytes of a whole batch at once. A separator table of 256 booleans
says which bytes end a word; all bytes of characters beyond ASCII belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of text that numpy looks at together: bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 20

#: Space and the characters from tab to carriage return, as bytes.split() takes them.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: Translation to lower case of A-Z alone, other characters keep their bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_rng = np.random.default_rng(20240117)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: What is left of eight bytes that are read where a span has fewer.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Salts of hashes that are independent of each other.
SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def span_hashes(b: np.ndarray, start: np.ndarray, size: np.ndarray, salts: tuple[int, ...] = SALTS[:1]) -> list[np.ndarray]:
    """A 64-bit hash of each span of bytes for each salt.

    Eight bytes at a time are mixed with their place in the span and the salt before they are
    summed. As the mixing is not linear, no structure of a long span cancels out, and hashes
    under two salts are independent.
    """
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in salts]
    for at in range(0, len(start), 1 << 18):  # bounds the memory that a long text takes
        begin, length = start[at : at + (1 << 18)], size[at : at + (1 << 18)]
        blocks = (length + 7) >> 3
        first = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        eight = eights[np.repeat(begin, blocks) + 8 * place]
        eight &= _MASKS[np.minimum(np.repeat(length, blocks) - 8 * place, 8)]
        for out, salt in zip(parts, salts, strict=True):
            by_place = mix(np.arange(int(blocks.max()), dtype=np.uint64) * _STEP + np.uint64(salt))
            out.append(mix(np.add.reduceat(mix(eight ^ by_place[place]), first) ^ (length.astype(np.uint64) * _STEP)))
    return [np.concatenate(p) for p in parts]


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large_string without nulls: a null text is empty."""
    column = batch.column(name).cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a large_string array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


class Words:
    """The words of a few texts: byte spans, 64-bit hashes, and where each text's words begin (``first``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS, lower: bool = False):
        base = int(offsets[0])
        b = data[base : int(offsets[-1])]
        if lower:
            b = np.frombuffer(b.tobytes().translate(LOWER), np.uint8)
        inside = ~separators[b]
        edges = offsets - base
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        heads = edges[:-1][edges[:-1] < len(b)]
        starts[heads] = inside[heads]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        tails = edges[1:][edges[1:] > 0] - 1
        ends[tails] = inside[tails]
        self.bytes = b
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, edges)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end - self.start)[0]


def phrase_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (of all but the last ``k - 1``).

    Phrases of 1, 2, 4, ... words are mixed from their halves, and the phrase from those that make up ``k``.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, span, halves = np.full(n, k, np.uint64), 0, 1, words
    while True:
        if k & span:
            out = mix(out * _ODD[0] + halves[at : at + n])
            at += span
        if at == k:
            return out
        halves = mix(halves[:-span] * _ODD[1] + halves[span:] * _ODD[2])
        span *= 2


def sequence_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's whole word sequence."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    both = []
    for salt in (_ODD[1], _ODD[2]):
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + mix((place + np.uint64(1)) * salt)))])
        both.append(mix(summed[first[1:]] - summed[first[:-1]] + salt))
    return both[0], both[1]


def int64(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed numbers Spark keeps."""
    return values.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further fields behind its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def free_prefix(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` begins with it."""
    while any(c.lower().startswith(wanted.lower()) for c in df.columns):
        wanted = "_" + wanted
    return wanted
