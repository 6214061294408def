"""Periodic runs of words: stretches in which the words repeat at a short distance at least four times over.

A run of period ``q`` has many words that equal the word ``q`` places on. So for every lag the
matching pairs of a document are counted, in two ways: a frequent word by the exact
autocorrelation of its places (FFT), a rare one by the differences of all pairs of its places.
Only a lag with as many matches as its shortest run has is scanned for islands of matches, at
check points first, and between these where enough of them match in a row. A run found takes
its matches off the counts of its period's multiples, so those are not scanned for it again.

Every document is looked at in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import buffers, chunks, text_column, with_fields

#: A run has this many words, and this many times its period, at least.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Pairs of places whose differences are taken together: bounds the memory of a worker.
PAIRS = 1 << 20


def _least(lag: np.ndarray) -> np.ndarray:
    """Matches in a row that the shortest run of a period has."""
    return np.maximum(LEAST_WORDS, LEAST_TIMES * lag) - lag


def _autocorrelation(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """Matches at each lag to ``most`` of the words that stand at ``places`` (an array a word) of ``n``."""
    size = 1 << (n + most - 1).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        flags = np.zeros(size)
        flags[at] = 1
        spectrum = np.fft.rfft(flags)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_counts(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each text equal the word that stands each lag on, for lags to a quarter of the text, and where each text's counts begin.

    ``words`` are the numbers of the words of all texts, which begin at ``first``. A text's place 0 is unused.
    """
    n = np.diff(first)
    most = n // LEAST_TIMES
    base = np.concatenate([[0], np.cumsum(most + 1)])
    counts = np.zeros(int(base[-1]), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, text))
    if not len(order):
        return counts, base
    ranked, owner = words[order], text[order]
    head = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (owner[1:] != owner[:-1])]))
    often = np.diff(np.append(head, len(order)))
    size = n[owner[head]]
    heavy = often > np.maximum(32, np.sqrt(size * np.log2(size + 1)))
    for t in np.unique(owner[head[heavy]]).tolist():
        mine = heavy & (owner[head] == t)
        places = [order[a : a + m] - first[t] for a, m in zip(head[mine].tolist(), often[mine].tolist(), strict=True)]
        counts[base[t] : base[t + 1]] += _autocorrelation(places, int(n[t]), int(most[t]))
    # places of light words by word: the k-th next place of the same word, for every k that some word has
    light = ~heavy & (often > 1)
    group = np.repeat(np.arange(int(light.sum())), often[light])
    places = order[np.repeat(light, often)]
    for at in range(0, len(places), PAIRS):
        # a light word stands at few places, so its group ends soon behind this slice
        stop = int(np.searchsorted(group, group[min(at + PAIRS, len(places)) - 1], side="right"))
        rows = np.arange(at, min(at + PAIRS, len(places)))
        k = 1
        while len(rows):
            rows = rows[rows + k < stop]
            rows = rows[group[rows] == group[rows + k]]
            apart, t = places[rows + k] - places[rows], text[places[rows]]
            near = apart <= most[t]
            rows = rows[near]  # a further place of the word is further away still
            np.add.at(counts, base[t[near]] + apart[near], 1)
            k += 1
    counts[base[:-1]] = 0
    return counts, base


def _stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one behind the last of the stretches of at least ``least`` true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    a, b = edges[::2], edges[1::2]
    long = b - a >= least
    return a[long], b[long]


def _islands(words: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``least`` places in a row that match ``lag`` on."""
    apart = max(1, lag // 4)
    n = len(words) - lag
    points = words[0:n:apart] == words[lag::apart]
    for a, b in zip(*(x.tolist() for x in _stretches(points, max(1, least // apart))), strict=True):
        # the check points before and behind don't match, so what lies between them is whole
        x, y = max(0, (a - 1) * apart + 1), min(n, b * apart)
        if apart == 1:
            yield x, y
            continue
        for s, e in zip(*(v.tolist() for v in _stretches(words[x:y] == words[x + lag : y + lag], least)), strict=True):
            yield x + s, x + e


def _runs(words: np.ndarray, counts: np.ndarray, lags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one text from its ``counts`` and the ``lags`` (ascending) with enough of them."""
    found: dict[int, list[tuple[int, int]]] = {}
    for lag in lags.tolist():
        least = int(_least(np.int64(lag)))
        if counts[lag] < least:
            continue  # its matches lay in runs of a divisor, which have been taken off
        for s, e in _islands(words, lag, least):
            length = e - s + lag
            if any(lag % p == 0 and m == length for m, p in found.get(s, ())):
                continue
            found.setdefault(s, []).append((length, lag))
            more = np.arange(2 * lag, min(len(counts), length), lag)
            counts[more] -= length - more
    return sorted((s, m, p) for s, runs in found.items() for m, p in runs)


def runs_of(words: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of all runs of each text, by start, then period; ``words`` are numbered words of texts that begin at ``first``."""
    counts, base = lag_counts(words, first)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    enough = np.flatnonzero((counts >= _least(lag)) & (lag > 0))
    edges = np.searchsorted(enough, base)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    for t in np.flatnonzero(np.diff(edges)).tolist():
        out[t] = _runs(words[first[t] : first[t + 1]], counts[base[t] : base[t + 1]], lag[enough[edges[t] : edges[t + 1]]])
    return out


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period alone."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _word_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a chunk of texts, and where each text's begin."""
    split = pc.ascii_split_whitespace(column)
    flat = split.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), bool)
    before = np.concatenate([[0], np.cumsum(full)])
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(pa.array(full)), before[offsets]


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the periodic runs of their texts and the texts without repetition.

    New are ``n_words``, ``runs`` (structs of start, length and period, by start, then period),
    ``kept_words`` and ``collapsed`` (the words that no run repeats, joined by one space); columns
    of these names are replaced. A run is a stretch of at least six words and four times its
    smallest period that no neighbouring word extends; words are told apart by their bytes, and
    blanks are the six of ASCII. Null and empty texts have no words and no runs. Rows that
    repeat, and rows without an id, are looked at as any others.
    """
    own = ["n_words", "runs", "kept_words", "collapsed"]
    base = docs.drop(*own)
    names = base.columns
    schema = with_fields(base, "n_words long, runs array<struct<start:long,length:long,period:long>>, kept_words long, collapsed string")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch)
            _, offsets = buffers(column)
            for x, y in chunks(offsets):
                words, first = _word_lists(column.slice(x, y - x))
                numbers = words.dictionary_encode().indices.to_numpy()
                all_runs, keep = runs_of(numbers, first), np.ones(len(words), bool)
                for t, runs in enumerate(all_runs):
                    if runs:
                        keep[first[t] : first[t + 1]] = _kept(int(first[t + 1] - first[t]), runs)
                before = np.concatenate([[0], np.cumsum(keep)])[first]
                left = pa.ListArray.from_arrays(pa.array(before, pa.int32()), words.filter(pa.array(keep)))
                listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in all_runs], run_type)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(x, y - x) for n in names), pa.array(np.diff(first), pa.int64()), listed, pa.array(np.diff(before), pa.int64()), pc.binary_join(left, pa.scalar(" ", words.type)).cast(pa.string())],
                    [*names, *own])

    return base.mapInArrow(run, schema)

