"""Quality scores by supervised subword embeddings, trained in numpy.

Every word, pair of neighbouring words and character n-gram of a word hashes to a row of a table
of learned vectors. A document is the mean of its features' vectors, and a softmax over two
outputs reads that mean. The table and the outputs are fitted together by stochastic gradient
descent on a bounded sample of labelled documents; scoring passes once over all documents.

A pair hashes by the difference of its words, so a word that follows itself has one feature
whatever the word is. N-grams take characters, with a mark before and behind the word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard, settle
from .shared import BLANKS, buffers, free_prefix, mix, text_column, with_fields

BITS = 18
NGRAMS = (3, 4, 5)
#: The score from which on a document is predicted as good.
AT = 0.7
#: Characters looked at together; only a longer word makes a longer piece.
PIECE = 1 << 17
#: Labelled rows kept from fitting that the threshold is taken from, of either label at least.
LEAST_KEPT = 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_KINDS = [np.uint64(0x2545F4914F6CDD1D + 2 * i) for i in range(len(NGRAMS) + 2)]


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces that end at a blank; the last word of one is where the next begins, so that every pair of words stands in one piece."""
    at = 0
    while len(data) - at > PIECE:
        some = np.frombuffer(data, np.uint8, PIECE, at)
        blanks = np.flatnonzero(BLANKS[some])
        if len(blanks) and blanks[-1]:
            end = at + int(blanks[-1])
        else:  # a word as long as a piece: to its end
            rest = np.flatnonzero(BLANKS[np.frombuffer(data, np.uint8, offset=at + PIECE)])
            end = at + PIECE + int(rest[0]) if len(rest) else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def _features(code: np.ndarray, before: np.uint64 | None) -> tuple[list[np.ndarray], np.uint64 | None]:
    """Hashes of the features of a piece's code points, and the last word's hash; ``before`` is that of the word before the piece."""
    blank = (code == 0x20) | ((code >= 0x09) & (code <= 0x0D))
    inside = np.concatenate([[False], ~blank, [False]])
    start = np.flatnonzero(~inside[:-1] & inside[1:])
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(start):
        return [], before
    # the words with one mark (0) between them: the mark before a word is that behind the last
    size = end - start
    keep = np.zeros(len(code) + 1, bool)
    keep[:-1] = ~blank
    keep[end] = True
    chars = np.where(blank, 0, code).astype(np.uint64)
    chars = np.concatenate([[np.uint64(0)], np.append(chars, np.uint64(0))[keep]])
    first = np.concatenate([[1], 1 + np.cumsum(size + 1)[:-1]])
    mixed = mix((chars + np.uint64(1)) * _STEP)
    place = np.arange(len(chars), dtype=np.uint64)
    place[first[0] :] -= np.repeat(first, size + 1).astype(np.uint64)
    summed = mixed * (np.uint64(2) * place + np.uint64(1))
    summed[chars == 0] = 0
    words = mix(np.add.reduceat(summed, first))
    out = [mix(words ^ _KINDS[0])]
    pairs = words if before is None else np.concatenate([[before], words])
    out.append(mix((pairs[1:] - pairs[:-1]) ^ _KINDS[1]))
    marks = np.cumsum(chars == 0)
    for i, n in enumerate(NGRAMS):
        if len(chars) >= n:
            gram = mixed[: len(mixed) - n + 1].copy()
            for j in range(1, n):
                gram = gram * np.uint64(0xD6E8FEB86659FD93) + mixed[j : len(mixed) - n + 1 + j]
            # no mark between the first and the last character
            whole = marks[n - 2 : len(marks) - 1] == marks[: len(marks) - n + 1]
            out.append(mix(gram[whole] ^ _KINDS[2 + i]))
    return out, words[-1]


def text_features(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of all features of a text in UTF-8, piece by piece."""
    before = None
    for piece in _pieces(data):
        code = np.frombuffer(piece.decode("utf-8").encode("utf-32-le"), "<u4")
        found, before = _features(code, before)
        if found:
            yield (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)


def feature_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how often each stands there; bounded by the table, whatever the text's length."""
    total = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for buckets in text_features(data):
        mine, count = np.unique(buckets, return_counts=True)
        both, where = np.unique(np.concatenate([total[0], mine]), return_inverse=True)
        total = both, np.bincount(where, np.concatenate([total[1], count]), minlength=len(both)).astype(np.int64)
    return total


@dataclass
class Model:
    vectors: np.ndarray  # (buckets, dim)
    out: np.ndarray  # (dim, 2)
    bias: np.ndarray  # (2,)
    threshold: float = 0.0
    slope: float = 1.0

    def logit(self, buckets: np.ndarray, weight: np.ndarray) -> float:
        """How much likelier label 1 is, from a document's mean vector."""
        mean = weight @ self.vectors[buckets] if len(buckets) else np.zeros(self.out.shape[0], np.float32)
        both = mean @ self.out + self.bias
        return float(both[1] - both[0])

    def scorer(self) -> Scorer:
        return Scorer((self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]), self.threshold, self.slope)


@dataclass
class Scorer:
    """What scoring needs of a model: the outputs are linear, so each bucket's part of them is taken before the mean."""

    part: np.ndarray
    bias: float
    threshold: float
    slope: float

    def score(self, data: bytes) -> float:
        total, n = 0.0, 0
        for buckets in text_features(data):
            total += float(self.part[buckets].sum(dtype=np.float64))
            n += len(buckets)
        z = self.slope * (total / max(n, 1) + self.bias - self.threshold) + np.log(AT / (1 - AT))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 16, epochs: int = 3, rate: float = 0.5, seed: int = 7) -> Model:
    """A model from ``(buckets, counts, label)`` rows; every fifth row sets the threshold instead of being fitted."""
    rng = np.random.default_rng(seed)
    model = Model((rng.normal(0, 1, (1 << BITS, dim)) / dim).astype(np.float32), np.zeros((dim, 2), np.float32), np.zeros(2, np.float32))
    rows = [(b, (c / c.sum()).astype(np.float32) if len(c) else c.astype(np.float32), y) for b, c, y in rows]
    fitting, kept = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    steps, t = epochs * len(fitting), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fitting)).tolist():
            buckets, weight, label = fitting[i]
            if not len(buckets):
                continue
            step = np.float32(rate * (1 - t / steps))
            t += 1
            held = model.vectors[buckets]
            mean = weight @ held
            z = mean @ model.out + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = model.out @ p
            model.out -= step * np.outer(mean, p)
            model.bias -= step * p
            # a mean of many vectors moves each of them little: the step takes the weights to a sum of squares of one
            model.vectors[buckets] = held - (step * weight / np.float32(max(float(weight @ weight), 1e-6)) ** 0.5)[:, None] * back
    enough = min(sum(y == label for _, _, y in kept) for label in (0, 1)) >= LEAST_KEPT
    _calibrate(model, kept if enough else rows)
    return model


def _calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The threshold where the mean of both labels' accuracies is greatest, between two outputs."""
    label = np.array([y for _, _, y in rows], np.float64)
    if not len(label) or label.all() or not label.any():
        # nothing to tell apart: every document has the only label seen, 1 where there is none
        model.threshold = 1e9 if len(label) and not label.any() else -1e9
        return
    z = np.array([model.logit(b, w) for b, w, _ in rows])
    order = np.argsort(z, kind="stable")
    below = np.cumsum(1 - label[order]) / (1 - label).sum()
    above = 1 - np.cumsum(label[order]) / label.sum()
    best = below + above
    k = int(np.argmax(best[:-1])) if len(best) > 1 else 0
    model.threshold = float((z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2)
    model.slope = float(4.0 / (z.std() or 1.0))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 3_000, max_entries: int = 6_000_000) -> Model:
    """Fit on at most ``max_train`` labelled documents, half of them of the rarer label if there are as many, chosen by a hash of their ids.

    Whole texts are counted by feature on the executors. The counts that come to the driver have
    ``max_entries`` entries of eight bytes at most: documents beyond that, in the order of the
    hash, are left out of the fitting. Null labels, texts and ids are left out; of several labels
    of a document the smallest counts, of several texts the one of the least counts.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("order", F.xxhash64("doc_id", F.lit(17)))
    picked = None
    for label in (0, 1):
        some = known.filter(F.col("quality") == label).orderBy("order", "doc_id").limit(max_train // 2)
        picked = some if picked is None else picked.union(some)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for i in range(batch.num_rows):
                buckets, count = feature_counts(data[offsets[i] : offsets[i + 1]].tobytes())
                packed = np.stack([buckets, np.minimum(count, 2**31 - 1).astype(np.int32)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("doc_id", "quality", "order")), pa.array([len(buckets)], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["doc_id", "quality", "order", "n", "counts"])

    # at most max_train ids, so the broadcast is bounded
    text = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked.withColumn("quality", F.col("quality").cast("int"))), "doc_id")
    counted = settle(text.select("doc_id", "quality", "order", "text").mapInArrow(run, "doc_id long, quality int, order long, n int, counts binary"))
    # a row an id: as many as were picked, so one window holds them
    one = counted.groupBy("doc_id", "quality", "order").agg(F.min(F.struct("n", "counts")).alias("x")).select("doc_id", "quality", "order", "x.n", "x.counts")
    size = one.withColumn("upto", F.sum(F.col("n").cast("long")).over(Window.orderBy("order", "doc_id")))
    got = size.filter(F.col("upto") <= max_entries).select("order", "doc_id", "quality", "counts").toArrow()
    discard(counted)
    packed, label = got.column("counts").combine_chunks(), got.column("quality").to_pylist()
    rows = []
    for i in np.lexsort((got.column("doc_id").to_numpy(), got.column("order").to_numpy())).tolist():
        both = np.frombuffer(packed[i].as_buffer(), np.int32).reshape(2, -1)
        rows.append((both[0], both[1], label[i]))
    return fit(rows)


def score(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``AT`` on) behind ``prefix``.

    Empty and null texts have the score of a text without features. Rows that repeat or lack a
    ``doc_id`` are scored as any others. Other columns are kept, but those named as the new ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())
    own = [f"{prefix}{n}" for n in ("score", "predicted")]
    base = docs.drop(*own)
    names, schema = base.columns, with_fields(base, f"`{own[0]}` double, `{own[1]}` int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            value = np.array([scorer.score(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(value), pa.array((value >= AT).astype(np.int32))], [*names, *own])

    return base.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are predicted as good, with all their columns."""
    own = free_prefix(docs, "quality_")
    return score(docs, model, prefix=own).filter(F.col(f"{own}predicted") == 1).select(docs.columns)
