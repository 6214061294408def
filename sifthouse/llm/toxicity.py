"""Toxicity scores by a convolutional text classifier over hashed words, trained in numpy.

Words and their first letters hash to rows of an embedding table, of which a word's vector is the
sum, so that forms of one stem are alike; filters of one, two and three words slide over a text
and their greatest responses feed a logistic output. The network is fitted on the driver with a
bounded sample of labelled documents (``max_train``); scoring passes over all documents in one
stage. Thresholds are calibrated by language on a part of the sample kept from fitting: a
document's language is guessed from its text alone, and the score maps that language's best
threshold to ``AT``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import relieve
from .shared import SALTS, Words, buffers, chunks, free_prefix, span_hashes, text_column, with_fields

BITS = 16
WIDTHS = (1, 2, 3)
#: Bytes of a word that make up its features; 0 stands for all of them. A word's vector is the sum of theirs.
HEADS = (0, 4)
#: The score that stands for a language's threshold.
AT = 0.7
#: Toxic rows that a threshold is taken from, at least.
LEAST_KEPT = 20
#: Words that go through the filters together.
SPAN_WORDS = 1 << 16
_SPLITS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of every word of every text and of the word's first letters, and where each text's words begin."""
    words = Words(data, offsets, _SPLITS, lower=True)
    size = words.end - words.start
    parts = [span_hashes(words.bytes, words.start, np.minimum(size, n) if n else size, (SALTS[0] + i,))[0] for i, n in enumerate(HEADS)]
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in parts], axis=1), words.first


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, dim, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str]
    language_log: np.ndarray  # (buckets, languages)
    threshold: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0

    def responses(self, padded: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Each filter's response from each word on, 0 where no word stands; the last words look at no further ones."""
        vectors = sum(self.embedding[padded[:, j]] for j in range(padded.shape[1]))
        answers = []
        for width, filters, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            response = vectors @ filters[0]
            for j in range(1, width):
                response[:-j] += vectors[j:] @ filters[j]
            response += bias
            response[~inside] = 0
            answers.append(response)
        return np.concatenate(answers, axis=1)

    def padded(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets with empty places behind each text, which of them are words, and where the texts begin."""
        pad = max(WIDTHS) - 1
        n = np.diff(first)
        padded = np.insert(buckets, np.repeat(first[1:], pad), np.int32(len(self.embedding) - 1), axis=0)
        starts = first[:-1] + pad * np.arange(len(n))
        inside = np.ones(len(padded), bool)
        for j in range(pad):
            inside[starts + n + j] = False
        return padded, inside, starts

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Outputs by the greatest response of each filter in each text; long texts go through in spans that overlap by a filter."""
        padded, inside, starts = self.padded(buckets, first)
        best = np.zeros((len(starts), len(self.out)), np.float32)
        for x in range(0, len(padded), SPAN_WORDS):
            y = min(x + SPAN_WORDS, len(padded))
            more = min(y + max(WIDTHS) - 1, len(padded))
            response = self.responses(padded[x:more], inside[x:more])[: y - x]
            a, b = int(np.searchsorted(starts, x, side="right")) - 1, int(np.searchsorted(starts, y))
            best[a:b] = np.maximum(best[a:b], np.maximum.reduceat(response, np.maximum(starts[a:b], x) - x, axis=0))
        return best @ self.out + self.out_bias

    def guess(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest language of each text, by its words."""
        summed = np.zeros((len(first) - 1, len(self.languages)))
        for x in range(0, len(buckets), SPAN_WORDS):
            some = buckets[x : x + SPAN_WORDS]
            text = np.repeat(np.arange(len(first) - 1), np.diff(np.clip(first, x, x + len(some))))
            for i in range(len(self.languages)):
                summed[:, i] += np.bincount(text, self.language_log[some[:, 0], i], minlength=len(summed))
        return np.argmax(summed, axis=1)

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        language = self.guess(buckets, first)
        limits = np.array([self.threshold.get(name, self.threshold[""]) for name in self.languages])[language]
        z = self.slope * (self.logits(buckets, first).astype(np.float64) - limits) + np.log(AT / (1 - AT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), language


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*rows, np.zeros((0, len(HEADS)), np.int32)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int, str]], dim: int = 16, filters: int = 12, epochs: int = 3, batch: int = 32, rate: float = 0.02, seed: int = 3) -> Network:
    """A network from ``(buckets, toxic, language)`` rows; every fifth row calibrates instead of fitting."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    languages = sorted({lang for _, _, lang in rows}) or [""]
    fitting, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    toxic = np.zeros(size)
    clean = np.zeros(size)
    log = np.zeros((size, len(languages)))
    for buckets, label, lang in fitting:
        seen = np.unique(buckets)
        (toxic if label else clean)[seen] += 1
        mine, count = np.unique(buckets[:, 0], return_counts=True)
        log[mine, languages.index(lang)] += count
    log = np.log((log + 0.05) / (log.sum(axis=0) + 0.05 * size)).astype(np.float32)
    positives = max(1, sum(r[1] for r in fitting))
    odds = np.log((toxic + 0.3) / (positives + 0.6)) - np.log((clean + 0.3) / (max(1, len(fitting) - positives) + 0.6))
    odds[toxic + clean < 3] = 0
    # half of the filters start as sums of log odds, the others as anything: training shapes both
    preset = filters // 2
    embedding = rng.normal(0, 0.2, (size + 1, dim)).astype(np.float32)
    embedding[:size, 0] = np.clip(odds, -2, 4)
    embedding[size] = 0
    shapes = [rng.normal(0, 1 / np.sqrt(w * dim), (w, dim, filters)).astype(np.float32) for w in WIDTHS]
    for f in shapes:
        f[:, :, :preset] *= 0.3
        f[:, 0, :preset] = 0.5 / len(f)
        f[:, 0, preset:] *= 0.3
    starts_at = np.where(np.arange(filters) < preset, -0.3, 0.0).astype(np.float32)
    out = np.tile(np.where(np.arange(filters) < preset, 0.1, 0.0), len(WIDTHS)) + rng.normal(0, 0.1, filters * len(WIDTHS))
    net = Network(embedding, shapes, [starts_at.copy() for _ in WIDTHS], out.astype(np.float32), -1.0, languages, log)
    squared = {k: 1e-3 for k in ("out_bias",)}
    accumulated = {"embedding": np.full(size + 1, 1e-3, np.float32), "out": np.full_like(net.out, 1e-3), **{("f", i): np.full_like(f, 1e-3) for i, f in enumerate(net.filters)}, **{("b", i): np.full_like(b, 1e-3) for i, b in enumerate(net.bias)}}

    def step(key, value: np.ndarray, grad: np.ndarray) -> None:
        accumulated[key] += grad * grad
        value -= rate * grad / np.sqrt(accumulated[key])

    for _ in range(epochs if positives and fitting else 0):
        order = rng.permutation(len(fitting))
        for at in range(0, len(order), batch):
            some = [fitting[i] for i in order[at : at + batch]]
            buckets, first = _flat([r[0] for r in some])
            label = np.array([r[1] for r in some], np.float32)
            padded, inside, starts = net.padded(buckets, first)
            response = net.responses(padded, inside)
            ends = np.append(starts[1:], len(padded))
            peak = np.stack([response[a:b].argmax(axis=0) + a for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            best = np.maximum(response[peak, np.arange(response.shape[1])], 0)
            p = 1 / (1 + np.exp(-np.clip(best @ net.out + net.out_bias, -30, 30)))
            slope = (p - label) / len(some)
            into = slope[:, None] * net.out * (best > 0)
            step("out", net.out, best.T @ slope)
            squared["out_bias"] += float(slope.sum()) ** 2
            net.out_bias -= rate * float(slope.sum()) / np.sqrt(squared["out_bias"])
            rows_touched, grads = [], []
            column = 0
            for i, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g, where = into[:, column : column + f.shape[2]], peak[:, column : column + f.shape[2]]
                grad_f = np.zeros_like(f)
                for j in range(width):
                    words = padded[np.minimum(where + j, len(padded) - 1)]
                    grad_f[j] = np.einsum("df,dfe->ef", g, sum(net.embedding[words[..., k]] for k in range(words.shape[-1])))
                    for k in range(words.shape[-1]):
                        rows_touched.append(words[..., k].ravel())
                        grads.append((g[:, :, None] * f[j].T[None]).reshape(-1, f.shape[1]))
                step(("b", i), net.bias[i], g.sum(axis=0))
                step(("f", i), f, grad_f)
                column += f.shape[2]
            touched, inverse = np.unique(np.concatenate(rows_touched), return_inverse=True)
            total = np.zeros((len(touched), dim), np.float32)
            np.add.at(total, inverse, np.concatenate(grads))
            total[touched == size] = 0
            accumulated["embedding"][touched] += (total * total).mean(axis=1)
            net.embedding[touched] -= rate * total / np.sqrt(accumulated["embedding"][touched])[:, None]
    # a few kept examples say too little of where the threshold lies
    enough = sum(r[1] for r in held) >= LEAST_KEPT
    _calibrate(net, held if enough else held + fitting, LEAST_KEPT if enough else None)
    return net


def _best_threshold(z: np.ndarray, label: np.ndarray) -> float:
    """Between two answers, where F1 of the texts above is greatest."""
    order = np.argsort(-z)
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + label.sum())
    k = int(np.argmax(f1))
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + low) / 2)


def _calibrate(net: Network, rows: list[tuple[np.ndarray, int, str]], least: int | None) -> None:
    """Thresholds of all texts together and of the languages with ``least`` toxic ones (None: of no language)."""
    net.threshold = {"": 0.0}
    if not rows or not any(r[1] for r in rows):
        net.threshold = {"": 1e9}
        return
    z = np.concatenate([net.logits(*_flat([r[0]])) for r in rows]).astype(np.float64)
    label = np.array([r[1] for r in rows], np.float64)
    net.threshold = {"": _best_threshold(z, label)}
    guessed = np.array([net.guess(*_flat([r[0]]))[0] for r in rows])
    for i, name in enumerate(net.languages if least else ()):
        mine = guessed == i
        if label[mine].sum() >= least:
            net.threshold[name] = _best_threshold(z[mine], label[mine])
    spread = z.std() or 1.0
    net.slope = float(2.0 / spread)


def _runs(buckets: np.ndarray, most: int) -> np.ndarray:
    """All words of a short text; of a longer one ten runs, evenly spread, that make up ``most`` words."""
    if len(buckets) <= most:
        return buckets
    size = most // 10
    return np.concatenate([buckets[i * (len(buckets) - size) // 9 :][:size] for i in range(10)])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, max_words: int = 3_000) -> Network:
    """Fit on at most ``max_train`` labelled documents (a third of them toxic, if there are as many), chosen by a hash of their ids.

    A text of more than ``max_words`` words gives ten runs spread over it to the fitting, so
    the driver holds ``8 * max_train * max_words`` bytes of words at most. Null labels, texts
    and ids are left out; of several labels of a document the greatest counts, of several texts
    the one whose sampled words come first. Without a column ``lang`` one threshold holds for all.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    picked = known.filter("toxic = 1").orderBy("order", "doc_id").limit(max_train // 3).union(known.filter("toxic = 0").orderBy("order", "doc_id").limit(max_train - max_train // 3))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets):
                buckets, first = word_buckets(data, offsets[start : stop + 1])
                parts = [_runs(buckets[a:b], max_words).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, stop - start) for c in ("doc_id", "toxic", "lang")] + [pa.array(parts, pa.binary())], ["doc_id", "toxic", "lang", "buckets"])

    relieve(docs.sparkSession)
    # at most max_train ids, so the broadcast is bounded
    lang = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    text = docs.filter("text is not null").select("doc_id", "text", lang.alias("lang")).join(F.broadcast(picked.select("doc_id", F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    words = text.select("doc_id", "text", "lang", "toxic").mapInArrow(run, "doc_id long, toxic int, lang string, buckets binary")
    got = words.groupBy("doc_id").agg(F.min(F.struct("buckets", "lang", "toxic")).alias("x")).select("doc_id", "x.*").toArrow()
    parts, labels_, langs = got.column("buckets").combine_chunks(), got.column("toxic").to_pylist(), got.column("lang").to_pylist()
    rows = []
    for i in np.argsort(got.column("doc_id").to_numpy(), kind="stable").tolist():
        if (raw := parts[i].as_buffer()).size:
            rows.append((np.frombuffer(raw, np.int32).reshape(-1, len(HEADS)), int(labels_[i] == 1), langs[i]))
    raw = None
    np.random.default_rng(1).shuffle(rows)
    net = fit(rows)
    # the sample goes, and its room too
    del rows, parts, got
    pa.default_memory_pool().release_unused()
    relieve(docs.sparkSession)
    return net


def score(docs: DataFrame, net: Network, prefix: str = "") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``AT`` on) and ``guessed_lang`` behind ``prefix``.

    Empty and null texts have the score of a text without words. Rows that repeat or lack a
    ``doc_id`` are scored as any others. Other columns are kept, but those named as the new ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    own = [f"{prefix}{n}" for n in ("score", "predicted", "guessed_lang")]
    base = docs.drop(*own)
    names, schema = base.columns, with_fields(base, f"`{own[0]}` double, `{own[1]}` int, `{own[2]}` string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets, 1 << 18):
                value, language = model.scores(*word_buckets(data, offsets[start : stop + 1]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(start, stop - start) for n in names), pa.array(value), pa.array((value >= AT).astype(np.int32)), pa.array([model.languages[i] for i in language.tolist()], pa.string())],
                    [*names, *own])

    return base.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` that are not predicted as toxic, with all their columns."""
    own = free_prefix(docs, "toxic_")
    return score(docs, net, prefix=own).filter(F.col(f"{own}predicted") == 0).select(docs.columns)
