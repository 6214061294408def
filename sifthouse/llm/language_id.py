"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts up to four bytes long counts what followed them in a
bounded sample of its documents; the counts are then frozen. The code length of a byte is that of
its count in the longest context that knows it, plus the escapes from the longer contexts that
don't. A text's language is the one whose tree codes all of its bytes in the fewest bits.

A byte's code lengths depend only on it and the four bytes before, so workers remember them for
each five bytes met; every byte of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pieces import PieceTable
from .shared import LOWER, buffers, chunks, mix, text_column, with_fields

ORDER = 4
UNDETERMINED = "und"
#: Bytes that are coded together.
SPAN_BYTES = 1 << 19


def grams(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each byte with the four before it in its text (blanks before its begin), as one number."""
    place = np.arange(len(b)) - np.repeat(edges[:-1], np.diff(edges))
    code = b.astype(np.uint64)
    for j in range(1, ORDER + 1):
        before = np.full(len(b), 32, np.uint64)
        if len(b) > j:
            before[j:] = np.where(place[j:] >= j, b[:-j], 32)
        code |= before << np.uint64(8 * j)
    return code


class Tree:
    """Frozen counts of one language: per order, sorted contexts with totals and sorted grams with counts."""

    def __init__(self, codes: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            gram, count = np.unique(codes & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True)
            context, inverse = np.unique(gram >> np.uint64(8), return_inverse=True)
            total = np.bincount(inverse, count)
            self.levels.append((gram, count, context, total, np.bincount(inverse)))

    @staticmethod
    def _look(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte: escapes weigh the distinct followers of a context against its total."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            gram, count, context, total, kinds = self.levels[order]
            mine = codes[open_] & np.uint64((1 << 8 * (order + 1)) - 1)
            c = self._look(context, mine >> np.uint64(8))
            g = self._look(gram, mine)
            whole = total[c] + kinds[c]
            hit, escape = g >= 0, (g < 0) & (c >= 0)
            out[open_[hit]] -= np.log2(count[g[hit]] / whole[hit])
            out[open_[escape]] -= np.log2(kinds[c[escape]] / whole[escape])
            open_ = open_[~hit]
            if not len(open_):
                break
        out[open_] += 8
        return out


class Model:
    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees

    def __getstate__(self):
        return {"languages": self.languages, "trees": self.trees}

    def code_lengths(self, b: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; a long text is coded span by span, each after the bytes before it."""
        if not hasattr(self, "table"):
            self.table, self.costs = PieceTable(keep=1_000_000), np.zeros((1 << 14, len(self.trees)), np.float32)
        out = np.zeros((len(edges) - 1, len(self.trees)))
        for x in range(0, len(b), SPAN_BYTES):
            y, before = min(x + SPAN_BYTES, len(b)), max(x - ORDER, 0)
            codes = grams(b[before:y], np.clip(edges, before, y) - before)[x - before :]
            number = self._numbers(codes)
            text = np.repeat(np.arange(len(edges) - 1), np.diff(np.clip(edges, x, y)))
            for i in range(len(self.trees)):
                out[:, i] += np.bincount(text, self.costs[:, i][number], minlength=len(out))
        return out

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        """Where the costs of each code stand; those of new ones are computed."""
        keys = mix(codes)
        number = self.table.find(keys, codes)
        missing = number < 0
        if missing.any():
            new = np.unique(codes[missing])
            if self.table.size + len(new) > self.table.keep:
                self.table.clear()
                new = np.unique(codes)
            places = self.table.add(mix(new), new)
            while self.table.size > len(self.costs):
                self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
            self.costs[places] = np.stack([t.bits(new) for t in self.trees], axis=1)
            number = self.table.find(keys, codes)
        return number


def _spans(text: bytes, most: int) -> bytes:
    """All of a short text; of a longer one ten spans, evenly spread, that make up ``most`` bytes."""
    if len(text) <= most:
        return text
    size = most // 10
    return b"".join(text[i * (len(text) - size) // 9 :][:size] for i in range(10))


def train(docs: DataFrame, per_language: int = 400, sample_bytes: int = 1_000_000) -> Model | None:
    """Trees for every language of ``docs(doc_id, text, lang)``, or None where no text is labelled.

    A language is learnt from at most ``sample_bytes`` of text: from about ``per_language`` rows,
    chosen by a hash of id and text among all its rows, each of which gives at most a fortieth of
    ``sample_bytes`` (of a longer text ten spans spread over it). Equal texts count once. A
    language of which no row is chosen (that happens where few texts repeat very often) is learnt
    from its row of least hash. Null and empty texts and null languages teach nothing.
    """
    known = docs.filter("lang is not null and text is not null and text <> ''").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each tree to be built
    if not sizes:
        return None
    limits = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, per_language / n) * 2**53))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_spans(t.encode().translate(LOWER), sample_bytes // 40) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(parts, pa.binary())], ["lang", "h", "part"])

    some = known.filter(F.pmod("h", F.lit(2**53)) < limits[F.col("lang")]).mapInArrow(run, "lang string, h long, part binary").distinct()
    texts: dict[str, list[bytes]] = {}
    for row in sorted(some.collect(), key=lambda r: (r["lang"], r["h"], r["part"])):
        mine = texts.setdefault(row["lang"], [])
        if sum(map(len, mine)) < sample_bytes:
            mine.append(bytes(row["part"]))
    if missing := sorted(sizes.keys() - texts.keys()):
        least = known.filter(F.col("lang").isin(missing)).groupBy("lang").agg(F.min(F.struct("h", "text")).alias("x")).select("lang", "x.h", "x.text")
        texts.update({r["lang"]: [bytes(r["part"])] for r in least.mapInArrow(run, "lang string, h long, part binary").collect()})
    trees = []
    for language in sorted(texts):
        rows = texts[language]
        edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        trees.append(Tree(grams(np.frombuffer(b"".join(rows), np.uint8), edges)))
    return Model(sorted(texts), trees)


_LETTERS = np.array([chr(c).isalpha() if c < 128 else False for c in range(256)])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of that language if all are equally likely before.

    Null texts and texts without a letter are ``und`` with score 0; so is every text where no
    language was learnt.
    """
    base = docs.drop("lang_pred", "score")
    names = base.columns
    schema = with_fields(base, "lang_pred string, score double")
    if model is None:
        return base.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets, 1 << 19):
                edges = offsets[start : stop + 1] - offsets[start]
                raw = data[offsets[start] : offsets[stop]].tobytes()
                b = np.frombuffer(raw.translate(LOWER), np.uint8)
                bits = ppm.code_lengths(b, edges)
                least = bits.min(axis=1)
                share = np.exp2(np.maximum(least[:, None] - bits, -1000))
                score = 1 / share.sum(axis=1)
                best = bits.argmin(axis=1)
                letters = np.concatenate([[0], np.cumsum(_LETTERS[b], dtype=np.int32)])
                plain = letters[edges[1:]] > letters[edges[:-1]]
                for i in np.flatnonzero(~plain).tolist():
                    plain[i] = any(map(str.isalpha, raw[edges[i] : edges[i + 1]].decode()))
                names_out = [ppm.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), plain.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(start, stop - start) for n in names), pa.array(names_out, pa.string()), pa.array(np.where(plain, score, 0.0))],
                    [*names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)
