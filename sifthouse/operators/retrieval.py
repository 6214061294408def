"""Retrievers: each gives ranked candidates with a total order (score, then id)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions.scores import dot, doubles, hamming
from ..functions.text import tokens
from ..session import settle

K1, B = 1.2, 0.75


def _times(words: Column, term: str) -> Column:
    """How often a word, or the words of a phrase in a row, stand in ``words``."""
    parts = term.split(" ")
    if len(parts) == 1:
        return F.size(F.filter(words, lambda x: x == term))
    phrase = F.array(*map(F.lit, parts))
    return F.size(F.filter(F.transform(words, lambda x, i: F.slice(words, i + 1, len(parts)) == phrase), lambda same: same))


def _counts(columns: dict[str, float], terms: list[str]) -> Column:
    """``len`` and the weighted counts ``f0, f1, ...`` of the terms; each column's tokens are found once."""
    def column(name: str, weight: float) -> Column:
        counts = lambda t: F.struct(F.size(t).cast("double").alias("len"), *(_times(t, term).cast("double") * F.lit(weight) for term in terms))
        return F.transform(F.array(tokens(F.coalesce(F.col(name), F.lit("")))), lambda t: counts(t))[0]

    parts = [column(c, w) for c, w in columns.items()]
    fields = ["len", *(f"f{j}" for j in range(len(terms)))]
    parts = [p.cast(f"struct<{','.join(f + ':double' for f in fields)}>") for p in parts]
    return F.transform(F.array(F.array(*parts)), lambda all_: F.struct(*(
        reduce(lambda a, b: a + b, (all_[i][f] for i in range(len(parts)))).alias(f) for f in fields)))[0]


def bm25(docs: DataFrame, terms: list[str], key: str, columns: dict[str, float], limit: int = 200, places: int | None = None, average_nulls: bool = True) -> DataFrame:
    """Okapi BM25 over weighted text columns: rows that hold all terms, filled up by rows with any where those are under a quarter of ``limit``.

    One pass counts the terms and keeps the narrow rows that hold any; the corpus statistics are
    observed on the way. No word of the corpus is exploded or shuffled. A term of several words
    is a phrase, which counts as one word.

    Scores are ranked as they are returned: rounded to ``places`` decimals, if given. A row
    without any text counts as a row; unless ``average_nulls``, it has no part in the average
    length. Of equal scores the smaller key comes first, and null keys last.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    told = F.lit(True) if average_nulls else F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()
    tf = docs.select(key, _counts(columns, terms).alias("x"), told.alias("told")).select(key, "x.*", "told")
    f = [F.col(f"f{j}") for j in range(len(terms))]
    seen = Observation()
    tf = tf.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("told").alias("told"), F.sum("len").alias("words"), *(F.count_if(x > 0).alias(f"n{j}") for j, x in enumerate(f)))
    held = settle(tf.filter(reduce(lambda a, b: a | b, (x > 0 for x in f))).drop("told"))
    stats = seen.get
    n, score = stats["n"], F.lit(0.0)
    average = (stats["words"] or 0.0) / max(stats["told"], 1) or 1.0
    for j, x in enumerate(f):
        idf = max(math.log((n - stats[f"n{j}"] + 0.5) / (stats[f"n{j}"] + 0.5)), 1e-6)
        score = score + F.lit(idf) * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("len") / average))
    ranked = held.select(key, (score if places is None else F.round(score, places)).alias("score"), reduce(lambda a, b: a & b, (x > 0 for x in f)).alias("full"))
    if ranked.filter("full").limit(-(-limit // 4)).count() >= limit / 4:
        ranked = ranked.filter("full")
    return ranked.orderBy(F.desc("score"), F.asc_nulls_last(key)).limit(limit)


def contains_phrase(docs: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Rows whose tokens hold the phrase's tokens in a row."""
    line = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
    return docs.filter(line.contains(f" {' '.join(phrase.lower().split())} ")).select(key)


def word_shares(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, text: str, floor: float) -> DataFrame:
    """``query_key, key, score``: the share of each query's words that a text holds, at ``floor`` or more; a stand-in for a reranker's verdict.

    A text's distinct words meet the queries that ask for them and are counted by query and text,
    in the task that has the text before anything is shuffled, where the queries' words are few
    enough to be broadcast. Only narrow counts are shuffled: neither side's words go with a pair.
    """
    asked = queries.select(F.col(query_key).alias("q"), F.array_distinct(tokens(F.col(query_text))).alias("qw"))
    spread = asked.select("q", F.size("qw").alias("n"), F.explode("qw").alias("t"))
    words = docs.select(F.col(key).alias("d"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("t"))
    counted = words.join(spread, "t").groupBy("q", "d").agg((F.count("*") / F.min("n")).alias("score"))
    return counted.filter(F.col("score") >= floor).select(F.col("q").alias(query_key), F.col("d").alias(key), "score")


def name_search(rows: DataFrame, terms: list[str], key: str, name: str, limit: int = 50) -> DataFrame:
    """Share of terms (three characters or more) that a name holds anywhere."""
    used = [t.lower() for t in terms if len(t) >= 3]
    low = F.lower(F.col(name))
    share = reduce(lambda a, b: a + b, (F.when(low.contains(t), 1).otherwise(0) for t in used)) / float(len(used))
    return rows.select(key, share.alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(limit)


def dense_topk(vectors: DataFrame, query: Column, key: str, vector: str, k: int, floor: float | None = None) -> DataFrame:
    scored = vectors.select(key, dot(F.col(vector), query).alias("score"))
    if floor is not None:
        scored = scored.filter(F.col("score") >= floor)
    return scored.orderBy(F.desc("score"), key).limit(k)


def dense_topk_batch(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """``query_id, id, score, rank`` of the ``k`` best of all ``vectors(id, v)`` for each of ``queries(query_id, q)``, without the query's own id.

    Vectors of one length; both sides are packed into blocks of bounded size, and each pair of
    blocks gives at most ``k`` rows a query.
    """
    a, b = packed_blocks(queries.toDF("id", "v")), packed_blocks(vectors)
    best = block_best(a, b, k, floor)
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("src").alias("query_id"), F.col("dst").alias("id"), "score", "rank")


#: Vectors of a block.
BLOCK = 4_096


def packed_blocks(vectors: DataFrame) -> DataFrame:
    """``block, ids, flat``: ``vectors(id, v)`` in blocks of about ``BLOCK`` rows, each one row."""
    count = vectors.count()
    blocks = max(1, -(-count // BLOCK))
    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.struct(F.col("id").cast("long").alias("id"), doubles(F.col("v")).alias("v")).alias("x"))
    packed = dealt.groupBy("block").agg(F.collect_list("x").alias("x"))
    return settle(packed.select("block", F.col("x.id").alias("ids"), F.flatten("x.v").alias("flat")))


#: Components of the vectors that a task holds, and of those that it passes by them at most; tasks at least, where blocks are enough.
HELD, PASSED, WAYS = 1 << 22, 1 << 24, 48


class _Best:
    """The ``k`` best of each of some vectors among those that pass by in blocks: the larger score, then the smaller id.

    A product in single precision chooses what can be among them, with room for its rounding;
    those are scored exactly. Of equal vectors of a block the smallest ids are enough.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: float | None):
        self.ids, self.x, self.k, self.floor = ids, x, k, floor
        self.score, self.near = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = np.full(len(ids), -np.inf if floor is None else floor)
        self.single = self._fits(x)
        self.narrow, self.norm = x.astype(np.float32) if self.single else x, np.sqrt((x * x).sum(axis=1))

    @staticmethod
    def _fits(x: np.ndarray) -> bool:
        return bool(np.all(np.abs(x) < 1e15))

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        by_id = np.argsort(ids)
        ids, y = ids[by_id], y[by_id]
        _, kind, often = np.unique(y.view(np.dtype((np.void, y.strides[0]))).ravel(), return_inverse=True, return_counts=True)
        if often.max(initial=0) > self.k + 1:
            order = np.argsort(kind, kind="stable")
            few = np.sort(order[np.arange(len(order)) - np.repeat(np.cumsum(often) - often, often) <= self.k])
            ids, y = ids[few], y[few]
        single = self.single and self._fits(y)
        x, other = (self.narrow, y.astype(np.float32)) if single else (self.x, y)
        top = np.sqrt((y * y).sum(axis=1)).max(initial=0.0)
        room = (y.shape[1] + 4) * 2.0**-23 * self.norm * top + 1e-35 * (1 + self.norm + top) if single else np.full(len(x), 1e-9)
        own = [np.searchsorted(ids, self.ids, side) for side in ("left", "right")]
        for at in range(0, len(x), 512):
            s, near = x[at : at + 512] @ other.T, room[at : at + 512]
            if not single:
                s[np.isnan(s)] = -np.inf
            for r in np.flatnonzero(own[0][at : at + 512] < own[1][at : at + 512]):
                s[r, own[0][at + r] : own[1][at + r]] = -np.inf
            ok = s >= (self.least[at : at + 512] - near).astype(s.dtype)[:, None]
            full = np.flatnonzero(np.count_nonzero(ok, axis=1) > self.k)
            if len(full):
                least = np.partition(s[full], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                ok[full] &= s[full] >= (least - 2 * near[full]).astype(s.dtype)[:, None]
            rows, cols = np.nonzero(ok & (s > -np.inf))
            for some in range(0, len(rows), 1 << 15):  # bounds what is unpacked at once
                self._take(at + rows[some : some + (1 << 15)], cols[some : some + (1 << 15)], ids, y)

    def _take(self, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        exact = np.array([math.fsum(p) for p in (self.x[rows] * y[cols]).tolist()])
        keep = exact >= self.least[rows]
        rows, near, exact = rows[keep], ids[cols[keep]], exact[keep]
        here = np.unique(rows)
        rows = np.concatenate([np.repeat(here, self.k), rows])
        near, exact = np.concatenate([self.near[here].ravel(), near]), np.concatenate([self.score[here].ravel(), exact])
        order = np.lexsort((near, -exact, rows))
        rows, near, exact = rows[order], near[order], exact[order]
        first = np.searchsorted(rows, here)[:, None] + np.arange(self.k)
        self.near[here], self.score[here] = near[first], exact[first]
        self.least[here] = np.maximum(self.least[here], self.score[here, -1])

    def found(self) -> pa.RecordBatch:
        rows, cols = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[rows], pa.int64()), pa.array(self.near[rows, cols], pa.int64()), pa.array(self.score[rows, cols], pa.float64())], ["src", "dst", "score"])


def block_best(left: DataFrame, right: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """``src, dst, score``: for each vector of the left blocks its ``k`` best of each share of the right blocks by inner product, at ``floor`` or more.

    Ids are unique. A task holds some left blocks and lets a share of the right ones pass by, so
    it gives ``k`` rows a vector however many pass, and both sides are copied as often as the
    other has shares. All pairs are compared.
    """
    size = lambda blocks: blocks.agg(F.coalesce(F.sum(F.size("flat")), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    a, b = size(left), size(right)
    groups = max(1, min(a["n"], -(-a["size"] // HELD)))
    shares = max(1, min(b["n"], max(-(-WAYS // groups), -(-b["size"] // PASSED))))
    held = left.select(F.pmod("block", F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(False).alias("passes"), "block", "ids", "flat")
    passed = right.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod("block", F.lit(shares)).alias("share"), F.lit(True).alias("passes"), "block", "ids", "flat")
    unit = (F.col("group") * shares + F.col("share")).cast("int")
    dealt = held.unionByName(passed).withColumn("unit", unit).repartitionById(groups * shares, F.col("unit")).sortWithinPartitions("unit", "passes", "block").select("unit", "passes", "ids", "flat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, mine, best = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                if (unit := batch.column("unit")[i].as_py()) != here:
                    if best:
                        yield best.found()
                    here, mine, best = unit, [], None
                ids, flat = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "flat"))
                if not batch.column("passes")[i].as_py():
                    mine.append((ids, flat.reshape(len(ids), -1)))
                elif mine or best:
                    best = best or _Best(np.concatenate([m[0] for m in mine]), np.concatenate([m[1] for m in mine]), k, floor)
                    mine = []
                    best.meet(ids, flat.reshape(len(ids), -1))
        if best:
            yield best.found()

    return dealt.mapInArrow(run, "src long, dst long, score double")


def hash_search(rows: DataFrame, query: int | Column, key: str, column: str, most: int = 10, limit: int = 50) -> DataFrame:
    distance = hamming(F.col(column), F.lit(query) if isinstance(query, int) else query)
    return rows.select(key, distance.alias("distance")).filter(F.col("distance") <= most).orderBy("distance", key).limit(limit)


def folded_hashes(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, head`` of the rows whose hash a smaller key has too: copies stand behind their head."""
    first = rows.groupBy(F.col(column).alias("h")).agg(F.min(key).alias("head"))
    return rows.select(F.col(key).alias("k"), F.col(column).alias("h")).join(first, "h").filter("k <> head").select(F.col("k").alias(key), "head")


def hash_pairs(rows: DataFrame, key: str, column: str, most: int, bits: int = 64) -> DataFrame:
    """``a, b, distance``: pairs of different hashes of ``bits`` bits that are within ``most``, each named by its smallest key.

    Hashes cut into ``most + 1`` bands agree in one band at least, so bands of at least some bits
    are joined, and a pair is verified in the first band it shares.
    """
    first = settle(rows.groupBy(F.col(column).alias("h")).agg(F.min(key).alias("k")))
    bands = most + 1
    edges = [bits * i // bands for i in range(bands + 1)]
    part = lambda h, i: F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    cut = first.select("k", "h", F.posexplode(F.array(*(part(F.col("h"), i) for i in range(bands)))).alias("band", "part"))
    a, b = cut.toDF("a", "ha", "band", "part"), cut.toDF("b", "hb", "band", "part")
    met = a.join(b, ["band", "part"]).filter("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb"))).filter(F.col("distance") <= most)
    earlier = [part(F.col("ha"), i) == part(F.col("hb"), i) for i in range(bands)]
    repeated = reduce(lambda x, y: x | y, ((F.col("band") > i) & e for i, e in enumerate(earlier)))
    return met.filter(~repeated).select("a", "b", "distance")
