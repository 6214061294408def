"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts by recursive spectral
bisection; a small network learns to tell a vector's part. Every vector is indexed under its most
probable part, and a query goes to its several most probable parts, as many as the sample needs
for the recall asked; there all vectors are compared exactly. Parts are split into blocks of
bounded size, and each query's best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle

SAMPLE = 8_000
#: A fixed number, so that the sample has some five hundred vectors of each part to learn from.
PARTS = 16
#: Vectors a block holds, and queries that are compared with it together, at most about.
BLOCK_ROWS, QUERY_ROWS = 8_192, 8_192
#: Fewer vectors don't make a graph to cut; there is one part.
LEAST_ROWS = 100


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Exact neighbours of each row by inner product, without itself."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1), axis=1)
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Cut a neighbour graph into ``parts`` (a power of two) of equal size: halve along the second eigenvector, again and again."""
    rng = np.random.default_rng(seed)
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    part = np.zeros(n, np.int64)
    size = 1
    while size < parts:
        side = np.zeros(n, np.int64)
        for p in range(size):
            mine = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[mine] = np.arange(len(mine))
            keep = (place[a] >= 0) & (place[b] >= 0)
            u, v = place[a[keep]], place[b[keep]]
            u, v = np.r_[u, v], np.r_[v, u]
            degree = np.bincount(u, minlength=len(mine)) + 1.0
            x = rng.normal(size=len(mine))
            for _ in range(120):
                x -= (x * degree).sum() / degree.sum()
                x = 0.5 * x + 0.5 * (np.bincount(u, x[v], minlength=len(mine)) + x) / degree
                x /= np.abs(x).max() or 1.0
            side[mine[np.argsort(x, kind="stable")[len(mine) // 2 :]]] = 1
        part = part * 2 + side
        size *= 2
    return part


class Router:
    """A network with one hidden layer that gives each part's probability."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.scale = float(np.sqrt((x * x).sum(axis=1).mean())) or 1.0
        x = (x / self.scale).astype(np.float32)
        dim = x.shape[1]
        w = [rng.normal(0, 1, (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        self.w = [v.astype(np.float32) for v in w]
        m, s, t = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), 256):
                i = order[at : at + 256]
                h = np.maximum(x[i] @ self.w[0] + self.w[1], 0)
                p = self._softmax(h @ self.w[2] + self.w[3])
                p[np.arange(len(i)), part[i]] -= 1
                p /= len(i)
                back = (p @ self.w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((x[i].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    s[j] = 0.999 * s[j] + 0.001 * g * g
                    self.w[j] -= 0.004 * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        z = np.maximum((x / self.scale).astype(np.float32) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part: all components finite, not all zero."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), double.alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(rows: DataFrame, count: int, recall: float, k: int) -> tuple[Router | None, int, int]:
    """The router, its number of parts, and how many a query asks; (None, 1, 1) below ``LEAST_ROWS``."""
    if count < LEAST_ROWS:
        return None, 1, 1
    place = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000))
    got = rows.filter(place < int(SAMPLE * 1_000_000 / count) + 1).orderBy("vec_id").limit(2 * SAMPLE).select("v").toArrow()
    x = _matrix(got.column("v").combine_chunks())
    parts = PARTS
    near = _nearest(x, min(k, len(x) - 1))
    part = balanced_parts(near[:, : min(10, near.shape[1])], parts)
    # every fourth row is kept from the router: what recall it gives shows on rows that it hasn't seen
    kept = np.arange(len(x)) % 4 == 0
    router = Router(x[~kept], part[~kept], parts)
    ranked = router.ranked(x)
    rank = np.empty_like(ranked)
    np.put_along_axis(rank, ranked, np.arange(parts)[None, :], axis=1)
    homes = ranked[:, 0]
    needed = np.take_along_axis(rank, homes[near], axis=1)[kept].ravel()
    probes = int(np.searchsorted(np.cumsum(np.bincount(needed, minlength=parts)) / len(needed), recall)) + 1
    return router, parts, min(probes, parts)


def _routed(rows: DataFrame, router: Router | None, probes: int) -> DataFrame:
    """``rows`` with ``parts``: the ``probes`` most probable of each."""
    if router is None:
        return rows.withColumn("parts", F.array(F.lit(0)))
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = shared.value.ranked(_matrix(batch.column("v")))[:, :probes] if batch.num_rows else np.zeros((0, probes))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, max(top.shape[1], 1)), pa.int32()), pa.array(top.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "parts"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, parts array<int>")


def _block_best(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        q_ids, q = left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks()) if left.num_rows else None
        c_ids, c = right.column("vec_id").to_numpy(), _matrix(right.column("v").combine_chunks()) if right.num_rows else None
        for at in range(0, len(q_ids) if c is not None else 0, 64):
            approx = q[at : at + 64] @ c.T
            approx[q_ids[at : at + 64][:, None] == c_ids[None, :]] = -np.inf
            for i, row in enumerate(approx):
                some = np.flatnonzero(row > -np.inf)
                if len(some) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    some = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
                exact = (c[some] * q[at + i]).sum(axis=1)
                best = np.lexsort((c_ids[some], -exact))[:k]
                out["query_id"].append(np.full(len(best), q_ids[at + i]))
                out["vec_id"].append(c_ids[some][best])
                out["score"].append(exact[best])
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in out.items()})

    return run


def _search(queries: DataFrame, indexed: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``queries(vec_id, v, parts)`` and ``indexed(vec_id, v, part)``.

    Both sides of a part are dealt into blocks of bounded size, which meet two by two.
    """
    asked = queries.select("vec_id", "v", F.explode("parts").alias("part"))
    blocks = lambda rows, size, name: rows.groupBy("part").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))
    sizes = blocks(indexed, BLOCK_ROWS, "blocks").join(blocks(asked, QUERY_ROWS, "turns"), "part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    held = indexed.join(sizes, "part").select("part", own("blocks", 1).alias("block"), every("turns").alias("turn"), "vec_id", "v")
    asked = asked.join(sizes, "part").select("part", every("blocks").alias("block"), own("turns", 2).alias("turn"), "vec_id", "v")
    by = ["part", "block", "turn"]
    best = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_block_best(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest rows of ``vectors`` by inner product, ties to the smaller id.

    Rows with a null id or a null, zero or non-finite vector take no part. Vectors are compared
    with those of their own length: of the commonest one by way of the learnt parts, of any other
    exactly. A query never finds rows of its own id; of queries that repeat an id the one with
    the least vector counts; rows that repeat an id and vector count once. A query that its parts
    leave with fewer than ``k`` rows is asked again over all parts.
    """
    rows, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not lengths:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dim, count = lengths[0]["n"], lengths[0]["c"]
    common = lambda d: d.filter(F.size("v") == dim)
    router, parts, probes = fit(common(rows), count, recall, k)
    # any other length is a part of its own
    others = lambda d: d.filter(F.size("v") != dim).withColumn("own", -F.size("v"))
    placed = _routed(common(rows), router, 1).select("vec_id", "v", F.col("parts")[0].alias("part"))
    indexed = settle(placed.unionByName(others(rows).withColumnRenamed("own", "part")))
    routed = _routed(common(asked), router, probes).select("vec_id", "v", "parts")
    found = settle(_search(routed.unionByName(others(asked).select("vec_id", "v", F.array("own").alias("parts"))), indexed, k))
    if probes < parts:
        got = found.groupBy("query_id").agg(F.count("*").alias("n"))
        asked = common(asked)
        short = asked.join(got, asked["vec_id"] == got["query_id"], "left").filter(F.coalesce("n", F.lit(0)) < min(k, count - 1)).select("vec_id", "v")
        if not short.isEmpty():
            full = _search(short.withColumn("parts", F.array(*(F.lit(p) for p in range(parts)))), indexed, k)
            found = found.join(short, found["query_id"] == short["vec_id"], "left_anti").unionByName(full)
    return found
