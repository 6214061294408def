"""Vector search over quantised candidates: inverted lists of byte codes, distance tables by query, exact scores at the end.

Coarse centroids and the codebooks of the residuals' parts are fitted on a bounded sample. Every
vector stands in the list of its nearest centroid as one byte a part. A query looks at its most
likely lists, as many as held-out rows of the sample need for the recall asked, scores their codes
by a table of its products with all code words, and the best candidates are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scores import doubles
from ..session import settle

#: Rows that centroids and codebooks are fitted on, at most about.
SAMPLE = 16_384
#: Lists, at most: their centroids travel with every task.
MOST_LISTS = 1_024
#: Vectors of a block of a list, and queries that meet it together.
BLOCK_ROWS, QUERY_ROWS = 8_192, 1_024
#: Candidates for each row wanted.
OVER = 8


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 2) -> np.ndarray:
    """``k`` centroids of ``x``; one that nothing is near to goes to some other row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        count = np.bincount(own, minlength=k)
        summed = np.zeros_like(c)
        np.add.at(summed, own, x)
        c = np.where(count[:, None] > 0, summed / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


@dataclass
class Codebook:
    centroids: np.ndarray  # (lists, dim)
    words: np.ndarray  # (parts, 256, dim / parts)
    probes: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and codes of each row."""
        own = _nearest(x, self.centroids)
        rest = (x - self.centroids[own]).reshape(len(x), len(self.words), -1)
        return own, np.stack([_nearest(rest[:, j], w) for j, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def lists(self, q: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The lists whose centroids have the greatest products with each query."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : probes or self.probes]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Each query's products with all code words: (queries, parts, 256)."""
        return np.einsum("qjd,jwd->qjw", q.reshape(len(q), len(self.words), -1), self.words)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(vectors: DataFrame, count: int, parts: int = 32, recall: float = 0.95, k: int = 20) -> Codebook:
    """Centroids, codebooks and the number of lists to look at, from a sample of ``vectors(id, v)`` chosen by a hash of the ids.

    Every fourth row of the sample is kept from the centroids and asks for its ``k`` nearest of
    the others: the lists that hold a share ``recall`` of them are what a query looks at.
    """
    place = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1_000_000))
    got = vectors.filter(place < int(SAMPLE * 1_000_000 / max(count, 1)) + 1).orderBy("id").limit(2 * SAMPLE).select("v").toArrow()
    x = _matrix(got.column("v").combine_chunks())
    kept = np.arange(len(x)) % 4 == 0
    fitted = x[~kept] if (~kept).any() else x
    lists = int(min(MOST_LISTS, max(1, min(4 * np.sqrt(count), len(fitted) / 16))))
    centroids = _means(fitted, lists)
    rest = (fitted - centroids[_nearest(fitted, centroids)]).reshape(len(fitted), parts, -1)
    words = np.stack([_means(np.ascontiguousarray(rest[:, j]), 256, rounds=6) for j in range(parts)])
    book = Codebook(centroids, words, lists)
    asked = x[kept][:1_024]
    if len(asked) and len(fitted) > k:
        near = np.argpartition(-(asked @ fitted.T), k, axis=1)[:, :k]
        ranked = book.lists(asked, lists)
        rank = np.empty_like(ranked)
        np.put_along_axis(rank, ranked, np.arange(lists)[None, :], axis=1)
        needed = np.sort(np.take_along_axis(rank, _nearest(fitted, centroids)[near], axis=1).ravel())
        book.probes = int(min(lists, needed[int(np.ceil(recall * len(needed))) - 1] + 1))
    return book


def build(vectors: DataFrame, path: str, book: Codebook) -> None:
    """Write the lists of all ``vectors(id, v)`` to ``path``: a row a vector, ``list``, ``id`` and ``codes``, in order of the list, so that a filter on lists leaves their row groups."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes = shared.value.encode(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "list", "codes"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), doubles(F.col("v")).alias("v")).mapInArrow(run, "id long, list int, codes binary")
    # ranges of list and id, so that a list of very many vectors is split too
    rows.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(path)


def candidates(queries: DataFrame, path: str, book: Codebook, most: int) -> DataFrame:
    """``query_id, id, guess``: the ``most`` best of each of ``queries(query_id, q)`` by their codes, without its own id."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(book)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                top = shared.value.lists(_matrix(batch.column("q")))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1]), pa.int32()), pa.array(top.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), listed], ["query_id", "q", "lists"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), doubles(F.col("q")).alias("q")).mapInArrow(route, "query_id long, q array<double>, lists array<int>")
    asked = asked.select("query_id", "q", F.explode("lists").alias("list"))
    held = spark.read.schema("id long, list int, codes binary").parquet(path)
    blocks = lambda rows, size, name: rows.groupBy("list").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))
    # at most MOST_LISTS rows
    sizes = F.broadcast(blocks(held, BLOCK_ROWS, "blocks").join(blocks(asked, QUERY_ROWS, "turns"), "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(n)).cast("int")
    by = ["list", "block", "turn"]
    left = asked.join(sizes, "list").select("list", every("blocks").alias("block"), own("query_id", "turns", 1).alias("turn"), "query_id", "q")
    right = held.join(sizes, "list").select("list", own("id", "blocks", 2).alias("block"), every("turns").alias("turn"), "id", "codes")

    def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "guess": []}
        if a.num_rows and b.num_rows:
            model = shared.value
            q, q_ids, ids = _matrix(a.column("q").combine_chunks()), a.column("query_id").to_numpy(), b.column("id").to_numpy()
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            base = q @ model.centroids[key[0].as_py()]
            tables = model.tables(q)
            for i, q_id in enumerate(q_ids.tolist()):
                guess = tables[i][np.arange(codes.shape[1])[None, :], codes].sum(axis=1) + base[i]
                guess[ids == q_id] = -np.inf
                some = np.argpartition(-guess, most - 1)[:most] if len(ids) > most else np.arange(len(ids))
                some = some[guess[some] > -np.inf]
                out["query_id"].append(np.full(len(some), q_id))
                out["id"].append(ids[some])
                out["guess"].append(guess[some])
        kinds = {"query_id": pa.int64(), "id": pa.int64(), "guess": pa.float64()}
        return pa.table({n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in out.items()})

    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id long, id long, guess double")
    order = Window.partitionBy("query_id").orderBy(F.desc("guess"), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("rank")


def search(queries: DataFrame, vectors: DataFrame, path: str, book: Codebook, k: int = 20) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best candidates of each of ``queries(query_id, q)`` by the exact inner product with ``vectors(id, v)``, ties to the smaller id.

    Ids and query ids are unique, vectors of one length that the codebook's parts divide.
    """
    found = settle(candidates(queries, path, book, OVER * k))
    pairs = found.join(queries.select("query_id", doubles(F.col("q")).alias("q")), "query_id").join(vectors.select("id", doubles(F.col("v")).alias("v")), "id")
    exact = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.select("query_id", "id", exact.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bytes_read(spark: SparkSession, path: str, book: Codebook) -> float:
    """Bytes of codes and ids that a query looks at, as a share of its probes of the lists."""
    n = spark.read.parquet(path).count()
    return n * (len(book.words) + 8) * book.probes / len(book.centroids)
