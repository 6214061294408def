"""Search over quantised candidates beside the exact search, and pruning of its lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sifthouse.operators import quantised
from sifthouse.session import table

SF = "/root/testdata/sf0.01"


def _recall(x, ids, queries, got, k):
    hits = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({int(ids[i]) for i in np.argsort(-s)[:k]} & got.get(int(ids[q]), set()))
    return hits / (k * len(queries))


def _search(spark, vectors, queries, path, parts, k=20):
    vectors.cache()
    book = quantised.fit(vectors, vectors.count(), parts, k=k)
    quantised.build(vectors, path, book)
    found = quantised.search(queries, vectors, path, book, k)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    return book, got


def test_recall_on_the_tables(spark, tmp_path):
    rows = table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.filter("id % 100 = 0").toDF("query_id", "q")
    book, got = _search(spark, rows, asked, f"{tmp_path}/codes", 32)
    held = rows.orderBy("id").collect()
    x, ids = np.array([r["v"] for r in held], np.float64), [r["id"] for r in held]
    queries = [i for i, v in enumerate(ids) if v % 100 == 0]
    assert _recall(x, ids, queries, {q: {i for _, i, _ in v} for q, v in got.items()}, 20) >= 0.9
    for q, v in got.items():
        assert [r for r, _, _ in sorted(v)] == list(range(1, 21))
        for _, i, s in v:
            assert s == pytest.approx(float(x[ids.index(i)] @ x[ids.index(q)])) and i != q


def test_few_lists_are_looked_at_where_vectors_have_neighbourhoods(spark, tmp_path, monkeypatch):
    """Clustered vectors, a third of all the same: one list holds them, in blocks of bounded size, and a query reads a small share of the codes."""
    monkeypatch.setattr(quantised, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (40, 16))
    x = middles[rng.integers(0, 40, 3_000)] + rng.normal(0, 0.15, (3_000, 16))
    x[:1_000] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    queries = [i for i in range(1_000, 3_000, 50)]
    book, got = _search(spark, rows, rows.filter("id >= 1000 and id % 50 = 0").toDF("query_id", "q"), f"{tmp_path}/codes", 8, k=10)
    assert _recall(x, range(3_000), queries, {q: {i for _, i, _ in v} for q, v in got.items()}, 10) >= 0.9
    assert book.probes <= len(book.centroids) / 2
    assert quantised.bytes_read(spark, f"{tmp_path}/codes", book) < 3_000 * 16 * 8 / 4
    plan = spark.read.parquet(f"{tmp_path}/codes").filter("list in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(list, [1,2])" in plan
