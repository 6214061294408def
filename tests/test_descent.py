"""Neighbours by descent beside the exact ones."""

import numpy as np
import pytest

from sifthouse.operators import descent, people


def _exact(x, k, floor=None):
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    near = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(i, int(j)) for i in range(len(x)) for j in near[i] if floor is None or s[i, j] >= floor}


@pytest.mark.parametrize("n, dim, groups", [(800, 8, 30), (600, 24, 0)])
def test_most_neighbours_are_found(spark, n, dim, groups):
    """Vectors in clusters, with some repeated, and vectors anywhere: at least 0.95 of the mutual pairs."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim)) if not groups else rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + rng.normal(0, 0.3, (n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    got = {(r["src"], r["dst"]) for r in descent.nearest(vectors, 12).collect()}
    want = _exact(x, 12)
    mutual = lambda pairs: {(a, b) for a, b in pairs if a < b and (b, a) in pairs}
    assert len(got) == 12 * n and len(got & want) / len(want) >= 0.95
    assert len(mutual(got) & mutual(want)) / len(mutual(want)) >= 0.95


def test_one_vector_near_to_all(spark):
    """A third of the vectors are one and the same: no task holds all that are near to it, and every vector has its neighbours."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x[:100] = x[0]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 6), (999, None)], "id long, v array<double>")
    rows = descent.nearest(vectors, 5).collect()
    assert len(rows) == 1_500 and all(r["src"] != r["dst"] for r in rows)
    assert all(r["score"] == pytest.approx(float(x[r["src"]] @ x[r["dst"]])) for r in rows)
    assert descent.nearest(vectors.limit(0)).count() == 0


def test_people_are_grouped_by_descent_too(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 16))
    x = middles[np.arange(240) % 12] + rng.normal(0, 0.1, (240, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    exact = {(r["id"], r["person"]) for r in people.cluster(vectors, k=6, floor=0.6).collect()}
    assert {(r["id"], r["person"]) for r in people.cluster(vectors, k=6, floor=0.6, approximate=True).collect()} == exact


def test_pairs_are_not_shuffled_before_they_are_better(spark):
    """Two thousand vectors anywhere, who meet some millions of times: what is shuffled stays under 40 MB."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2_000, 64))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "id long, v array<double>").repartition(4)
    written = lambda: sum(e.totalShuffleWrite() for e in [spark._jsc.sc().statusStore().executorList(True).apply(0)])
    vectors.count()
    before = written()
    assert descent.nearest(vectors, 12).count() == 24_000
    assert (written() - before) / 1e6 < 40
