"""Periodic runs, the quality classifier and centroid clustering beside plain versions, on the tables and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sifthouse.llm import centroids, periods, quality, queries

from . import brute
from .conftest import ODD, SF


def _numbers(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return np.concatenate([np.asarray(t, np.int64) for t in texts] + [np.zeros(0, np.int64)]), first


def test_runs_of_random_sequences():
    rng = np.random.default_rng(4)
    for _ in range(400):
        texts = []
        for _ in range(5):
            n = int(rng.integers(0, 90))
            w = rng.integers(0, int(rng.integers(1, 5)), n)
            if n > 10 and rng.random() < 0.6:
                a = int(rng.integers(0, n))
                place = np.arange(n)
                place[a:] = a + np.arange(n - a) % (1 + (n - a) // int(rng.integers(2, 9)))
                w = w[place]
            texts.append(w.tolist())
        assert periods.runs_of(*_numbers(texts)) == [[(s, m, p) for s, m, p in brute.periodic_runs(t)] for t in texts]


def test_frequent_and_rare_words_give_the_same_counts():
    """Autocorrelation and pair differences both count every match of every lag."""
    rng = np.random.default_rng(5)
    words = np.concatenate([rng.integers(0, 2, 1500), rng.integers(0, 900, 1500)])
    rng.shuffle(words)
    counts, _ = periods.lag_counts(words, np.array([0, len(words)]))
    assert counts[1:].tolist() == [int((words[q:] == words[:-q]).sum()) for q in range(1, len(words) // 4 + 1)]


def test_long_sequences_end():
    """One word throughout, two words at random, and a long period: none takes the square of the length."""
    n = 300_000
    assert periods.runs_of(*_numbers([np.zeros(n, np.int64)])) == [[(0, n, 1)]]
    assert periods.runs_of(*_numbers([np.arange(n) % 1_000])) == [[(0, n, 1_000)]]
    assert all(m >= max(6, 4 * p) for _, m, p in periods.runs_of(*_numbers([np.random.default_rng(0).integers(0, 2, n)]))[0])


def test_digests_beside_brute_force(spark, rows):
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert got == brute.run_digests(rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_rows(spark, odd):
    """A row for every row, other columns kept but those replaced, null and empty texts without runs."""
    got = periods.find_runs(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        words = [w.decode() for w in brute.blank_words(dict((d, t) for d, t, _ in ODD)[r["doc_id"]])]
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == brute.periodic_runs(words)
        assert r["kept_words"] == len(r["collapsed"].split(" ")) - (r["collapsed"] == "")
        assert r["score"] is None and r["spans"] is None
    assert {r["doc_id"]: r["collapsed"] for r in got}[11] == "same"
    assert periods.find_runs(odd.limit(0)).count() == 0


def _texts(n):
    rng = np.random.default_rng(1)
    good = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(40))
    bad = {0: lambda t: t.upper(), 1: lambda t: " ".join(w + "$$$" for w in t.split()), 2: lambda t: " ".join([t.split()[0]] * 40)}
    return [(i, bad[i % 3](good()) if i % 2 else good(), 1 - i % 2) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = _texts(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return quality.train(docs, spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int"))


def test_quality_of_texts_not_seen(spark, model):
    """Case, marks and words that follow themselves are told from unseen words."""
    rows = [(i + 10_000, t, q) for i, t, q in _texts(1500)[900:]]
    got = {r["doc_id"]: r["predicted"] for r in quality.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    assert sum(got[i] == q for i, _, q in rows) / len(rows) > 0.97


def test_quality_on_held_out_rows(spark):
    scored = queries.op11_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rates = {(r["held_out"], r["quality"]): r["p"] for r in scored.join(labels, "doc_id").groupBy("held_out", "quality").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[True, 1] > 0.9 and rates[True, 0] < 0.2
    assert scored.filter("score < 0 or score > 1 or score is null or (score >= 0.7) <> (predicted = 1)").count() == 0


def test_long_texts_are_scored_whole(model):
    """A text in several pieces has the features of one looked at together, and of a word longer than a piece."""
    text = " ".join(f"w{i % 977}é" for i in range(60_000)) + " " + "x" * 300_000 + "\n" + "tail " * 10
    counts = dict(zip(*(v.tolist() for v in quality.feature_counts(text.encode())), strict=True))
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    whole = np.concatenate(quality._features(code, None)[0]) >> np.uint64(64 - quality.BITS)
    assert counts == dict(zip(*(v.tolist() for v in np.unique(whole.astype(np.int32), return_counts=True)), strict=True))
    buckets, count = quality.feature_counts(text.encode())
    z = model.logit(buckets, (count / count.sum()).astype(np.float32))
    s = model.scorer().score(text.encode())
    assert math.isclose(math.log(s / (1 - s)), model.slope * (z - model.threshold) + math.log(0.7 / 0.3), rel_tol=1e-3, abs_tol=1e-3)


def test_quality_of_odd_rows(spark, odd, empty, model):
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[2] == by_id[3] == by_id[4]  # null, empty and blank texts alike
    assert set(quality.keep_good(odd, model).columns) == set(odd.columns)
    assert quality.score(empty, model).count() == 0
    none = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["predicted"] for r in quality.score(odd, none).collect()} == {1}
    some = spark.createDataFrame([(1, 0), (8, 0)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.score(odd, quality.train(odd, some)).collect()} == {0}


def test_the_budget_of_entries_bounds_the_fitting(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(rows) or None)
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(50)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    quality.train(docs, labels, max_train=20)
    quality.train(docs, labels, max_train=20, max_entries=400)
    assert len(seen[0]) == 20 and 0 < len(seen[1]) < 20 and sum(len(b) for b, _, _ in seen[1]) <= 400


def test_trees_give_exact_neighbours():
    rng = np.random.default_rng(2)
    for trial in range(60):
        n, dim, span = int(rng.integers(1, 400)), int(rng.choice([2, 64])), int(rng.choice([2, 1000, 2**26]))
        x = rng.integers(-span, span, (n, dim))
        if trial % 3 == 0:
            x = rng.integers(-span, span, (6, dim))[rng.integers(0, 6, n)] + rng.integers(-1, 2, (n, dim)) * (span // 500)
        tree, order = centroids.cover_tree(x)
        y, c = x[order], x[rng.integers(0, n, 8)] if trial % 2 else rng.integers(-span, span, (8, dim))
        apart = ((y[:, None] - c[None]) ** 2).sum(axis=2)
        cluster, distance = centroids.nearest(tree, y, c)
        assert (cluster == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
        count, summed = centroids.totals(tree, y, c)
        assert (count == np.bincount(cluster, minlength=8)).all() and all((summed[j] == y[cluster == j].sum(axis=0)).all() for j in range(8))


def test_bounds_prune_where_vectors_lie_together():
    """On clustered vectors most rows go to a centroid with their node, without a distance of their own."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-50_000, 50_000, (8, 64))
    x = middles[rng.integers(0, 8, 4_000)] + rng.integers(-50, 50, (4_000, 64))
    tree, order = centroids.cover_tree(x)
    whole = sum(int((tree.last - tree.first)[v].sum()) for v, _, w in centroids._meet(tree, centroids.centroid_tree(middles)) if w)
    assert whole == 4_000


def test_clusters_beside_plain_lloyd(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_centroid_clustering(spark, SF).collect())
    assert got == brute.lloyd(rows)


def test_clusters_of_odd_vectors(spark, monkeypatch):
    """Repeated ids and vectors, other lengths, nulls and non-finite components, several small blocks."""
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(0, 1 + i % 3, 4).tolist()) for i in range(60)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 3 + [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    odd = [(200, None), (201, [1.0]), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [])]
    table = spark.createDataFrame([(*r, "own") for r in rows + odd], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = sorted(tuple(r) for r in centroids.cluster_vectors(table, k=5, rounds=10, dim=4, scale=64).collect())
    assert got == brute.lloyd(rows + odd, k=5, dim=4, scale=64)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in centroids.cluster_vectors(few, dim=4, scale=64).collect()) == brute.lloyd(rows[:3], dim=4, scale=64)
    assert centroids.cluster_vectors(table.limit(0), dim=4).count() == 0
    null = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.5]), (1, [9.0, 9.0])], "vec_id long, embedding array<double>")
    assert sorted((str(r["vec_id"]), r["cluster"]) for r in centroids.cluster_vectors(null, dim=2).collect()) == [("1", 0), ("1", 1), ("None", 0)]
