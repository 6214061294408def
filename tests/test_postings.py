"""The keyword index beside the scanning search, its appends, and what a search reads of it."""

import random

import pytest
from pyspark.sql import functions as F

from sifthouse.operators import postings, retrieval

COLUMNS = {"text": 1.0, "heading": 0.4}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    often = ["the", "of", "rare"]
    rows = []
    for i in range(3_000):
        text = rng.choices(words, k=rng.randint(0, 60)) + rng.choices(often[:2], k=rng.randint(0, 30))
        rng.shuffle(text)
        if i % 500 == 7:
            text.append("rare")
        rows.append((i, " ".join(text) if i % 97 else None, " ".join(rng.choices(words + ["the"], k=3))))
    return spark.createDataFrame(rows + [(None, "the the", "of")], "id long, text string, heading string").repartition(5)


@pytest.fixture(scope="module")
def path(spark, docs, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('index')}/words"
    known = docs.filter("id is not null")
    postings.append(known.filter("id < 2000"), where, "id", COLUMNS, slice_rows=64)
    postings.append(docs.filter("id >= 2000 or id is null"), where, "id", COLUMNS, slice_rows=64)
    return where


@pytest.mark.parametrize("terms, limit", [(["the", "of"], 10), (["W1", "w1"], 200), (["rare", "the"], 200), (["w1", "w2", "w3"], 10), (["of the", "w5", "the"], 200), (["the the the", "rare", "nowhere"], 200)])
def test_search_equals_the_scan(spark, docs, path, terms, limit):
    want = retrieval.bm25(docs.filter("id is not null"), terms, "id", COLUMNS, limit).select("id", "score").collect()
    got = postings.bm25(postings.Index(spark, path, COLUMNS), terms, "id", limit).collect()
    assert sorted(got, key=lambda r: (-r[1], r[0])) == want


def test_a_build_that_fails_is_not_read(spark, docs, path, tmp_path):
    where = f"file://{tmp_path}/words"
    postings.append(docs.filter("id < 100"), where, "id", COLUMNS)
    broken = docs.filter("id < 50").withColumn("heading", F.when(F.col("id") == 20, F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("heading")))
    with pytest.raises(Exception):
        postings.append(broken, where, "id", COLUMNS)
    index = postings.Index(spark, where, COLUMNS)
    assert (len(index.segments), index.documents) == (1, 100)


def test_no_documents(spark, docs, tmp_path):
    where = f"file://{tmp_path}/words"
    postings.append(docs.limit(0), where, "id", COLUMNS)
    assert postings.bm25(postings.Index(spark, where, COLUMNS), ["the"], "id").count() == 0


def _read(df):
    """Rows that the scans of a collected plan gave out."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().apply("numOutputRows").value()
    return total


def test_only_the_row_groups_of_the_terms_are_read(spark, docs, tmp_path):
    """Of an index in small row groups a search for one word reads a small share, in one folder of its hash; the filter reaches the scan."""
    where = f"file://{tmp_path}/words"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "4096")
    conf.set("parquet.block.size.row.check.min", "10")
    try:
        postings.append(docs, where, "id", COLUMNS, slice_rows=64)
    finally:
        conf.unset("parquet.block.size")
        conf.unset("parquet.block.size.row.check.min")
    index = postings.Index(spark, where, COLUMNS)
    whole = spark.read.parquet(f"{where}/segments/{index.segments[0]}/blocks")
    one = index.blocks(["w42"]).select("slice", "docs")
    folder = whole.filter(F.col("bucket") == postings._bucket(F.lit("w42"))).count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan or "EqualTo(term,w42)" in plan
    assert one.count() <= _read(one) <= folder < whole.count() / 10


def test_slices_below_the_last_place_are_not_scored(spark, docs, path, monkeypatch):
    """Once the first slices fill the list, slices that can't reach its last place stay unread."""
    monkeypatch.setattr(postings, "SEEDS", 4)
    index = postings.Index(spark, path, COLUMNS)
    want = [r["id"] for r in retrieval.bm25(docs.filter("id is not null"), ["rare"], "id", COLUMNS, 2).collect()]
    assert {r["id"] for r in postings.bm25(index, ["rare"], "id", 2).collect()} == set(want)


def test_words_are_not_shuffled_one_by_one(spark, tmp_path, monkeypatch):
    """Texts are dealt by slice and inverted there: no row for each word is made or shuffled."""
    made, explode = [], F.explode
    monkeypatch.setattr(F, "explode", lambda c: made.append(c) or explode(c))
    docs = spark.createDataFrame([(i, f"a{i % 5} b{i % 3} a{i % 5} " * (i % 4), "b1 head") for i in range(60)] + [(None, "a1", None), (99, None, None)], "id long, text string, title string")
    postings.append(docs, f"{tmp_path}/i", "id", {"text": 1.0, "title": 0.4}, 16)
    assert not made
    monkeypatch.undo()
    index = postings.Index(spark, f"{tmp_path}/i", {"text": 1.0, "title": 0.4})
    assert index.documents == 61
    got = {r["key"]: (r["len"], r["tf"], r["places"]) for r in index.blocks(["b1"]).select(F.explode("docs").alias("d")).select("d.*").collect()}
    for i in range(60):
        words = f"a{i % 5} b{i % 3} a{i % 5} ".split() * (i % 4)
        at = [p for p, w in enumerate(words) if w == "b1"]
        assert got[i] == (len(words) + 2, len(at) * 1.0 + 0.4, [*at, postings.COLUMN])
    assert 99 not in got
