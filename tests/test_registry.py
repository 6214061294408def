"""Merging people with names, jobs that ended, and odd rows of the sources."""

from pyspark.sql import functions as F

from sifthouse.operators import registry as R


def test_people_are_merged_with_their_names(spark):
    faces = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, None, True), (4, "c", False)], "id long, person_id string, person_locked boolean")
    people = spark.createDataFrame([("a", "Ann"), ("b", ""), ("c", None)], "person_id string, name string")
    pairs = spark.createDataFrame([("a", "b"), ("c", "c"), ("c", "nobody")], "source string, target string")
    moved, left = R.merge(faces, people, pairs)
    assert {tuple(r) for r in moved.collect()} == {(1, "b", True), (2, "b", True), (3, None, True), (4, "c", False)}
    assert {tuple(r) for r in left.collect()} == {("b", "Ann"), ("c", None)}


def test_jobs_that_are_there_are_shared(spark):
    jobs = spark.createDataFrame([("j1", "k", "u", "done", False, 1), ("j2", "k", "u", "running", False, 2), ("j3", "x", "u", "error", False, 1), ("j4", "y", "u", "done", True, 1), ("j5", "z", "u", "done", False, 1)],
                                 "job string, key string, user string, status string, cancelled boolean, at long")
    asked = spark.createDataFrame([(1, "k", "u", 9, False), (2, "k", "u", 9, True), (3, "k", "v", 9, False), (4, "x", "u", 9, False), (5, "y", "u", 9, False), (6, "z", "u", 9, True), (7, "z", "u", 10, True)],
                                  "request long, key string, user string, at long, force boolean")
    got = {r["request"]: (r["job"], r["created"]) for r in R.shared_jobs(jobs, asked).collect()}
    assert got == {1: ("j1", False), 2: ("j2", False), 3: ("job-3", True), 4: ("job-4", True), 5: ("job-5", True), 6: ("job-6", True), 7: ("job-6", False)}


def test_excluded_and_repeated_files(spark):
    held = spark.createDataFrame([("a.txt", "a.txt", "txt", "document", None, None, "indexed", 3, 2, "f")], "rel_path string, name string, ext string, kind string, size long, mtime double, status string, priority int, attempts int, fingerprint string")
    found = spark.createDataFrame([("a.txt", 1, 1.0, 1, None), ("b.txt", 1, 1.0, 0, "x"), ("b.txt", 2, 2.0, 0, "y"), ("no/c.txt", 1, 1.0, 0, None), (None, 1, 1.0, 0, None)], "rel_path string, size long, mtime double, priority int, fingerprint string")
    got = {r["rel_path"]: (r["kind"], r["size"], r["status"], r["priority"], r["attempts"], r["fingerprint"]) for r in R.register(held, found, F.col("rel_path").startswith("no/")).collect()}
    assert got == {"a.txt": ("document", 1, "queued", 3, 0, None), "b.txt": ("document", 2, "queued", 0, 0, "y")}


def test_a_sample_does_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    ids = lambda d: [r["k"] for r in R.sample(d, "k", 20, 3).collect()]
    assert ids(rows.repartition(7)) == ids(rows.coalesce(1)) and len(set(ids(rows))) == 20 and R.sample(rows.limit(5), "k", 20).count() == 5
