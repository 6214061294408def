"""Registering, listing, sampling, corrections of people, and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from ..session import table
from .registry import query


@query("""WITH s AS (SELECT 'd/' || o_orderkey || '.txt' AS p, o_custkey AS size, 100.0 AS mtime, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' ELSE 'indexed' END AS status, (o_orderkey % 4)::INT AS priority FROM orders WHERE o_orderstatus <> 'P'),
n AS (SELECT 'd/' || o_orderkey || CASE WHEN o_orderkey % 11 = 0 THEN '.exe' ELSE '.txt' END AS p, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS size, 100.0 + CASE WHEN o_orderkey % 5 = 0 THEN 2.0 ELSE 0.5 END AS mtime, 2 AS priority FROM orders WHERE o_orderkey % 13 <> 0),
m AS (SELECT * FROM n WHERE p NOT LIKE '%.exe'), j AS (SELECT coalesce(s.p, m.p) AS p, s.p IS NOT NULL AS held, m.p IS NOT NULL AS come, s.size = m.size AND abs(s.mtime - m.mtime) < 1 AND s.status <> 'missing' AS same, s.size AS ss, m.size AS ms, s.status AS st, s.priority AS sp, m.priority AS mp FROM s FULL JOIN m ON s.p = m.p)
SELECT p AS rel_path, CASE WHEN come AND NOT (held AND same) THEN ms ELSE ss END AS size, CASE WHEN come AND NOT (held AND same) THEN 'queued' ELSE st END AS status, CASE WHEN come AND NOT (held AND same) THEN greatest(coalesce(sp, mp), mp) ELSE sp END AS priority FROM j""")
def register_sources(spark, d):
    o = table(spark, d, "orders")
    path = lambda ext: F.concat(F.lit("d/"), F.col("o_orderkey").cast("string"), ext)
    k = F.col("o_orderkey")
    held = o.filter("o_orderstatus <> 'P'").select(
        path(F.lit(".txt")).alias("rel_path"), path(F.lit(".txt")).alias("name"), F.lit("txt").alias("ext"), F.lit("document").alias("kind"), F.col("o_custkey").alias("size"), F.lit(100.0).alias("mtime"),
        F.when(k % 7 == 0, "missing").otherwise("indexed").alias("status"), (k % 4).cast("int").alias("priority"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("fingerprint"))
    found = o.filter("o_orderkey % 13 <> 0").select(
        path(F.when(k % 11 == 0, ".exe").otherwise(".txt")).alias("rel_path"), (F.col("o_custkey") + F.when(k % 3 == 0, 1).otherwise(0)).alias("size"), (F.lit(100.0) + F.when(k % 5 == 0, 2.0).otherwise(0.5)).alias("mtime"),
        F.lit(2).alias("priority"), F.lit(None).cast("string").alias("fingerprint"))
    return R.register(held, found).select("rel_path", "size", "status", "priority")


@query("""WITH f AS (SELECT p_partkey, count(*) OVER () AS total FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND (contains(lower(p_name), 'ste') OR contains(lower(p_brand), 'ste')))
SELECT f.p_partkey, total FROM f JOIN part USING (p_partkey) ORDER BY p_size DESC, p_partkey LIMIT 15 OFFSET 5""")
def sources_page(spark, d):
    p = table(spark, d, "part")
    maker = p.agg(F.min("p_type")).first()[0] or ""
    page, total = R.listing(p, [F.desc("p_size"), F.col("p_partkey")], 5, 15, "STE", ("p_name", "p_brand"), p_type=maker)
    return page.select("p_partkey", F.lit(total).cast("long").alias("total"))


@query("SELECT vec_id FROM (SELECT vec_id FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 100)")
def training_sample(spark, d):
    return R.sample(table(spark, d, "embeddings").select("vec_id"), "vec_id", 100, seed=7)


_CUSTOMER_FACES = "f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS person_id, c_custkey % 11 = 0 AS locked FROM customer)"


def _faces(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("id"), F.when(c % 3 != 0, F.col("c_nationkey")).alias("person_id"), (c % 11 == 0).alias("person_locked"))


@query(f"""WITH {_CUSTOMER_FACES}, d AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 30 END AS p FROM orders WHERE o_orderstatus = 'P'),
k AS (SELECT * FROM d WHERE p IS NULL OR p IN (SELECT n_nationkey FROM nation)), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM k)
SELECT f.id, CASE WHEN l.id IS NOT NULL THEN l.p ELSE f.person_id END AS person_id, f.locked OR l.id IS NOT NULL AS person_locked FROM f LEFT JOIN l ON f.id = l.id AND l.rn = 1""")
def assigned_faces(spark, d):
    k = F.col("o_orderkey")
    decided = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.when(k % 4 != 0, k % 30).alias("person_id"), k.alias("at"))
    return R.assign(_faces(spark, d), decided, table(spark, d, "nation").select(F.col("n_nationkey").alias("person_id")))


@query(f"""WITH {_CUSTOMER_FACES}, m AS (SELECT n_nationkey AS s, n_regionkey AS t FROM nation WHERE n_nationkey > 4), e AS (SELECT s AS p, t FROM m UNION SELECT t, t FROM m)
SELECT f.id, coalesce(e.t, f.person_id) AS person_id, f.locked OR e.t IS NOT NULL AS person_locked FROM f LEFT JOIN e ON f.person_id = e.p""")
def merged_faces(spark, d):
    n = table(spark, d, "nation")
    people = n.select(F.col("n_nationkey").alias("person_id"), F.col("n_name").alias("name"))
    return R.merge(_faces(spark, d), people, n.filter("n_nationkey > 4").select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target")))[0]


@query("""WITH r AS (SELECT event_id AS request, 's' || (user_id % 50) || ':l/' || (event_id % 7) || ',l/x' AS key, event_type AS u FROM events), f AS (SELECT key, u, min(request) AS first FROM r GROUP BY 1, 2)
SELECT request, 'job-' || first AS job, request = first AS created FROM r JOIN f USING (key, u)""")
def shared_jobs(spark, d):
    e = table(spark, d, "events")
    file = lambda source: F.struct(F.lit("l").alias("library_id"), source.alias("source_id"))
    key = R.job_key(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")), F.array(file((F.col("event_id") % 7).cast("string")), file(F.lit("x"))))
    asked = e.select(F.col("event_id").alias("request"), key.alias("key"), F.col("event_type").alias("user"), F.col("event_id").alias("at"), F.lit(False).alias("force"))
    return R.shared_jobs(spark.createDataFrame([], "job string, key string, user string, status string, cancelled boolean, at long"), asked)
