"""Aggregates, joins, upkeep, text and streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import chunking, facets, folding, people, ranks, relations, selection
from ..sources import readers
from ..streaming import events as S
from ..session import table
from .registry import TOKENS, query


@query("SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return facets.tally(table(spark, d, "orders"), F.col("o_orderstatus"))


@query("SELECT p_type AS label, count(*) AS n FROM part GROUP BY 1")
def facet_category(spark, d):
    return facets.tally(table(spark, d, "part"), F.col("p_type"))


@query(f"SELECT w AS label, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct({TOKENS.format('p_name')})) AS w FROM part) GROUP BY 1")
def facet_multi(spark, d):
    return facets.tally_values(table(spark, d, "part"), T.tokens(F.col("p_name")))


@query("""WITH r AS (SELECT o_orderstatus AS s, o_orderpriority AS p, year(o_orderdate)::VARCHAR AS y, o_orderstatus = 'O' AS cs, o_orderpriority IN ('1-URGENT', '2-HIGH') AS cp, year(o_orderdate) >= 1995 AS cy FROM orders)
SELECT 'status' AS facet, s AS label, count(*) AS n FROM r WHERE cp AND cy GROUP BY 2 UNION ALL SELECT 'priority', p, count(*) FROM r WHERE cs AND cy GROUP BY 2 UNION ALL SELECT 'year', y, count(*) FROM r WHERE cs AND cp GROUP BY 2""")
def crossfilter(spark, d):
    o = table(spark, d, "orders")
    year = F.year("o_orderdate")
    return facets.cross_filter(o, {"status": (F.col("o_orderstatus"), F.col("o_orderstatus") == "O"), "priority": (F.col("o_orderpriority"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), "year": (year, year >= 1995)})


@query("""WITH c AS (SELECT floor(least(greatest(l_discount * 9, 0), 0.9999) * 20)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1)
SELECT b.bin::INT AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(bin) FROM c), (SELECT max(bin) + 1 FROM c))) AS bin) b LEFT JOIN c ON b.bin = c.bin""")
def hist_score(spark, d):
    return facets.filled_bins(table(spark, d, "lineitem"), F.floor(F.least(F.greatest(F.col("l_discount") * 9, F.lit(0.0)), F.lit(0.9999)) * 20))


@query("""WITH c AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT m.month, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(month) FROM c)::TIMESTAMP, (SELECT max(month) FROM c)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month) m LEFT JOIN c ON m.month = c.month""")
def hist_date_gapfill(spark, d):
    return facets.filled_months(table(spark, d, "orders"), F.col("o_orderdate"))


@query("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 25 THEN 'medium' WHEN p_size < 40 THEN 'large' ELSE 'huge' END AS label, count(*) AS n FROM part GROUP BY 1")
def range_bins(spark, d):
    return facets.tally(table(spark, d, "part"), facets.ladder(F.col("p_size"), [(10, "small"), (25, "medium"), (40, "large")], "huge"))


@query("SELECT count(*) AS files, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS folders, count(DISTINCT lang) AS kinds, count(*) FILTER (n_chars > 5000) AS long_files FROM documents")
def attribute_totals(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.countDistinct("source").alias("folders"), F.countDistinct("lang").alias("kinds"), F.count_if(F.col("n_chars") > 5000).alias("long_files"))


@query("SELECT c_nationkey AS person, count(*) AS n, max(c_acctbal) AS quality, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS cover FROM customer GROUP BY 1")
def cover_face(spark, d):
    c = table(spark, d, "customer")
    best = people.cover(c, "c_nationkey", "c_custkey", F.col("c_acctbal"), F.lit(True))
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("quality")).join(best, "c_nationkey").select(F.col("c_nationkey").alias("person"), "n", "quality", "cover")


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT m.label, (m.i - 1)::INT AS i, round(m.m / n.n, 6) AS x FROM m JOIN n USING (label)""")
def person_centroid(spark, d):
    return people.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""WITH s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_DOT} AS x FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY x DESC, dst) AS rank FROM s WHERE x >= 0.2), n AS (SELECT * FROM r WHERE rank <= 12)
SELECT p.src, p.dst, round(p.x, 6) AS score FROM n p JOIN n q ON p.src = q.dst AND p.dst = q.src WHERE p.src < p.dst""")
def mutual_knn(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return people.mutual_neighbours(e, 12, 0.2).select("src", "dst", F.round("score", 6).alias("score"))


@query()
def mutual_descent(spark, d):
    return people.mutual_neighbours(table(spark, d, "embeddings").select("vec_id", "embedding"), 12, 0.2, approximate=True)


@query()
def people_cluster(spark, d):
    return people.cluster(table(spark, d, "embeddings").select("vec_id", "embedding"), floor=0.3)


def locks(spark, d):
    """Hand-made decisions about some vectors: every tenth belongs to the person of its label, of the others every seventeenth to nobody."""
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    return e.filter((i % 10 == 0) | (i % 17 == 0)).select(i.alias("id"), F.when(i % 10 == 0, F.concat(F.lit("p"), F.col("label").cast("string"))).alias("person_id"))


@query()
def people_cluster_locked(spark, d):
    return people.cluster(table(spark, d, "embeddings").select("vec_id", "embedding"), locks(spark, d), floor=0.3)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_orphans(spark, d):
    held = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(held, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 2)")
def semi_grants(spark, d):
    granted = table(spark, d, "nation").filter(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(granted, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def exists_pictures(spark, d):
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(r, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT l_orderkey, arg_max(l_partkey, (l_quantity, -l_linenumber, l_partkey)) AS best FROM lineitem GROUP BY 1")
def scalar_best_track(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_quantity", (-F.col("l_linenumber")).alias("n"), "l_partkey")).alias("best"))


_INTERVALS = """a AS (SELECT user_id % 20 AS k, event_id AS a, epoch(ts) AS ls, epoch(ts) + value AS le FROM events WHERE event_type = 'view'), b AS (SELECT user_id % 20 AS k, event_id AS b, epoch(ts) - 2 AS rs, epoch(ts) + 4 AS re FROM events WHERE event_type = 'click')"""


@query(f"WITH {_INTERVALS} SELECT a, b FROM a JOIN b ON a.k = b.k AND le >= rs AND ls <= re")
def interval_overlap_join(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("k", F.col("user_id") % 20)
    a = e.filter("event_type = 'view'").select("k", F.col("event_id").alias("a"), F.col("t").alias("ls"), (F.col("t") + F.col("value")).alias("le"))
    b = e.filter("event_type = 'click'").select("k", F.col("event_id").alias("b"), (F.col("t") - 2).alias("rs"), (F.col("t") + 4).alias("re"))
    return relations.interval_overlap(a, b, "k").select("a", "b")


@query("SELECT a.conv_id, a.turn AS at, arg_max(b.turn, (length(b.text), -b.turn)) AS best FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 1 WHERE a.role = 'user' GROUP BY 1, 2")
def spoken_at(spark, d):
    c = table(spark, d, "conversations")
    a = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("at"), (F.col("turn") - 2).cast("double").alias("ls"), (F.col("turn") + 1).cast("double").alias("le"))
    b = c.select("conv_id", "turn", F.length("text").alias("len"), F.col("turn").cast("double").alias("rs"), F.col("turn").cast("double").alias("re"))
    return relations.interval_overlap(a, b, "conv_id").groupBy("conv_id", "at").agg(F.max_by("turn", F.struct("len", (-F.col("turn")).alias("n"))).alias("best"))


def _snapshots(spark, d):
    o = table(spark, d, "orders")
    fields = lambda key, size: (key.alias("path"), size.alias("size"), F.col("o_custkey").cast("double").alias("mtime"), F.concat_ws("-", "o_orderkey", "o_custkey").alias("fingerprint"))
    old = o.filter("o_orderkey % 10 <> 0").select(*fields(F.col("o_orderkey"), F.col("o_custkey")))
    new = o.filter("o_orderkey % 10 <> 1").select(*fields(F.when(F.col("o_orderkey") % 10 == 2, F.col("o_orderkey") + 10_000_000).otherwise(F.col("o_orderkey")), F.when(F.col("o_orderkey") % 10 == 3, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))))
    return old, new


@query("""SELECT CASE WHEN o_orderkey % 10 = 2 THEN o_orderkey + 10000000 ELSE o_orderkey END AS path, CASE o_orderkey % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'removed' WHEN 2 THEN 'renamed' WHEN 3 THEN 'changed' ELSE 'unchanged' END AS change FROM orders""")
def snapshot_diff(spark, d):
    return relations.snapshot_diff(*_snapshots(spark, d), "path").select("path", "change")


@query("SELECT o_orderkey + 10000000 AS path, o_orderkey AS renamed_from FROM orders WHERE o_orderkey % 10 = 2")
def rename_detect(spark, d):
    return relations.snapshot_diff(*_snapshots(spark, d), "path").filter("change = 'renamed'").select("path", "renamed_from")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 7 <> 0 THEN 2.0 END WHEN c_custkey % 5 <> 0 THEN 1.0 END::DOUBLE AS v,
CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'inserted' WHEN c_custkey % 4 = 0 AND c_custkey % 35 <> 0 THEN 'updated' ELSE 'kept' END AS action FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 = 0""")
def upsert_register(spark, d):
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, 1.0).alias("v"))
    new = c.filter("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, 2.0).alias("v"))
    return relations.upsert(old, new, "c_custkey", ~F.col("e.v").eqNullSafe(F.col("i.v")))


@query("SELECT doc_id, canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents) WHERE doc_id <> canonical")
def exact_dup_alias(spark, d):
    return relations.exact_aliases(table(spark, d, "documents"), "doc_id", F.sha2("text", 256))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice, o_orderkey LIMIT 25")
def queue_pick(spark, d):
    return table(spark, d, "orders").orderBy("o_orderpriority", "o_totalprice", "o_orderkey").limit(25).select("o_orderkey")


@query("SELECT user_id, event_type, max(ts)::TIMESTAMP AS last, count(*) AS times FROM events GROUP BY 1, 2")
def history_upsert(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"), F.count("*").alias("times"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 10")
def keep_latest_n(spark, d):
    return relations.keep_latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 10).select("user_id", "event_id")


@query("SELECT c_custkey FROM customer ORDER BY CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey LIMIT 30")
def named_first_sort(spark, d):
    named = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment"))
    return table(spark, d, "customer").orderBy(named.isNull(), F.desc("c_acctbal"), "c_custkey").limit(30).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_listing(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_meta(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS v FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_last_object(spark, d):
    wrapped = F.concat(F.lit("said: {\"a\": 1} then "), F.col("props"))
    last = F.element_at(F.regexp_extract_all(wrapped, F.lit(r"(\{[^{}]*\})"), F.lit(1)), -1)
    return table(spark, d, "events").select("event_id", F.get_json_object(last, "$.k").alias("v")).filter("v is not null")


@query("SELECT doc_id, source, total FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM documents) WHERE total <= 20000")
def budget_window(spark, d):
    return ranks.running_sum(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.col("doc_id")], "n_chars").filter("total <= 20000").select("doc_id", "source", "total")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), k AS (SELECT unnest(range(5)) AS j)
SELECT DISTINCT r.doc_id, r.source FROM r, k WHERE n <= 5 OR r.i = floor(k.j * r.n / 5.0)""")
def even_sample(spark, d):
    return relations.even_sample(table(spark, d, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 5)


@query("SELECT doc_id, round(1 - (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) / count(*) OVER (PARTITION BY source)::DOUBLE, 6) AS score FROM documents")
def native_rank(spark, d):
    held = ranks.numbered(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")])
    return held.select("doc_id", F.round(1 - (F.col("rn") - 1) / F.col("n"), 6).alias("score"))


@query(f"SELECT w AS label, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS w FROM documents) WHERE length(w) >= 4 GROUP BY 1 HAVING count(*) >= 2")
def topics_frequency(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"), 4)).alias("label"))
    return words.groupBy("label").agg(F.count("*").alias("n")).filter("n >= 2")


@query(f"SELECT doc_id, len({TOKENS.format('text')})::INT AS n_tokens, greatest(ceil(length(text) / 3.8), ceil(len({TOKENS.format('text')}) * 1.3))::BIGINT AS estimate, greatest(1, length(text) // 4)::BIGINT AS short_estimate FROM documents")
def token_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(t)).alias("n_tokens"), T.estimate_tokens(t).alias("estimate"), T.estimate_tokens_short(t).alias("short_estimate"))


@query(f"""WITH c AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest({TOKENS.format('text')}) AS w FROM documents) GROUP BY 1, 2)
SELECT lang, w AS word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS rn FROM c) WHERE rn <= 10""")
def top_words(spark, d):
    c = table(spark, d, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return relations.keep_latest(c, ["lang"], [F.desc("n"), F.col("word")], 10)


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_extract(spark, d):
    return readers.extract_html(table(spark, d, "pages"), "page_id", "html")


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '') AS url, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS domain FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"), T.domain(F.col("url")).alias("domain"))


@query(r"""SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '') ORDER BY page_id) AS rn FROM pages) WHERE rn = 1""")
def web_dedupe_url(spark, d):
    return folding.first_by(table(spark, d, "pages"), [T.normalize_url(F.col("url"))], [F.col("page_id")]).select("page_id")


_TITLE_SETS = """t AS (SELECT min(id) AS id, w FROM (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))) AS w FROM part) GROUP BY w)"""


@query(f"WITH {_TITLE_SETS} SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id < b.id AND 100 * len(list_intersect(a.w, b.w)) >= 50 * len(list_distinct(list_concat(a.w, b.w)))")
def web_dedupe_title_jaccard(spark, d):
    return folding.similar_titles(table(spark, d, "part"), "p_partkey", "p_name", 50)


@query("""SELECT id, head FROM (SELECT id, min(id) OVER (PARTITION BY w) AS head FROM (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))) AS w FROM part)) WHERE id <> head""")
def web_dedupe_title_members(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), folding.title_words(F.col("p_name")).alias("w"))
    return rows.join(rows.groupBy("w").agg(F.min("id").alias("head")), "w").filter("id <> head").select("id", "head")


@query(r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '') AS u,
CASE WHEN page_id % 3 = 0 THEN 'short' ELSE 'a longer title ' || (page_id % 40) END AS t FROM pages), e AS (SELECT * FROM n WHERE page_id % 2 = 0)
SELECT min(page_id) AS page_id FROM n WHERE page_id % 2 = 1 AND u NOT IN (SELECT u FROM e) AND (length(t) <= 8 OR t NOT IN (SELECT t FROM e)) GROUP BY u""")
def fetch_more_novelty(spark, d):
    title = F.when(F.col("page_id") % 3 == 0, "short").otherwise(F.concat(F.lit("a longer title "), (F.col("page_id") % 40).cast("string")))
    p = table(spark, d, "pages").select("page_id", "url", title.alias("title"))
    return folding.novel(p.filter("page_id % 2 = 1"), p.filter("page_id % 2 = 0"), "page_id").select("page_id")


_HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\.', '')"
_HIGH = r"regexp_matches(host, 'gov|edu|nature\.com|science\.org|pubmed\.ncbi\.nlm\.nih\.gov|scholar\.google|arxiv\.org|bbc\.com|reuters\.com|apnews\.com|nytimes\.com|theguardian\.com|who\.int|un\.org')"


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.city.gov.in/a' WHEN 1 THEN 'nowhere' ELSE url END AS url FROM pages))
SELECT page_id, CASE WHEN host = '' THEN 'low' WHEN page_id % 7 = 0 OR {_HIGH} THEN 'high' ELSE 'medium' END AS quality FROM h""")
def source_quality(spark, d):
    url = F.when(F.col("page_id") % 5 == 0, "https://www.city.gov.in/a").when(F.col("page_id") % 5 == 1, "nowhere").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.source_quality(url, F.when(F.col("page_id") % 7 == 0, "paper").otherwise("article")).alias("quality"))


@query(f"""SELECT page_id, (50 + CASE WHEN page_id % 4 IN (1, 2) OR {_HIGH.replace('host', _HOST)} THEN 25 ELSE 12 END
  + CASE page_id % 4 WHEN 0 THEN 25 WHEN 1 THEN CASE WHEN length(html) > 100 THEN 20 ELSE 0 END + CASE WHEN page_id % 90 > 5 THEN least(15, (page_id % 90) // 5) ELSE 0 END WHEN 2 THEN 15 ELSE CASE WHEN length(html) > 200 THEN 10 ELSE 0 END END
  + CASE WHEN regexp_matches(lower(url), 'gov|niti aayog|pib|nature|ieee|arxiv|science|reuters|bloomberg|isro') THEN 15 ELSE 0 END)::DOUBLE AS score FROM pages""")
def source_priority(spark, d):
    kind = F.element_at(F.array(*(F.lit(k) for k in ("video", "paper", "report", "article"))), (F.col("page_id") % 4 + 1).cast("int"))
    none = F.lit(None).cast("double")
    score = selection.source_priority(F.lit(False), none, T.source_quality(F.col("url"), kind), kind, F.col("html"), F.col("page_id") % 90, F.lit(True), F.lit(60), none.cast("string"), F.col("url"))
    return table(spark, d, "pages").select("page_id", score.alias("score"))


@query("""WITH w AS (SELECT p_partkey, p_name, lower(p_type) AS b, 1 - (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / count(*) OVER (PARTITION BY p_brand)::DOUBLE AS native FROM part),
k AS (SELECT p_partkey, native, least(1.0::DOUBLE, (CASE WHEN regexp_matches(p_name, '\\bsmall') THEN 1.0::DOUBLE WHEN regexp_matches(b, '\\bsmall') THEN 0.6::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(p_name, '\\bwidget') THEN 1.0::DOUBLE WHEN regexp_matches(b, '\\bwidget') THEN 0.6::DOUBLE ELSE 0 END) / 2 + CASE WHEN contains(p_name, 'small widget') THEN 0.15::DOUBLE ELSE 0 END) AS kw FROM w),
r AS (SELECT p_partkey, round(least(0.99::DOUBLE, CASE WHEN kw > 0 THEN 0.25::DOUBLE + 0.4::DOUBLE * kw + 0.1::DOUBLE * native ELSE 0.1::DOUBLE * native END), 4) AS score FROM k) SELECT * FROM r WHERE score >= 0.15""")
def catalog_rank(spark, d):
    w = Window.partitionBy("p_brand")
    native = 1 - (F.row_number().over(w.orderBy("p_partkey")) - 1) / F.count("*").over(w)
    none = F.lit(None).cast("double")
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_type", native.alias("native"))
    keywords = selection.catalog_keywords(["small", "widget"], T.tokens(F.col("p_name")), T.tokens(F.col("p_type")))
    return rows.select("p_partkey", selection.catalog_score(keywords, F.col("native"), none, none).alias("score")).filter("score >= 0.15")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part")
def norm_title(spark, d):
    return table(spark, d, "part").select("p_partkey", T.norm_title(F.col("p_name")).alias("title"), T.title_key(F.col("p_name")).alias("key"))


@query("""WITH s AS (SELECT p_partkey, lpad((p_partkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS c FROM part), t AS (SELECT p_partkey, '978' || c AS c FROM s),
u AS (SELECT p_partkey, c, list_sum(list_transform(range(1, 13), lambda i: substr(c, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) AS total FROM t)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN c || '5' WHEN 1 THEN NULL ELSE c || ((10 - total % 10) % 10)::INT::VARCHAR END AS isbn FROM u""")
def isbn13(spark, d):
    nine = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    given = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("978-"), nine, F.lit("-5"))).when(F.col("p_partkey") % 4 == 1, F.concat(nine, F.lit("X9"))).when(
        F.col("p_partkey") % 4 == 2, F.concat(nine, F.lit("x"))).otherwise(F.concat(F.substring(nine, 1, 4), F.lit("-"), F.substring(nine, 5, 5), F.lit(" 1")))
    return table(spark, d, "part").select("p_partkey", T.isbn13(given).alias("isbn"))


def _records(spark, d):
    """Parts as catalog records: some share an ISBN, a DOI, or title and author."""
    k = F.col("p_partkey")
    strings = "array<string>"
    return table(spark, d, "part").select(
        k.alias("id"), F.when(k % 2 == 0, "koha").otherwise("dspace").alias("source"), (F.col("p_size") / 50).alias("score"), F.when(k % 10 == 0, F.concat(F.lit("10.1/"), F.floor(k / 30).cast("string"))).alias("doi"),
        F.lit(None).cast("string").alias("handle"), F.when(k % 10 == 1, F.array(F.concat(F.lit("978"), F.lpad(F.floor(k / 20).cast("string"), 10, "0")))).otherwise(F.array().cast(strings)).alias("isbns"),
        F.concat(F.lit("The "), F.col("p_name"), F.lit(" of "), F.floor(k / 7).cast("string")).alias("title"), F.array(F.concat(F.col("p_brand"), F.lit(", A."))).alias("authors"), F.when(k % 3 == 0, F.col("p_size")).alias("year"),
        F.when(k % 4 == 0, F.col("p_type")).alias("abstract"), F.array("p_type").alias("subjects"))


_RECORDS = """r AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS score, CASE WHEN p_partkey % 10 = 0 THEN 'doi:' || (p_partkey // 30) END AS doi, CASE WHEN p_partkey % 10 = 1 THEN 'isbn:' || (p_partkey // 20) END AS isbn,
regexp_replace(lower(p_name || ' of ' || (p_partkey // 7)), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS t FROM part),
k AS (SELECT id, doi AS k FROM r WHERE doi IS NOT NULL UNION SELECT id, isbn FROM r WHERE isbn IS NOT NULL UNION SELECT id, t FROM r WHERE length(split_part(t, '|', 1)) >= 10)"""


@query(f"WITH {_RECORDS} SELECT id, k FROM (SELECT id, CASE WHEN k LIKE '%|%' THEN 't:' || k WHEN k LIKE 'doi:%' THEN 'doi:10.1/' || k[5:] ELSE 'isbn:978' || lpad(k[6:], 10, '0') END AS k FROM k)")
def catalog_keys(spark, d):
    return folding.catalog_keys(_records(spark, d))


@query(f"""WITH RECURSIVE {_RECORDS}, e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.k = b.k AND a.id <> b.id), c AS (SELECT id, id AS head FROM r UNION SELECT e.b, c.head FROM c JOIN e ON e.a = c.id WHERE c.head < e.b)
SELECT id, min(head) AS head FROM c GROUP BY 1""")
def catalog_fold(spark, d):
    return folding.fold_catalog(_records(spark, d))


@query(f"""WITH RECURSIVE {_RECORDS}, e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.k = b.k AND a.id <> b.id), c AS (SELECT id, id AS head FROM r UNION SELECT e.b, c.head FROM c JOIN e ON e.a = c.id WHERE c.head < e.b),
h AS (SELECT id, min(head) AS head FROM c GROUP BY 1), m AS (SELECT h.head, r.id, r.score, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS abstract, row_number() OVER (PARTITION BY head ORDER BY r.score DESC, r.id) AS rn FROM h JOIN r USING (id) JOIN part ON p_partkey = r.id)
SELECT arg_min(id, rn) AS id, max(score) AS score, arg_min(abstract, rn) FILTER (abstract IS NOT NULL) AS abstract, count(*) - 1 AS copies, coalesce(string_agg(id::VARCHAR, ',' ORDER BY rn) FILTER (rn > 1), '') AS also FROM m GROUP BY head""")
def catalog_merge(spark, d):
    m = folding.merge_catalog(_records(spark, d))
    return m.select("id", "score", "abstract", F.size("also_in").cast("long").alias("copies"), F.array_join(F.transform("also_in", lambda x: x["id"].cast("string")), ",").alias("also"))


@query()
def chunk_text(spark, d):
    return chunking.chunk_text(table(spark, d, "documents"), "doc_id", "text")


@query()
def transcript_windows(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 12.0).alias("ts_start"), (F.col("turn") * 12.0 + 10).alias("ts_end"), "text")
    return chunking.transcript_windows(c, "conv_id")


@query()
def csv_row_chunks(spark, d):
    return chunking.row_chunks(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_partkey", "l_quantity", "l_shipdate"], 120)


@query()
def changed_frames(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), folding.hash_column(F.col("event_type")).alias("hash"))
    return chunking.keep_changed_frames(e, "user_id", gap=86400.0)


@query("""WITH r AS (SELECT doc_id, coalesce(quality, 0) AS rel, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, lang FROM documents LEFT JOIN labels USING (doc_id)), f AS (SELECT lang, min(rank) FILTER (rel = 1) AS first FROM r GROUP BY 1)
SELECT count(*) AS queries, avg((first <= 5)::INT)::DOUBLE AS recall5, round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS mrr FROM f""")
def eval_recall_mrr(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    # ranks of a longest-first list: only the best relevant row of each language needs its rank
    best = docs.filter("quality = 1").groupBy("lang").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("i"))).alias("b"))
    ahead = docs.crossJoin(F.broadcast(best.withColumnRenamed("lang", "l"))).filter(F.struct("n_chars", -F.col("doc_id")) >= F.col("b")).groupBy("l").agg(F.count("*").alias("first"))
    f = docs.select("lang").distinct().join(ahead.withColumnRenamed("l", "lang"), "lang", "left")
    return f.agg(F.count("*").alias("queries"), F.avg(F.coalesce((F.col("first") <= 5).cast("int"), F.lit(None))).alias("recall5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def _events(spark, d):
    return S.event_stream(spark, f"{d}/events.parquet")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return S.run_to_end(S.tumbling(_events(spark, d), "1 day", "event_type"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def stream_hopping(spark, d):
    return S.run_to_end(S.hopping(_events(spark, d), "12 hours", "6 hours", "event_type"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT min(ts)::TIMESTAMP AS start, user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_session(spark, d):
    return S.run_to_end(S.sessions(_events(spark, d), "6 hours", "user_id"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedupe(spark, d):
    e = S.event_stream(spark, f"{d}/events.parquet", late="3650 days")
    return S.run_to_end(S.first_within(e, ["user_id", "event_type"]).select("user_id", "event_type"))
