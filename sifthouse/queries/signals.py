"""Scores from single signals, contexts for a model, and result lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, fusion, relations, research, retrieval, signals
from ..session import table
from .registry import TOKENS, query


@query("""WITH s AS (SELECT event_id AS file, event_id % 3 = 0 AS visual, CASE WHEN event_id % 4 <> 1 THEN (event_id % 83) / 100.0 ELSE 0 END::DOUBLE AS t, CASE WHEN event_id % 3 = 0 THEN (event_id % 71) / 80.0 ELSE 0 END::DOUBLE AS i, CASE WHEN event_id % 5 = 0 THEN (event_id % 89) / 90.0 ELSE 0 END::DOUBLE AS f0,
CASE WHEN event_id % 11 = 0 THEN (event_id % 97) / 97.0 ELSE 0 END::DOUBLE AS h, CASE WHEN event_id % 2 = 0 THEN (event_id % 61) / 100.0 ELSE 0 END::DOUBLE AS w, event_id % 97 = 0 AS exact, event_id % 2 = 0 AS fq, event_id % 7 < 4 AS fm FROM events),
a AS (SELECT *, CASE WHEN fq THEN f0 ELSE 0 END AS f FROM s), b AS (SELECT *, greatest(t, i, f) AS v, CASE WHEN f < 0.48 THEN f ELSE least(0.98, greatest(f, 0.75 + (f - 0.48) / 0.42 * 0.23)) END AS cf, CASE WHEN i < 0.35 THEN i ELSE least(0.96, greatest(i, 0.65 + (i - 0.35) / 0.5 * 0.31)) END AS ci FROM a),
c AS (SELECT *, greatest(ci, CASE WHEN fq THEN cf ELSE 0 END) AS z, greatest(v, w) AS m FROM b),
r AS (SELECT file, CASE WHEN exact OR h >= 0.95 THEN CASE WHEN h > 0 THEN h ELSE 0.98 END WHEN fq AND fm AND f >= 0.48 THEN cf WHEN visual AND z >= 0.6 THEN CASE WHEN w > 0 THEN least(0.99, z + 0.05 * w * (1 - z)) ELSE z END
WHEN v > 0 AND w > 0 THEN least(0.99, m + 0.1 * least(v, w) * (1 - m)) WHEN m > 0 THEN m ELSE h END AS score FROM c) SELECT file, round(score, 9)::DOUBLE AS score FROM r WHERE score >= 0.2""")
def composite_scores(spark, d):
    k = F.col("event_id")
    some = lambda when, n, of: F.when(when, (k % n) / float(of))
    rows = table(spark, d, "events").select(
        k.alias("file"), (k % 3 == 0).alias("visual"), some(k % 4 != 1, 83, 100).alias("text"), some(k % 3 == 0, 71, 80).alias("image"), some(k % 5 == 0, 89, 90).alias("face"), some(k % 11 == 0, 97, 97).alias("hash"),
        some(k % 2 == 0, 61, 100).alias("words"), F.lit(None).cast("double").alias("title"), (k % 97 == 0).alias("exact"), (k % 2 == 0).alias("face_query"), (k % 7 < 4).alias("face_match"))
    return signals.composite(rows).select("file", F.round("score", 9).alias("score"))


@query("""WITH h AS (SELECT p_partkey AS id, (p_partkey % 1024)::BIGINT AS p, (p_partkey * 3 % 4096)::BIGINT AS q FROM part), b AS (SELECT id, bit_count(xor(p, 85::BIGINT))::INT AS x, bit_count(xor(q, 51::BIGINT))::INT AS y FROM h),
s AS (SELECT id, x <= 3 AND y <= 3 AS exact, CASE WHEN greatest(x, y) = 0 THEN 1.0 WHEN greatest(x, y) <= 2 THEN 0.99 WHEN greatest(x, y) <= 3 THEN 0.98 WHEN greatest(x, y) <= 5 THEN 0.95 WHEN least(x, y) <= 4 THEN 0.94 WHEN least(x, y) <= 6 THEN 0.9 WHEN least(x, y) <= 8 THEN 0.8 WHEN least(x, y) <= 10 THEN 0.65 ELSE 0 END::DOUBLE AS similarity FROM b WHERE x <= 8 OR y <= 8)
SELECT id, similarity, exact FROM s WHERE similarity >= 0.6""")
def picture_hashes(spark, d):
    k = F.col("p_partkey")
    return signals.hash_matches(table(spark, d, "part").select(k.alias("id"), (k % 1024).cast("long").alias("p"), (k * 3 % 4096).cast("long").alias("d")), 85, 51)


@query("""WITH c AS (SELECT user_id AS id, event_type AS prompt, max(value) / 1000 AS cosine FROM events GROUP BY 1, 2), w AS (SELECT id, prompt, exp(20 * cosine) AS w FROM c)
SELECT id, round(sum(CASE WHEN prompt IN ('click', 'view') THEN w ELSE 0 END) / sum(w), 6)::DOUBLE AS share FROM w GROUP BY 1""")
def text_gate(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("prompt")).agg((F.max("value") / 1000).alias("cosine"))
    prompts = table(spark, d, "events").select(F.col("event_type").alias("prompt")).distinct().withColumn("place", F.when(F.col("prompt").isin("click", "view"), 0).otherwise(10))
    return signals.text_likelihood(e, prompts, 10).select("id", F.round("share", 6).alias("share"))


@query("SELECT p_partkey AS file, greatest(r, p) AS rerank, p IS NOT NULL AND p > coalesce(r, -1) AS by_picture FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50.0 END::DOUBLE AS r, q AS p FROM part LEFT JOIN (SELECT l_partkey, max(l_discount * 10) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_partkey = p_partkey)")
def picture_verdicts(spark, d):
    files = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 50).alias("rerank"))
    verdicts = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("file"), (F.col("l_discount") * 10).alias("score"))
    return signals.reranked_pictures(files, verdicts)


@query("""WITH c AS (SELECT conv_id AS s, turn AS ord, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations), z AS (SELECT s, sum(length(text)) AS chars, count(*) AS n FROM c GROUP BY 1),
w AS (SELECT *, CASE WHEN chars <= 300 THEN n ELSE greatest(1, least(n, floor(300 / greatest(1.0, chars / n::DOUBLE)))) END AS k FROM z) SELECT s AS source_id, ord FROM c JOIN w USING (s) WHERE floor(ceil(i * k / n) * n / k) = i""")
def sampled_chunks(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("ord"), "text")
    return context.sampled_chunks(c, 300).select("source_id", "ord")


@query(r"""WITH l AS (SELECT conv_id AS s, turn, '[' || role || ' p.' || turn || CASE WHEN turn % 2 = 0 THEN ' ' || (turn * 50 // 60) || ':' || lpad((turn * 50 % 60)::VARCHAR, 2, '0') ELSE '' END || '] ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM conversations)
SELECT s AS source_id, substr(CASE WHEN s % 2 = 0 THEN 'Best matching passage: hit ' || s || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY turn), 1, 100000) AS context FROM l GROUP BY 1""")
def document_contexts(spark, d):
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("ord"), "text", F.col("role").alias("kind"), F.col("turn").alias("page"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 50.0).alias("ts_start"))
    matched = c.select("source_id").distinct().filter("source_id % 2 = 0").withColumn("passage", F.concat(F.lit("hit "), F.col("source_id").cast("string")))
    return context.document_context(c, matched, 100_000)


@query("""WITH p AS (SELECT page_id, substr(html, 1, 40) AS x, CASE page_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'paper' WHEN 2 THEN 'report' ELSE 'article' END AS kind FROM pages)
SELECT page_id, CASE WHEN length(c) > 90 THEN substr(c, 1, 90) || '… [content truncated]' ELSE c END AS context FROM (SELECT page_id, '[' || upper(kind) || '] "T' || page_id || '" | Prov | 2024-01-05' || CASE kind WHEN 'video' THEN chr(10) || 'Duration: 3:10' || chr(10) || 'Key Video Notes:' || chr(10) || x
WHEN 'paper' THEN chr(10) || 'Citations: 7' || chr(10) || 'Abstract:' || chr(10) || x WHEN 'report' THEN chr(10) || 'Report Executive Summary & Directives:' || chr(10) || x ELSE chr(10) || 'Content Excerpt:' || chr(10) || x END AS c FROM p)""")
def source_contexts(spark, d):
    k = F.col("page_id")
    none = F.lit(None).cast("string")
    rows = table(spark, d, "pages").select(
        k, F.element_at(F.array(*map(F.lit, ("video", "paper", "report", "article"))), (k % 4 + 1).cast("int")).alias("kind"), F.concat(F.lit("T"), k.cast("string")).alias("title"), F.lit("Prov").alias("provider"), F.lit("2024-01-05T10:00").alias("date"),
        none.alias("author"), F.lit("3:10").alias("duration"), none.alias("transcript"), none.alias("journal"), F.lit(7).alias("citations"), F.substring("html", 1, 40).alias("abstract"), F.substring("html", 1, 40).alias("description"))
    return rows.select("page_id", context.source_context(90).alias("context"))


@query()
def summary_runs(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("place"), "text")
    return context.summary_groups(c, 120)


@query("SELECT user_id, ts FROM (SELECT user_id, epoch(ts)::DOUBLE AS ts, row_number() OVER (PARTITION BY user_id ORDER BY value * (event_id % 7) DESC, ts) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)) AS p FROM events) WHERE p <= 12) WHERE rn = 1")
def thumbnails(spark, d):
    e = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("value").alias("variance"), (F.col("event_id") % 7).alias("brightness"))
    return context.thumbnails(e, "user_id")


@query("""WITH f AS (SELECT user_id, min(epoch(ts)) AS ts, floor(epoch(ts) / 3600) AS slot FROM events GROUP BY 1, 3), r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM f)
SELECT user_id, ts::DOUBLE AS ts FROM r WHERE n <= 10 OR floor(ceil(i * 10 / n::DOUBLE) * n / 10.0) = i""")
def thinned_frames(spark, d):
    e = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return context.thinned_frames(e, "user_id", 10, 3600.0)


@query("SELECT doc_id AS file, 'd' || doc_id || '.txt' AS name, round((n_chars % 1000) / 1000.0, 4)::DOUBLE AS relevance, CASE WHEN doc_id % 3 = 0 THEN doc_id * 2.0 END::DOUBLE AS start_time, CASE WHEN doc_id % 3 = 0 THEN doc_id * 2.0 + 15 END::DOUBLE AS end_time, 'bm25+dense' AS matched FROM documents")
def result_rows(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "file")
    scored = docs.select("file", (F.col("n_chars") % 1000 / 1000).alias("relevance"), F.lit("keywords").alias("evidence"), F.lit("dense,bm25").alias("matched_by"))
    sources = docs.select("file", F.concat(F.lit("d"), F.col("file").cast("string"), F.lit(".txt")).alias("name"), F.lit("x").alias("rel_path"), F.lit("document").alias("kind"))
    shown = context.result_rows(scored, sources, docs.filter("file % 3 = 0").select("file", (F.col("file") * 2.0).alias("ts")))
    return shown.select("file", "name", "relevance", "start_time", "end_time", F.array_join("matched_by", "+").alias("matched"))


@query("SELECT page_id, '# Page ' || page_id || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || substr(html, 1, 50) AS note FROM pages")
def markdown_notes(spark, d):
    return table(spark, d, "pages").select("page_id", context.markdown_note(F.concat(F.lit("Page "), F.col("page_id").cast("string")), F.col("url"), F.substring("html", 1, 50)).alias("note"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 0 OR (1970 + p_size >= 1990 AND 1970 + p_size < 2010)")
def catalog_filters(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") + 1970).alias("year"))
    return context.catalog_filtered(rows, ["document", "image"], "1990-05-01", "2010-01-01").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE (contains(lower(o_orderpriority), 'urg') OR contains(o_orderdate::DATE::VARCHAR, 'urg')) AND o_orderstatus = 'F'")
def timeline_filter(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("description"), F.col("o_orderdate").cast("date").cast("string").alias("date"), F.col("o_orderstatus").alias("importance"))
    return context.timeline_filtered(rows, "URG", "F").select("id")


@query("SELECT c_custkey AS id FROM customer ORDER BY CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey LIMIT 50")
def source_sort(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("date"))
    return rows.orderBy(F.desc_nulls_last("date"), "id").limit(50).select("id")


@query("SELECT id, score FROM (SELECT doc_id AS id, n_chars AS score FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 1000000 + p_partkey, p_size * 100 FROM part) ORDER BY score DESC, id LIMIT 1000")
def overview_rows(spark, d):
    docs = table(spark, d, "documents")
    new = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("long").alias("score"))
    old = docs.select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("score"))
    catalog = table(spark, d, "part").select((F.lit(1_000_000) + F.col("p_partkey")).alias("id"), (F.col("p_size") * 100).cast("long").alias("score"))
    return fusion.with_precedence(new, old, "id").unionByName(catalog).orderBy(F.desc("score"), "id").limit(1000)


@query(f"""WITH w AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) >= 3 GROUP BY 1, 2) SELECT doc_id, w AS word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rn FROM c) WHERE rn <= 8""")
def similar_signals(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"), 3)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return relations.keep_latest(c, ["doc_id"], [F.desc("n"), F.col("word")], 8).select("doc_id", "word")


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN c_name END AS name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'src-' ELSE '' END || o_custkey AS sid FROM orders) LEFT JOIN customer ON regexp_replace(sid, '^src-', '') = c_custkey::VARCHAR""")
def parent_files(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "src-").otherwise(""), F.col("o_custkey").cast("string")).alias("source_id"))
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.col("c_name").alias("name"))
    return relations.with_parent(o, c).select("o_orderkey", "name")


@query("SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low, count(*) AS n FROM orders GROUP BY 1")
def index_statistics(spark, d):
    o = table(spark, d, "orders")
    kinds = o.groupBy(F.col("o_orderstatus").alias("status")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count().toDF("status", "urgent", "low")
    return kinds.na.fill(0, ["urgent", "low"]).join(o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), "status")


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""WITH p AS (SELECT vec_id, embedding FROM embeddings WHERE label = 1), n AS (SELECT count(*) AS n FROM p), r AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM p), q AS (SELECT embedding FROM r, n WHERE i % greatest(1, n // 3) = 0 AND i // greatest(1, n // 3) < 3),
s AS (SELECT e.vec_id, max({_DOT}) AS x FROM embeddings e, q WHERE e.label <> 1 GROUP BY 1 ORDER BY x DESC, e.vec_id LIMIT 50) SELECT vec_id, round(x, 6) AS score FROM s""")
def find_similar(spark, d):
    e = table(spark, d, "embeddings")
    picks = relations.spread_picks(e.filter("label = 1"), ["label"], [F.col("vec_id")]).select(F.col("vec_id").alias("id"), "embedding")
    others = e.filter("label <> 1").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = retrieval.dense_topk_batch(picks, others, 50)
    best = fusion.merge_max(found.select("id", "score"), ["id"]).orderBy(F.desc("score"), "id").limit(50)
    return best.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT e.vec_id, {_DOT} AS x FROM embeddings e, embeddings q WHERE q.vec_id = 9), c AS (SELECT vec_id, CASE WHEN x <= 0.08 THEN 0 WHEN x < 0.15 THEN (x - 0.08) / 0.07 * 0.2 WHEN x >= 0.35 THEN 0.92 ELSE 0.2 + (x - 0.15) / 0.2 * 0.72 END AS r FROM s) SELECT vec_id, round(r, 5)::DOUBLE AS relevance FROM c WHERE r > 0""")
def sound_search(spark, d):
    from ..functions import scores
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 9").select(F.col("embedding").alias("q"))
    r = scores.calibrated(F.lit("sound"), scores.dot(F.col("embedding"), F.col("q")))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(r, 5).alias("relevance")).filter("relevance > 0")


@query()
def legacy_chunks(spark, d):
    return chunking.cut_legacy(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT page_id AS id, min(doc_id) AS file FROM (SELECT page_id, regexp_replace(lower('Title number ' || page_id % 300), '[^a-z0-9]', '', 'g') AS t FROM pages) JOIN (SELECT doc_id, regexp_replace(lower('title number ' || doc_id % 500), '[^a-z0-9]', '', 'g') AS t FROM documents) USING (t) GROUP BY 1")
def local_copies(spark, d):
    from ..operators import folding
    records = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("The Title number "), (F.col("page_id") % 300).cast("string")).alias("title"))
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.concat(F.lit("title_number-"), (F.col("doc_id") % 500).cast("string"), F.lit(".pdf")).alias("name"))
    return folding.local_copies(records, files)


@query("SELECT page_id, title, CASE WHEN page_id % 6 = 0 THEN 'report' ELSE 'article' END AS kind FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'a study' ELSE 'news' END AS title FROM pages)")
def split_reports(spark, d):
    rows = table(spark, d, "pages").select(F.lit("t").alias("topic"), F.col("page_id").alias("id"), F.when(F.col("page_id") % 6 == 0, "a study").otherwise("news").alias("title"), F.lit("").alias("description"))
    return research.split_reports(rows, [F.desc("id")]).select(F.col("id").alias("page_id"), "title", "kind")


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'document' ELSE 'image' END AS kind, (n_chars % 997) / 1000.0::DOUBLE AS score FROM documents)
SELECT doc_id FROM (SELECT *, max(score) OVER (PARTITION BY kind) AS top FROM s) WHERE score >= greatest(CASE WHEN kind = 'document' THEN 0.5 ELSE 0.2 END, round(top - 0.6, 4))""")
def visual_cut(spark, d):
    kind = F.when(F.col("doc_id") % 2 == 0, "document").otherwise("image")
    rows = table(spark, d, "documents").select("doc_id", kind.alias("kind"), (F.col("n_chars") % 997 / 1000).alias("score"))
    return fusion.relative_cut(rows, 0.6, fusion.bucket_floor(F.col("kind"), pure_visual=True), ["kind"]).select("doc_id")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'beach in notes' ELSE p_name || ' goa' END AS rest FROM part""")
def without_folder_words(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, "beach in Goa2023 notes").otherwise(F.concat(F.col("p_name"), F.lit(" goa")))
    matched = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("goa"), F.lit("2023"))).otherwise(F.array(F.lit("absent")))
    return table(spark, d, "part").select("p_partkey", T.without_words(text, matched).alias("rest"))


@query("SELECT c_custkey AS face, vec_id, c_acctbal AS quality FROM customer JOIN embeddings ON vec_id = c_custkey AND label = 1")
def faces_with_vectors(spark, d):
    e = table(spark, d, "embeddings").filter("label = 1").select(F.col("vec_id").alias("face"), "vec_id")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("face"), F.col("c_acctbal").alias("quality")).join(e, "face").select("face", "vec_id", "quality")


@query("SELECT p_partkey AS picture, vec_id IS NOT NULL AS has_vector FROM part LEFT JOIN embeddings ON vec_id = p_partkey AND label IN (1, 2)")
def pictures_with_vectors(spark, d):
    e = table(spark, d, "embeddings").filter(F.col("label").isin(1, 2)).select(F.col("vec_id").alias("picture"), F.lit(True).alias("held"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("picture")).join(e, "picture", "left").select("picture", F.col("held").isNotNull().alias("has_vector"))


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM orders""")
def linked_rescan(spark, d):
    o = table(spark, d, "orders")
    fields = lambda size: (F.col("o_orderkey").alias("path"), size.alias("size"), F.lit(1.0).alias("mtime"), F.lit(None).cast("string").alias("fingerprint"))
    old, new = o.select(*fields(F.col("o_custkey"))), o.filter("o_orderkey % 9 <> 0").select(*fields(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))))
    return relations.linked_diff(old, new, "path").select("path", "change")


@query("SELECT doc_id FROM documents WHERE doc_id = 42 OR lang || '/' || source || '/' || doc_id = 'en/src1/17' OR (lang = 'de' AND doc_id = 9)")
def find_source(spark, d):
    docs = table(spark, d, "documents").withColumn("rel_path", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))).withColumn("source_id", F.col("doc_id").cast("string"))
    found = [relations.find_source(docs, x) for x in ("src-42", "en/src1/17")]
    return found[0].unionByName(found[1]).select("doc_id").union(relations.find_source(docs.filter("lang = 'de'"), "9").select("doc_id")).distinct()


@query("""SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > 86400 THEN true ELSE false END AS first FROM (SELECT user_id, epoch(ts)::DOUBLE AS ts, event_id FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def face_track_heads(spark, d):
    e = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("face"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    tracks = chunking.face_tracks(e, "user_id", gap=86400.0, alike=0.6)
    return tracks.select("user_id", "ts", (F.col("track") == F.col("face")).alias("first"))


@query("SELECT event_id AS id FROM events WHERE event_type IN ('view', 'click') ORDER BY CASE event_type WHEN 'click' THEN 0 ELSE 1 END, value DESC, event_id LIMIT 60")
def discovered_order(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    return e.orderBy(F.when(F.col("event_type") == "click", 0).otherwise(1), F.desc("value"), "event_id").limit(60).select(F.col("event_id").alias("id"))


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def top_relevant(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(5).select("doc_id")


@query("""WITH h AS (SELECT doc_id AS file, CASE WHEN lang = 'en' THEN (n_chars % 97) / 97.0 END::DOUBLE AS dense, CASE WHEN doc_id % 2 = 0 THEN 0.6 END::DOUBLE AS face FROM documents)
SELECT file, CASE WHEN dense IS NOT NULL AND CASE WHEN dense <= 0.3 THEN 0 WHEN dense < 0.4 THEN (dense - 0.3) / 0.1 * 0.2 WHEN dense >= 0.7 THEN 0.95 ELSE 0.2 + (dense - 0.4) / 0.3 * 0.75 END > coalesce(CASE WHEN face IS NOT NULL THEN 0.7 + 0.18 / 0.33 * 0.28 END, -1) THEN 'dense' WHEN face IS NOT NULL THEN 'face' ELSE 'keywords' END AS evidence FROM h""")
def evidence_labels(spark, d):
    docs = table(spark, d, "documents")
    part = lambda name, score, where: docs.filter(where).select(F.lit(name).alias("retriever"), F.col("doc_id").alias("file"), score.cast("double").alias("score"), F.lit(0).alias("rank"))
    ranks = part("dense", F.col("n_chars") % 97 / 97, "lang = 'en'").union(part("face", F.lit(0.6), "doc_id % 2 = 0")).union(part("bm25", F.lit(1.0), "true"))
    return fusion.scored_files(ranks, fusion.rrf(ranks)).select("file", "evidence")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents WHERE lang = 'de'), f AS (SELECT doc_id, len(w)::DOUBLE AS dl, len(list_filter(w, lambda x: x = 'lich'))::DOUBLE AS f0, len(list_filter(w, lambda x: x = 'und'))::DOUBLE AS f1 FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM f),
r AS (SELECT doc_id, greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / a)) + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a)) AS score, f0 > 0 AND f1 > 0 AS whole FROM f, s WHERE f0 > 0 OR f1 > 0),
c AS (SELECT count(*) FILTER (whole) AS nf FROM r) SELECT doc_id, round(score, 6) AS score FROM r, c WHERE whole OR nf < 7.5 ORDER BY score DESC, doc_id LIMIT 30""")
def folder_bm25(spark, d):
    """Words searched only inside a named folder: its files' own statistics count. Scores are ranked as they are rounded."""
    docs = table(spark, d, "documents")
    folder = F.concat(F.translate("lang", "/", ":"), F.lit("/"), F.coalesce("source", F.lit("")))  # a language is one folder, and none has no folder
    members = relations.under_scopes(docs.withColumn("folder", folder), "folder", ["de"])
    return retrieval.bm25(members, ["lich", "und"], "doc_id", {"text": 1.0}, 30, places=6, average_nulls=False).select("doc_id", "score")
