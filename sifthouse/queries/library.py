"""Text pieces, files, people, chunks, web sources and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text as T
from ..operators import facets, folding, fusion, people, relations, research, topics
from ..session import table
from ..streaming import events as S, files
from .registry import TOKENS, query

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@query(f"""WITH t AS (SELECT doc_id, list_filter({TOKENS.format('text')}, lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t)) AS w FROM documents),
f AS (SELECT doc_id, w, list_filter(w, lambda x, i: list_position(w, x) = i) AS d FROM t) SELECT doc_id, array_to_string(d[1:10], ' ') AS words FROM f""")
def keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("words"))


@query(f"""WITH e AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents), f AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS d FROM e),
g AS (SELECT doc_id, d, list_filter(d, lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x)) AS s FROM f) SELECT doc_id, array_to_string((CASE WHEN len(s) > 0 THEN s ELSE d END)[1:24], ' ') AS terms FROM g""")
def search_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.search_terms(F.col("text")), " ").alias("terms"))


@query("""SELECT doc_id, CASE list_position(['pdf', 'heif', '3gp', 'opus', 'exe'], x) WHEN 1 THEN 'document' WHEN 2 THEN 'image' WHEN 3 THEN 'video' WHEN 4 THEN 'audio' ELSE 'unsupported' END AS kind
FROM (SELECT doc_id, ['pdf', 'heif', '3gp', 'opus', 'exe'][(doc_id % 5 + 1)::INT] AS x FROM documents)""")
def file_kinds(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("PDF", "heif", "3gp", "Opus", "exe"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.kind_of(ext).alias("kind"))


_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(rf"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\[[^\]]+\]\s*', '', 'g'), '\s+', ' ', 'g')) AS c FROM documents),
p AS (SELECT doc_id, c, list_filter(string_split(regexp_replace(c, '([.!?।॥])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 25)[1:3] AS l FROM s),
o AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ' ') ELSE substr(c, 1, 600) END AS o FROM p) SELECT doc_id, CASE WHEN length(o) > 600 THEN rtrim(substr(o, 1, 600)) || '…' ELSE o END AS summary FROM o""")
def extractive_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", T.extractive_summary(F.col("text")).alias("summary"))


@query("""WITH s AS (SELECT doc_id, text AS t, substr(text, 1, 370) AS c, greatest(ceil(length(text) / 3.8), ceil(len(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) * 1.3)) AS n FROM documents),
e AS (SELECT *, greatest(CASE WHEN contains(c, '. ') THEN length(c) - strpos(reverse(c), ' .') - 1 ELSE -1 END, CASE WHEN contains(c, '.' || chr(10)) THEN length(c) - strpos(reverse(c), chr(10) || '.') - 1 ELSE -1 END,
CASE WHEN contains(c, '? ') THEN length(c) - strpos(reverse(c), ' ?') - 1 ELSE -1 END, CASE WHEN contains(c, '! ') THEN length(c) - strpos(reverse(c), ' !') - 1 ELSE -1 END) AS k,
CASE WHEN contains(c, ' ') THEN length(c) - strpos(reverse(c), ' ') ELSE -1 END AS w FROM s)
SELECT doc_id, CASE WHEN n <= 100 OR length(t) <= 370 THEN t WHEN k > 259 THEN substr(c, 1, k + 1) || ' [truncated for token budget]' WHEN w > 259 THEN substr(c, 1, w) || '… [truncated for token budget]' ELSE c || '… [truncated for token budget]' END AS text FROM e""")
def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_to_tokens(F.col("text"), 100).alias("text"))


@query(rf"""SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE CASE WHEN regexp_replace(substr(s, 1, 80), '\s+\S*$', '') = '' THEN substr(s, 1, 80) ELSE regexp_replace(substr(s, 1, 80), '\s+\S*$', '') END || '…' END AS text
FROM (SELECT doc_id, {_SQUEEZED} AS s FROM (SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS text FROM documents))""")
def cleaned_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text"), 80).alias("text"))


@query(r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN '  - ' || p_name || ' :' WHEN 2 THEN 'IMG_0' || p_partkey WHEN 3 THEN 'page ' || p_partkey WHEN 4 THEN p_name || repeat(' more', 20) ELSE 'new folder' END AS t FROM part),
s AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(t, '^[ \t\r\n\-_:;,.|#*]+|[ \t\r\n\-_:;,.|#*]+$', '', 'g'), '\s+', ' ', 'g'), '(?i)^(the|a|an)\s+', '') AS s FROM n),
c AS (SELECT p_partkey, rtrim(CASE WHEN length(s) <= 60 THEN s WHEN contains(substr(s, 1, 60), ' ') THEN regexp_replace(substr(s, 1, 60), ' [^ ]*$', '') ELSE substr(s, 1, 60) END) AS phrase FROM s)
SELECT p_partkey, phrase, p_partkey % 6 IN (3, 5) OR p_partkey % 6 = 2 AND p_partkey >= 10 AS generic FROM c""")
def phrases(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    text = (F.when(k % 6 == 0, F.concat(F.lit("The "), name)).when(k % 6 == 1, F.concat(F.lit("  - "), name, F.lit(" :"))).when(k % 6 == 2, F.concat(F.lit("IMG_0"), k.cast("string")))
            .when(k % 6 == 3, F.concat(F.lit("page "), k.cast("string"))).when(k % 6 == 4, F.concat(name, F.repeat(F.lit(" more"), F.lit(20)))).otherwise("new folder"))
    p = T.clean_phrase(text)
    return table(spark, d, "part").select("p_partkey", p.alias("phrase"), T.is_generic(p).alias("generic"))


@query("SELECT doc_id, source || ' trip|Wedding of ' || lang AS topics FROM documents")
def folder_topics(spark, d):
    folder = F.concat(F.lit("Documents/Wedding_of_"), F.col("lang"), F.lit("/2021-05-03/"), F.col("source"), F.lit("_trip/100MSDCF"))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.folder_topics(folder), "|").alias("topics"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS title, CASE WHEN c_custkey % 2 = 0 THEN 'oneill' ELSE regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g') END AS who FROM customer")
def record_titles(spark, d):
    author = F.when(F.col("c_custkey") % 2 == 0, "O'Neill, Ann").otherwise(F.concat(F.lit("Ann B. "), F.col("c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", T.record_title(F.concat(F.lit(" An "), F.col("c_name"))).alias("title"), T.surname(author).alias("who"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'yt:abcDEF12_-x' WHEN 1 THEN 'yt:zzzzzzz' || page_id % 10 WHEN 2 THEN 'yt:shorts9' ELSE 'example.org/a' END AS url FROM pages""")
def video_urls(spark, d):
    k = F.col("page_id")
    url = (F.when(k % 4 == 0, "https://www.youtube.com/watch?t=3&v=abcDEF12_-x").when(k % 4 == 1, F.concat(F.lit("http://youtu.be/zzzzzzz"), (k % 10).cast("string"), F.lit("?si=1")))
           .when(k % 4 == 2, "https://youtube.com/shorts/shorts9").otherwise("HTTPS://www.Example.org/a/?v=1"))
    return table(spark, d, "pages").select("page_id", T.normalize_url(url).alias("url"))


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN b || '?id=' || page_id ELSE b END AS url FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '\?.*$', ''), '/$', '') AS b FROM pages)""")
def canonical_urls(spark, d):
    bare = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(bare, F.lit("?utm_source=x&ID="), F.col("page_id").cast("string"), F.lit("&ref=a#top"))).otherwise(F.concat(bare, F.lit("?fbclid=1&gclid=2")))
    return table(spark, d, "pages").select("page_id", T.canonical_url(url).alias("url"))


@query("""SELECT event_id, (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS short, CASE WHEN s % 2 = 0 THEN s * 3600 + 62 ELSE s END AS parsed, round(-(s + 30 / 60.0 + 36 / 3600.0), 6)::DOUBLE AS lon
FROM (SELECT event_id, (event_id % 3600)::BIGINT AS s FROM events)""")
def formats(spark, d):
    s = (F.col("event_id") % 3600).cast("long")
    iso = F.when(s % 2 == 0, F.concat(F.lit("PT"), s.cast("string"), F.lit("H1M2S"))).otherwise(F.concat(F.lit("PT"), s.cast("string"), F.lit("S")))
    return table(spark, d, "events").select(
        "event_id", T.format_duration(s).alias("short"), T.parse_duration(iso).alias("parsed"), F.round(T.degrees(s.cast("double"), F.lit(30.0), F.lit(36.0), F.lit("w")), 6).alias("lon"))


@query("""SELECT p_partkey, round((p_size / 50.0) * least(1.0, p_size * 4 / 112.0), 4)::DOUBLE AS quality, greatest(p_size * 5, 60) < 128 OR least(p_size * 5, 60) < 48 AS small, greatest(p_size * 5, 60) >= 160 AND least(p_size * 5, 60) >= 64 AS described FROM part""")
def picture_gates(spark, d):
    w, h = F.col("p_size") * 5, F.lit(60)
    return table(spark, d, "part").select("p_partkey", T.face_quality(F.col("p_size") / 50, F.col("p_size") * 4).alias("quality"), T.is_undersized(w, h).alias("small"), T.is_describable(F.lit("photo"), w, h).alias("described"))


@query(r"SELECT doc_id, length(trim(substr(text, 1, 24))) >= 20 AND len(list_filter(regexp_split_to_array(trim(substr(text, 1, 24)), '\s+'), lambda w: w <> '')) >= 3 AS kept FROM documents")
def read_text_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_read_text(F.substring("text", 1, 24)).alias("kept"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS gone FROM part""")
def excluded_paths(spark, d):
    k = F.col("p_partkey")
    path = (F.when(k % 5 == 0, "private").when(k % 5 == 1, "privately/a.txt").when(k % 5 == 2, F.concat(F.lit("a/b"), k.cast("string"), F.lit(".tmp"))).when(k % 5 == 3, "music/x.mp3").otherwise("a/b.tmp.txt"))
    kind = F.when(k % 5 == 3, "audio").otherwise("document")
    return table(spark, d, "part").select("p_partkey", T.is_excluded(path, kind, ["private", "*.tmp", "kind:audio"]).alias("gone"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/b_c/d.txt' WHEN 1 THEN 'x/y' ELSE 'up/z' END AS safe, p_partkey % 3 = 1 AS inside FROM part""")
def safe_paths(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, "a\\b:c/./d.txt").when(k % 3 == 1, "/x//y").otherwise("../up/../z")
    return table(spark, d, "part").select("p_partkey", T.safe_path(path).alias("safe"), T.is_within(F.concat(F.lit("/root"), path), "/root").alias("inside"))


@query("""WITH n AS (SELECT p_partkey, p_size || '.pdf' AS name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_partkey, CASE WHEN i = 0 THEN name ELSE replace(name, '.pdf', ' (' || i || ').pdf') END AS name FROM n""")
def unique_names(spark, d):
    return relations.unique_names(table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".pdf")).alias("name")), "name", [F.col("p_partkey")]).select("p_partkey", "name")


@query("SELECT event_id, (event_id % 7)::BIGINT AS a, event_type AS b FROM events")
def repaired_json(spark, d):
    said = F.concat(F.lit("<think>{no}</think> Here:\n```json\n{\"a\": "), (F.col("event_id") % 7).cast("string"), F.lit(", \"b\": [\""), F.col("event_type"), F.lit("\",],}\n```"))
    fixed = T.repaired_json(said)
    return table(spark, d, "events").select("event_id", F.get_json_object(fixed, "$.a").cast("long").alias("a"), F.get_json_object(fixed, "$.b[0]").alias("b"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false ELSE true END AS noise FROM part""")
def noise_headers(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 6 == 0, "2024-08-02 list").when(k % 6 == 1, "6:36 PM").when(k % 6 == 2, "Page 3 of 9").when(k % 6 == 3, "and so on").when(k % 6 == 4, "Annual Report").otherwise("www.example.org")
    return table(spark, d, "part").select("p_partkey", T.is_noise_header(line).alias("noise"))


@query(f"""WITH t AS (SELECT p_partkey, list_distinct(list_filter({TOKENS.format('p_name')}, lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x))) AS t, ['small', 'widget'] AS q FROM part),
j AS (SELECT p_partkey, t, q, len(list_intersect(q, t)) AS s, len(list_distinct(list_concat(q, t))) AS e FROM t)
SELECT p_partkey, round(CASE WHEN s = 0 OR len(t) = 0 THEN 0 WHEN s = e THEN 0.95 WHEN s = 2 THEN 0.70 + 0.25 * s / e WHEN s = len(t) AND len(t) >= 2 THEN 0.85 ELSE 0.45 * s / 2 + 0.35 * s / e END, 6)::DOUBLE AS score FROM j""")
def title_scores(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.title_score(F.lit("the small widget"), F.col("p_name")), 6).alias("score"))


@query("""SELECT vec_id, round(CASE WHEN x < 0.42 THEN CASE WHEN x <= 0.25 THEN 0 ELSE (x - 0.25) / 0.17 * 0.45 END WHEN x >= 0.75 THEN 0.98 ELSE 0.70 + (x - 0.42) / 0.33 * 0.28 END, 5)::DOUBLE AS face,
round(greatest(0, 1 - floor(x * 50) / 32.0), 5)::DOUBLE AS dupe, round(CASE WHEN x <= 0.5 THEN 0 WHEN x < 0.65 THEN (x - 0.5) / 0.15 * 0.25 WHEN x >= 0.92 THEN 0.98 ELSE 0.25 + (x - 0.65) / 0.27 * 0.73 END * 0.95, 5)::DOUBLE AS compose
FROM (SELECT vec_id, abs(embedding[2]::DOUBLE) * 4 AS x FROM embeddings)""")
def calibration_faces(spark, d):
    x = F.abs(F.col("embedding")[1].cast("double")) * 4
    c = lambda name, v: F.round(scores.calibrated(F.lit(name), v), 5).alias(name)
    return table(spark, d, "embeddings").select("vec_id", c("face", x), c("dupe", F.floor(x * 50)), c("compose", x))


@query("""SELECT event_id, round(least(0.99, ln(1 + v) / (1 + ln(1 + v))), 4)::DOUBLE AS score, CASE WHEN event_id % 4 = 0 THEN 0.3 WHEN event_id % 4 = 1 THEN 0.3 WHEN event_id % 4 = 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS cut,
CASE WHEN greatest(h, g) = 0 THEN 1.0 WHEN greatest(h, g) <= 2 THEN 0.99 WHEN greatest(h, g) <= 3 THEN 0.98 WHEN greatest(h, g) <= 5 THEN 0.95 WHEN least(h, g) <= 4 THEN 0.94 WHEN least(h, g) <= 6 THEN 0.9 WHEN least(h, g) <= 8 THEN 0.8 WHEN least(h, g) <= 10 THEN 0.65 ELSE 0 END::DOUBLE AS same
FROM (SELECT event_id, value AS v, (event_id % 13)::INT AS h, (event_id % 17)::INT AS g FROM events)""")
def score_ladders(spark, d):
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, "30").when(k % 4 == 1, "0.3").when(k % 4 == 2, "250").otherwise("none")
    return table(spark, d, "events").select("event_id", scores.rank_to_score(F.col("value")).alias("score"), scores.threshold(raw, 0.5).alias("cut"), scores.hash_similarity((k % 13).cast("int"), (k % 17).cast("int")).alias("same"))


_DOTS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""SELECT a.vec_id, round({_DOTS} / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x))), 6) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 5""")
def cosines(spark, d):
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 5").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


# ---- files scored from several lists

_LISTS = """h AS (SELECT 'dense' AS retriever, doc_id AS file, (n_chars % 97) / 100.0::DOUBLE AS score FROM documents UNION ALL SELECT 'clip_text', doc_id, (doc_id * 37 % 83) / 100.0 FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'bm25', doc_id, (n_chars % 31)::DOUBLE FROM documents UNION ALL SELECT 'folder', doc_id, 0.5 FROM documents WHERE lang = 'de')"""


def _lists(spark, d):
    docs = table(spark, d, "documents")
    part = lambda name, score, where="true": docs.filter(where).select(F.lit(name).alias("retriever"), F.col("doc_id").alias("file"), score.cast("double").alias("score"))
    return part("dense", F.col("n_chars") % 97 / 100).union(part("clip_text", F.col("doc_id") * 37 % 83 / 100, "doc_id % 3 = 0")).union(part("bm25", F.col("n_chars") % 31)).union(part("folder", F.lit(0.5), "lang = 'de'"))


_SCORED = _LISTS + """, p AS (SELECT *, row_number() OVER (PARTITION BY retriever ORDER BY score DESC, file) AS place FROM h), k AS (SELECT retriever, file, score, CASE WHEN retriever = 'folder' THEN 0 ELSE place - 1 END AS rank FROM p WHERE place <= CASE WHEN retriever = 'folder' THEN 5000 ELSE 200 END),
f AS (SELECT file, sum(CASE retriever WHEN 'clip_text' THEN 0.8 WHEN 'folder' THEN 1.2 ELSE 1.0 END::DOUBLE / (61 + rank)) AS fused, count(*) AS n_lists, max(score) FILTER (retriever = 'dense') AS d, max(score) FILTER (retriever = 'clip_text') AS c, max(score) FILTER (retriever = 'folder') AS g FROM k GROUP BY 1),
m AS (SELECT *, CASE WHEN d <= 0.3 THEN 0 WHEN d < 0.4 THEN (d - 0.3) / 0.1 * 0.2 WHEN d >= 0.7 THEN 0.95 ELSE 0.2 + (d - 0.4) / 0.3 * 0.75 END::DOUBLE AS cd, CASE WHEN c <= 0.22 THEN 0 WHEN c < 0.3 THEN (c - 0.22) / 0.08 * 0.15 WHEN c >= 0.6 THEN 0.92 ELSE 0.15 + (c - 0.3) / 0.3 * 0.77 END::DOUBLE AS cc, fused / max(fused) OVER () AS norm,
CASE WHEN file % 5 = 0 THEN (file % 9) / 10.0 END::DOUBLE AS r FROM f), n AS (SELECT *, CASE WHEN d IS NOT NULL THEN cd END AS xd, CASE WHEN c IS NOT NULL THEN cc END AS xc FROM m),
q AS (SELECT *, coalesce(xc, 0) AS vis, greatest(coalesce(xd, -1), coalesce(xc, -1)) AS hi, CASE WHEN xd IS NOT NULL AND xc IS NOT NULL THEN least(xd, xc) END AS lo FROM n),
s AS (SELECT *, 0.7 * r + 0.3 * greatest(vis, norm * 0.8 * least(1.0, 4 * r)) AS judged FROM q),
b AS (SELECT *, CASE WHEN r IS NOT NULL THEN greatest(judged, vis) WHEN hi >= 0 THEN least(0.99, hi + coalesce(0.1 * lo * (1 - hi), 0)) ELSE 0.25 + 0.4 * norm END AS rel FROM s),
z AS (SELECT file, n_lists, CASE WHEN g IS NULL THEN rel ELSE least(0.99, greatest(rel + 0.35 * (0.45 + 0.4 * g) * (1 - rel), (0.45 + 0.4 * g) * 0.4)) END AS relevance FROM b)"""


@query(f"WITH {_SCORED} SELECT file, round(relevance, 9) AS relevance, n_lists FROM z")
def scored_files(spark, d):
    h = _lists(spark, d)
    r = fusion.file_ranks(h.filter("retriever <> 'folder'")).unionByName(fusion.file_ranks(h.filter("retriever = 'folder'"), tied=True))
    verdicts = table(spark, d, "documents").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("file"), (F.col("doc_id") % 9 / 10).alias("rerank"))
    return fusion.scored_files(r, fusion.rrf(r), verdicts, other_words=True).select("file", F.round("relevance", 9).alias("relevance"), "n_lists")


@query("""WITH f AS (SELECT doc_id AS file, (n_chars * 31 % 10007)::DOUBLE AS fused, lang = 'de' AS inside FROM documents), o AS (SELECT file FROM f WHERE NOT inside ORDER BY fused DESC, file LIMIT 10)
SELECT file FROM o UNION ALL SELECT file FROM (SELECT file FROM f WHERE inside ORDER BY fused DESC, file LIMIT 30 - (SELECT count(*) FROM o))""")
def rerank_pool(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file"), (F.col("n_chars") * 31 % 10007).cast("double").alias("fused"), (F.col("lang") == "de").alias("inside"))
    return fusion.rerank_pool(f, 30, F.col("inside")).select("file")


@query("SELECT doc_id AS file, lang AS kind FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 20")
def kind_caps(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("lang").alias("kind"), F.col("n_chars").alias("score"))
    return fusion.kind_caps(rows, 20).select("file", "kind")


@query("SELECT doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN s ELSE least(s, (SELECT min(n_chars % 50 + 20) FROM documents WHERE doc_id % 3 = 0)) END AS score FROM (SELECT doc_id, n_chars % 50 + 20 AS s FROM documents)")
def unjudged_floor(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file"), (F.col("n_chars") % 50 + 20).alias("score"), (F.col("doc_id") % 3 == 0).alias("judged"))
    return fusion.unjudged_floor(rows).select("file", "score")


# ---- people

@query("""WITH g AS (SELECT c_custkey AS id, c_nationkey AS person, CASE WHEN c_custkey % 3 <> 0 THEN 'k' || (c_custkey % 4) END AS had, c_custkey % 211 = 0 AS locked FROM customer)
SELECT count(*) AS n, max(id) AS last, count(*) FILTER (locked) AS locked, count(*) FILTER (locked AND had IS NOT NULL) AS decided FROM g""")
def people_signature(spark, d):
    return people.signature(_faces(spark, d))


def _faces(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("k"), (k % 4).cast("string"))).alias("person_id"), (k % 211 == 0).alias("locked"), (F.col("c_acctbal")).alias("quality"))


@query()
def people_ids(spark, d):
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("person"))
    known = spark.createDataFrame([("k0",), ("k1",), ("k3",)], "person_id string")
    return people.assign_ids(groups, _faces(spark, d).select("id", "person_id", "locked"), known)


@query("SELECT person_id, id FROM (SELECT 'k' || (c_custkey % 4) AS person_id, c_custkey AS id, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer WHERE c_custkey % 3 <> 0) WHERE rn <= 6")
def person_faces(spark, d):
    return people.best_faces(_faces(spark, d).filter("person_id is not null")).select("person_id", "id")


@query(f"""WITH t AS (SELECT p_partkey, ' ' || array_to_string({TOKENS.format('p_name')}, ' ') || ' ' AS line FROM part), n AS (SELECT DISTINCT n_nationkey AS person_id, CASE n_nationkey % 3 WHEN 0 THEN 'small widget' WHEN 1 THEN 'steel' ELSE lower(n_name) END AS name FROM nation)
SELECT p_partkey, person_id FROM t, n WHERE contains(line, ' ' || name || ' ')""")
def people_named(spark, d):
    name = F.when(F.col("n_nationkey") % 3 == 0, "Small Widget").when(F.col("n_nationkey") % 3 == 1, "steel").otherwise(F.col("n_name"))
    return people.named_in(table(spark, d, "part"), "p_partkey", "p_name", table(spark, d, "nation").select(F.col("n_nationkey").alias("person_id"), name.alias("name")))


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE i % greatest(1, n // 3) = 0 AND i // greatest(1, n // 3) < 3")
def spread_picks(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id")
    return relations.spread_picks(e, ["label"], [F.col("vec_id")]).select("label", "vec_id")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type))[1:3], ',') AS kinds FROM events GROUP BY 1")
def people_per_source(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 3), ",").alias("kinds"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS rn FROM conversations) WHERE rn = 1")
def caption_dedupe(spark, d):
    c = table(spark, d, "conversations")
    return folding.first_by(c, [F.col("conv_id"), F.lower("text")], [F.col("turn")]).select("conv_id", "turn")


@query("""SELECT DISTINCT b.o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1 AND abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) < 864000""")
def upload_dedupe(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", "o_custkey", "o_orderpriority").alias("name"), F.lit(1).alias("size"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("mtime"))
    return relations.already_there(o.filter("o_orderkey % 2 = 1"), o.filter("o_orderkey % 2 = 0"), 864000.0).select("o_orderkey")


# ---- chunks, sections, upkeep

@query("""WITH s AS (SELECT conv_id AS source_id, role AS kind, turn AS ord, text FROM conversations), n AS (SELECT conv_id AS source_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, 'new' AS text FROM conversations WHERE role = 'user' AND conv_id % 2 = 0),
k AS (SELECT * FROM s WHERE kind <> 'user' OR source_id NOT IN (SELECT source_id FROM n)), l AS (SELECT source_id, max(ord) AS last FROM k GROUP BY 1)
SELECT source_id, kind, ord::INT AS ord, text FROM k UNION ALL SELECT n.source_id, 'user', (coalesce(last + 1, 0) + i - 1)::INT, text FROM n LEFT JOIN l USING (source_id)""")
def replace_chunks(spark, d):
    c = table(spark, d, "conversations")
    new = c.filter("role = 'user' and conv_id % 2 = 0").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("i"), F.lit("new").alias("text"))
    return relations.replace_kind(c.select(F.col("conv_id").alias("source_id"), F.col("role").alias("kind"), F.col("turn").alias("ord"), "text"), new, "user")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def purge_derived(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_id"))
    return relations.purge(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "source_id"), gone).select(F.col("source_id").alias("l_orderkey"), "l_linenumber")


@query("SELECT doc_id FROM documents WHERE lang <> 'de' AND NOT (lang = 'en' AND source = 'src1')")
def remove_under(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat_ws("/", "lang", "source"))
    return relations.remove_under(relations.remove_under(docs, F.col("path"), "de"), F.col("path"), "en/src1").select("doc_id")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'new/deep/' || source WHEN lang || '/' || source = 'en/src2' THEN 'en/other' ELSE lang || '/' || source END AS path FROM documents")
def move_sources(spark, d):
    path = relations.move_prefix(F.concat_ws("/", "lang", "source"), "de", "new/deep")
    return table(spark, d, "documents").select("doc_id", relations.move_prefix(path, "en/src2", "en/other").alias("path"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_custkey % 5 < 3 THEN 'queued' ELSE 'failed' END WHEN 'F' THEN 'pending' ELSE 'indexed' END AS status FROM orders""")
def recover_queue(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "running").otherwise("indexed")
    return table(spark, d, "orders").select("o_orderkey", relations.recovered(status, F.col("o_custkey") % 5).alias("status"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' ELSE 'done' END AS status FROM events")
def enrichment_steps(spark, d):
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", relations.next_status(pick("pending", "running", "running", "failed", "done"), pick("claim", "finish", "fail", "retry", "claim")).alias("status"))


@query("SELECT p_partkey FROM part WHERE (greatest(p_size * 4, 30) < 128 OR least(p_size * 4, 30) < 48) AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def requeue_undersized(spark, d):
    small = table(spark, d, "part").filter(T.is_undersized(F.col("p_size") * 4, F.lit(30)))
    return small.join(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey")


@query("SELECT doc_id, regexp_replace(source || ' ' || lang, '[_-]', ' ', 'g') AS text, lang AS heading FROM documents")
def title_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.concat_ws("_", "source", "lang"), F.lit(".pdf")).alias("name"), F.col("lang").alias("folder"))
    return research.title_chunks(rows, "doc_id").select("doc_id", "text", "heading")


@query("SELECT o_orderkey, coalesce(l.n, 0) AS n, coalesce(s, 'derived') AS origin FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey LEFT JOIN (SELECT DISTINCT o_orderkey AS k, 'llm' AS s FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 = 0) c ON k = o_orderkey")
def insight_cache(spark, d):
    o = table(spark, d, "orders").withColumn("fingerprint", F.col("o_custkey").cast("string"))
    cached = o.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("fingerprint")).otherwise("stale").alias("fingerprint"), F.lit("llm").alias("origin"))
    fresh = o.select(F.col("o_orderkey").alias("source_id"), "fingerprint", F.lit("derived").alias("origin"))
    held = research.cached_first(fresh, cached)
    n = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.count("*").alias("n"))
    return held.join(n, "source_id", "left").select(F.col("source_id").alias("o_orderkey"), F.coalesce("n", F.lit(0)).alias("n"), "origin")


@query("SELECT label AS topic, n FROM (SELECT label, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct([source, lang, 'x' || doc_id])) AS label FROM documents) GROUP BY 1) WHERE n >= 2")
def common_topics(spark, d):
    return facets.common_values(table(spark, d, "documents"), F.array("source", "lang", F.concat(F.lit("x"), F.col("doc_id").cast("string")))).select(F.col("label").alias("topic"), "n")


@query("""WITH c AS (SELECT date_trunc('year', o_orderdate)::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT m.day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(day) FROM c)::TIMESTAMP, (SELECT max(day) FROM c)::TIMESTAMP, INTERVAL 1 YEAR))::DATE AS day) m LEFT JOIN c ON m.day = c.day""")
def hist_years(spark, d):
    return facets.filled_dates(table(spark, d, "orders"), F.col("o_orderdate"), "year")


@query("SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def hist_days(spark, d):
    return facets.filled_dates(table(spark, d, "events"), F.col("ts"), "day")


@query("SELECT CASE WHEN w * 20 < h * 19 THEN 'portrait' WHEN h * 20 < w * 19 THEN 'landscape' ELSE 'square' END AS label, CASE WHEN least(w, h) >= 2000 THEN '4K' WHEN least(w, h) >= 1000 THEN '1080p' WHEN least(w, h) >= 700 THEN '720p' ELSE 'lower' END AS quality, count(*) AS n FROM (SELECT p_size * 80 AS w, (p_partkey % 40 + 5) * 60 AS h FROM part) GROUP BY 1, 2")
def picture_shapes(spark, d):
    w, h = F.col("p_size") * 80, (F.col("p_partkey") % 40 + 5) * 60
    return table(spark, d, "part").groupBy(facets.orientation(w, h).alias("label"), facets.video_quality(w, h).alias("quality")).agg(F.count("*").alias("n"))


# ---- web research

@query(f"""WITH q AS (SELECT item_id, list_distinct({TOKENS.format('text')}) AS w FROM benchmark WHERE item_id % 100 = 0), c AS (SELECT conv_id, turn, list_distinct({TOKENS.format('text')}) AS w FROM conversations),
s AS (SELECT item_id, conv_id, turn, len(list_intersect(q.w, c.w)) AS n FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, conv_id, turn) AS rn FROM s WHERE n > 0) SELECT item_id, conv_id, turn, n::INT AS n FROM r WHERE rn <= 6""")
def overlap_passages(spark, d):
    asked = table(spark, d, "benchmark").filter("item_id % 100 = 0")
    return research.overlap_passages(asked, "item_id", "text", table(spark, d, "conversations"), ["conv_id", "turn"], "text").select("item_id", "conv_id", "turn", "n")


@query(f"""WITH s AS (SELECT conv_id, turn, len(list_intersect(list_distinct({TOKENS.format('text')}), ['the', 'of', 'and'])) AS hits FROM conversations WHERE turn BETWEEN 1 AND 3) SELECT conv_id, arg_max(turn, (hits, -turn)) AS turn FROM s WHERE hits > 0 GROUP BY 1""")
def best_segment(spark, d):
    seg = table(spark, d, "conversations").filter("turn between 1 and 3")
    return research.best_segment(seg, "conv_id", "turn", "text", ["the", "of", "and"])


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'report' ELSE 'article' END AS kind FROM pages")
def report_split(spark, d):
    title = F.when(F.col("page_id") % 4 == 0, "The AUDIT of 2020").otherwise("Some news")
    return table(spark, d, "pages").select("page_id", F.when(research.is_report(title, F.lit("")), "report").otherwise("article").alias("kind"))


@query("SELECT page_id FROM (SELECT page_id, url, page_id % 100 AS rel FROM pages) WHERE contains(lower(url), 'a') AND page_id % 3 = 1 ORDER BY rel DESC, page_id LIMIT 25")
def research_list(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("web").alias("provider"), F.when(F.col("page_id") % 3 == 1, "paper").otherwise("web").alias("kind"), (F.col("page_id") % 100).alias("relevance"))
    return research.listed(rows, "A", "paper", [F.desc("relevance"), F.col("page_id")]).limit(25).select("page_id")


@query("SELECT c_custkey FROM customer ORDER BY list_position(['BUILDING', 'MACHINERY', 'HOUSEHOLD'], c_mktsegment) NULLS LAST, c_acctbal DESC, c_custkey LIMIT 40")
def category_order(spark, d):
    at = facets.category_place(F.col("c_mktsegment"), ["BUILDING", "MACHINERY", "HOUSEHOLD"])
    return table(spark, d, "customer").orderBy(at, F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey")


@query("SELECT user_id, count(*) AS calls, sum(event_id % 100)::BIGINT AS tokens FROM events GROUP BY 1")
def usage_totals(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 100).alias("tokens"))


@query("SELECT user_id, event_type, floor(epoch(ts) / 3600)::BIGINT AS slot, max(value) AS value FROM events GROUP BY 1, 2, 3")
def slot_dedupe(spark, d):
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return table(spark, d, "events").groupBy("user_id", "event_type", slot.alias("slot")).agg(F.max("value").alias("value"))


@query("""SELECT user_id, round(m + CASE WHEN n > 1 THEN 0.01 * least(n - 1, 5) * (1 - m) ELSE 0 END, 6)::DOUBLE AS score FROM (SELECT user_id, max(least(value, 100) / 100) AS m, count(*) AS n FROM events GROUP BY 1)""")
def best_signals(spark, d):
    e = table(spark, d, "events").select("user_id", (F.least(F.col("value"), F.lit(100.0)) / 100).alias("score"))
    return fusion.best_with_boost(e, "user_id").select("user_id", F.round("score", 6).alias("score"))


@query("SELECT c_custkey, n_name, r_name, coalesce(n, 0) AS orders FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def context_chain(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    placed = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return table(spark, d, "customer").join(placed, "c_nationkey").join(n, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT doc_id, replace(replace(s, 'queued', 'uploaded'), 'indexed', 'completed') AS status FROM (SELECT doc_id, ['queued', 'indexed', 'failed'][(doc_id % 3 + 1)::INT] AS s FROM documents)")
def payload_status(spark, d):
    s = F.element_at(F.array(*map(F.lit, ("queued", "indexed", "failed"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", research.payload_status(s).alias("status"))


@query()
def selected_sources(spark, d):
    return research.select_for_budget(_web_sources(spark, d), most=8, budget=4_000)


def _web_sources(spark, d):
    k = F.col("page_id")
    return table(spark, d, "pages").select(
        F.lit("all").alias("topic"), k.alias("id"), F.element_at(F.array(*map(F.lit, ("video", "paper", "report", "article", "web"))), (k % 5 + 1).cast("int")).alias("kind"),
        (k * 37 % 101).cast("double").alias("score"), (k % 97 == 0).alias("chosen"), (k * 13 % 900 + 100).alias("tokens"))


@query("""WITH r AS (SELECT event_id, user_id, ts, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events) SELECT event_id FROM r WHERE n >= 3""")
def failure_lockout(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return files.failures(e, "user_id", F.col("event_type") == "click", minutes=1_440, most=3).select("event_id")


# ---- streams of file events

_EVENTS = """e AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'modified' WHEN 'click' THEN 'moved' ELSE 'deleted' END AS event, CASE WHEN event_id % 7 = 0 THEN '.hidden/' ELSE 'docs/' END || (user_id % 30) || '.txt' AS path,
CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'node_modules/x.txt' ELSE 'moved/' || event_id || '.txt' END END AS dest, event_id % 11 = 0 AS is_dir FROM events)"""


def _file_events(rows):
    k = F.col("event_id")
    click = F.col("event_type") == "click"
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "modified").when(click, "moved").otherwise("deleted").alias("event"),
        F.concat(F.when(k % 7 == 0, ".hidden/").otherwise("docs/"), (F.col("user_id") % 30).cast("string"), F.lit(".txt")).alias("path"),
        F.when(click, F.when(k % 5 == 0, "node_modules/x.txt").otherwise(F.concat(F.lit("moved/"), k.cast("string"), F.lit(".txt")))).alias("dest"), (k % 11 == 0).alias("is_dir"))


@query(f"""WITH {_EVENTS}, o AS (SELECT *, path NOT LIKE '.%' AS seen, dest IS NOT NULL AND dest NOT LIKE 'node%' AS came FROM e),
r AS (SELECT event_id, CASE WHEN event = 'moved' AND seen AND came THEN 'move' WHEN event = 'moved' AND seen THEN 'delete' WHEN event = 'moved' AND came THEN CASE WHEN is_dir THEN 'scan' ELSE 'change' END WHEN event = 'moved' OR NOT seen THEN NULL
WHEN event = 'deleted' THEN 'delete' WHEN NOT is_dir THEN 'change' END AS op, CASE WHEN event = 'moved' AND NOT seen THEN dest ELSE path END AS path FROM o) SELECT event_id, op, path FROM r WHERE op IS NOT NULL""")
def file_operations(spark, d):
    return files.operations(_file_events(table(spark, d, "events"))).select("event_id", "op", "path")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, value) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'view'),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, value) AS sid FROM g) SELECT user_id::VARCHAR AS path, count(*) AS n, arg_max(floor(value), (ts, floor(value)))::BIGINT AS size FROM s GROUP BY user_id, sid""")
def stream_quiet_files(spark, d):
    e = S.event_stream(spark, f"{d}/events.parquet").filter("event_type = 'view'").select("ts", F.col("user_id").cast("string").alias("path"), F.floor("value").alias("size"), F.lit(1.0).alias("mtime"))
    return S.run_to_end(files.quiet_changes(e, "2 hours"), "complete").select("path", "n", "size")


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey % 3 AS attempts, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O')
SELECT id, CASE WHEN id % 3 = 0 THEN 'done' WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'queued' END AS status FROM q WHERE rn <= 40""")
def queue_claims(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("size"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"),
        (F.col("o_custkey") % 3).cast("int").alias("attempts"), F.lit(None).cast("string").alias("worker"))
    held = files.claim(o, "w1", 40)
    results = held.filter("worker = 'w1'").select("id", F.lit("w1").alias("worker"), (F.col("id") % 3 == 0).alias("ok"))
    return files.finish(held, results).join(results.select("id"), "id", "left_semi").select("id", "status")


@query()
def file_topics(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.concat(F.lit("IMG_"), F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.lit(".txt")).alias("name"), F.concat(F.lit("Events/Annual Trip "), F.col("lang")).alias("folder"),
                       F.array("source").alias("headings"), "text", F.array().cast("array<string>").alias("people"))
    return topics.derive_topics(rows, "doc_id")
