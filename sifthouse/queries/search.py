"""Retrieval, fusion and folders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scores, text as T
from ..operators import chunking, facets, folders, folding, fusion, names, postings, quantised, relations, retrieval
from ..plans import page, query_plan
from ..session import run_folder, table
from .registry import TOKENS, query

TERMS = ["the", "thand", "ation"]
PATH = "lang || '/' || source || '/' || doc_id"


def _bm25_sql(terms: list[str], frm: str, key: str, columns: dict[str, float], limit: int, out: str) -> str:
    toks = ", ".join(f"{TOKENS.format(f'coalesce({c}, chr(32))')} AS t{i}" for i, c in enumerate(columns))
    tf = lambda t: " + ".join(f"{w} * len(list_filter(t{i}, lambda x: x = '{t}'))" for i, w in enumerate(columns.values()))
    length = " + ".join(f"len(t{i})" for i in range(len(columns)))
    fs = ", ".join(f"{tf(t)} AS f{j}" for j, t in enumerate(terms))
    ns = ", ".join(f"count(*) FILTER (f{j} > 0) AS n{j}" for j in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - n{j} + 0.5) / (n{j} + 0.5)), 1e-6) * f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for j in range(len(terms)))
    every, some = " AND ".join(f"f{j} > 0" for j in range(len(terms))), " OR ".join(f"f{j} > 0" for j in range(len(terms)))
    return f"""WITH k AS (SELECT {key} AS id, {toks} FROM {frm}), f AS (SELECT id, ({length})::DOUBLE AS dl, {fs} FROM k),
    s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {ns} FROM f), r AS (SELECT id, {score} AS score, ({every}) AS whole FROM f, s WHERE {some}),
    c AS (SELECT count(*) FILTER (whole) AS nf FROM r), o AS (SELECT id, score, whole FROM r, c WHERE whole OR nf < {limit} / 4.0 ORDER BY score DESC, id LIMIT {limit}) {out}"""


@query(_bm25_sql(TERMS, "documents", "doc_id", {"text": 1.0}, 50, "SELECT id AS doc_id, round(score, 6) AS score FROM o"))
def bm25_and_or_topk(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), TERMS, "doc_id", {"text": 1.0}, 50).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(["the", "of"], "documents", "doc_id", {"text": 1.0, "source": 0.4}, 40, "SELECT id AS doc_id, round(score, 6) AS score FROM o"))
def bm25_heading_weighted(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), ["the", "of"], "doc_id", {"text": 1.0, "source": 0.4}, 40).select("doc_id", F.round("score", 6).alias("score"))


def _index(spark, d, columns):
    path = f"{run_folder(spark)}/postings-{uuid.uuid4().hex}"
    postings.append(table(spark, d, "documents"), path, "doc_id", columns)
    return postings.Index(spark, path, columns)


@query(_bm25_sql(TERMS, "documents", "doc_id", {"text": 1.0}, 50, "SELECT id AS doc_id, round(score, 6) AS score FROM o"))
def bm25_postings(spark, d):
    return postings.bm25(_index(spark, d, {"text": 1.0}), TERMS, "doc_id", 50).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(["the", "of"], "documents", "doc_id", {"text": 1.0, "source": 0.4}, 40, "SELECT id AS doc_id, round(score, 6) AS score FROM o"))
def bm25_postings_weighted(spark, d):
    return postings.bm25(_index(spark, d, {"text": 1.0, "source": 0.4}), ["the", "of"], "doc_id", 40).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT p_partkey, ((contains(lower(p_name), 'ste'))::INT + (contains(lower(p_name), 'red'))::INT + (contains(lower(p_name), 'ing'))::INT) / 3.0 AS score FROM part)
SELECT p_partkey, round(score, 6)::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 50""")
def name_trigram(spark, d):
    return retrieval.name_search(table(spark, d, "part"), ["ste", "red", "ing", "of"], "p_partkey", "p_name").select("p_partkey", F.round("score", 6).alias("score"))


def _names(spark, d):
    path = f"{run_folder(spark)}/names-{uuid.uuid4().hex}"
    names.build(table(spark, d, "part"), path, "p_partkey", "p_name")
    return names.NameIndex(spark, path)


@query("""WITH s AS (SELECT p_partkey, ((contains(lower(p_name), 'ste'))::INT + (contains(lower(p_name), 'red'))::INT + (contains(lower(p_name), 'ing'))::INT) / 3.0 AS score FROM part)
SELECT p_partkey, round(score, 6)::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 50""")
def name_trigram_index(spark, d):
    return _names(spark, d).search(["ste", "red", "ing", "of"]).select(F.col("key").alias("p_partkey"), F.round("score", 6).alias("score"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ste%'")
def name_contains(spark, d):
    return _names(spark, d).containing("STE").select(F.col("key").alias("p_partkey"))


@query("SELECT p_partkey, lower(p_name) AS name FROM part WHERE lower(p_name) LIKE 'small s%'")
def name_prefix(spark, d):
    return _names(spark, d).starting("Small S").select(F.col("key").alias("p_partkey"), "name")


@query()
def quantised_neighbours(spark, d):
    rows = table(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    path = f"{run_folder(spark)}/codes-{uuid.uuid4().hex}"
    book = quantised.fit(rows, rows.count())
    quantised.build(rows, path, book)
    return quantised.search(rows.filter("id % 100 = 0").toDF("query_id", "q"), rows, path, book)


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ', ' of the ')")
def phrase_filter(spark, d):
    return retrieval.contains_phrase(table(spark, d, "documents"), "doc_id", "text", "of the")


@query(f"SELECT doc_id, round(0.85 * ((contains(lower(text), 'thand'))::INT + (contains(lower(text), 'lich'))::INT) / 2.0, 4)::DOUBLE AS score FROM documents WHERE contains(lower(text), 'thand') OR contains(lower(text), 'lich')")
def like_prefix_search(spark, d):
    c = T.coverage(["thand", "lich"], F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.round(c * 0.85, 4).alias("score")).filter("score > 0")


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _query_vector(spark, d, i=3):
    return table(spark, d, "embeddings").filter(F.col("vec_id") == i).select(F.col("embedding").alias("q"))


@query(f"WITH s AS (SELECT e.vec_id, {_DOT.format(a='e.embedding', b='q.embedding')} AS x FROM embeddings e, embeddings q WHERE q.vec_id = 3 ORDER BY x DESC, e.vec_id LIMIT 20) SELECT vec_id, round(x, 6) AS score FROM s")
def dense_topk(spark, d):
    rows = table(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d)))
    return retrieval.dense_topk(rows, F.col("q"), "vec_id", "embedding", 20).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH s AS (SELECT e.vec_id, {_DOT.format(a='e.embedding', b='q.embedding')} AS x FROM embeddings e, embeddings q WHERE q.vec_id = 3 AND e.label IN (1, 2, 5) AND x >= 0.05 ORDER BY x DESC, e.vec_id LIMIT 20) SELECT vec_id, round(x, 6) AS score FROM s")
def dense_topk_filtered(spark, d):
    rows = table(spark, d, "embeddings").filter(F.col("label").isin(1, 2, 5)).crossJoin(F.broadcast(_query_vector(spark, d)))
    return retrieval.dense_topk(rows, F.col("q"), "vec_id", "embedding", 20, floor=0.05).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DOT.format(a='e.embedding', b='q.embedding')} AS x FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS rank FROM s) SELECT query_id, id, round(x, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def dense_batch_queries(spark, d):
    e = table(spark, d, "embeddings")
    got = retrieval.dense_topk_batch(e.filter("vec_id % 100 = 0").select("vec_id", "embedding"), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 5)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH q AS (SELECT list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE + 0.6 * z[2]::DOUBLE) AS v FROM embeddings a, embeddings b WHERE a.vec_id = 1 AND b.vec_id = 2),
n AS (SELECT v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM q),
s AS (SELECT e.vec_id, {_DOT.format(a='e.embedding', b='n.v')} / n.len AS x FROM embeddings e, n ORDER BY x DESC, e.vec_id LIMIT 15) SELECT vec_id, round(x, 6) AS score FROM s""")
def compose_topk(spark, d):
    e = table(spark, d, "embeddings")
    a, b = (e.filter(F.col("vec_id") == i).select(F.col("embedding").alias(n)) for i, n in ((1, "a"), (2, "b")))
    mixed = a.crossJoin(b).select(F.zip_with(scores.doubles(F.col("a")), scores.doubles(F.col("b")), lambda x, y: x + 0.6 * y).alias("m"))
    q = mixed.select(F.transform("m", lambda x: x / scores.norm(F.col("m"))).alias("q"))
    return retrieval.dense_topk(e.crossJoin(F.broadcast(q)), F.col("q"), "vec_id", "embedding", 15).select("vec_id", F.round("score", 6).alias("score"))


_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"


@query(f"""WITH h AS (SELECT doc_id, {_HASH.format('text')} AS h FROM documents), q AS (SELECT h FROM h WHERE doc_id = 0)
SELECT doc_id, bit_count(xor(h.h, q.h))::INT AS distance, round(1 - bit_count(xor(h.h, q.h)) / 32.0, 6)::DOUBLE AS relevance FROM h, q WHERE bit_count(xor(h.h, q.h)) <= 20 ORDER BY distance, doc_id LIMIT 50""")
def hamming_dupes(spark, d):
    h = table(spark, d, "documents").select("doc_id", folding.hash_column(F.col("text")).alias("h"))
    q = h.filter("doc_id = 0").select(F.col("h").alias("q"))
    got = retrieval.hash_search(h.crossJoin(F.broadcast(q)), F.col("q"), "doc_id", "h", most=20)
    return got.select("doc_id", "distance", F.round(scores.calibrated(F.lit("dupe"), F.col("distance")), 6).alias("relevance"))


_PART_HASH = f"h AS (SELECT min(p_partkey) AS k, h FROM (SELECT p_partkey, {_HASH.format('p_brand || p_size')} AS h FROM part) GROUP BY h)"


def _part_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", folding.hash_column(F.concat(F.col("p_brand"), F.col("p_size").cast("string"))).alias("h"))


@query(f"WITH {_PART_HASH} SELECT a.k AS a, b.k AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.k < b.k AND bit_count(xor(a.h, b.h)) <= 14")
def hamming_pairs(spark, d):
    return retrieval.hash_pairs(_part_hashes(spark, d), "p_partkey", "h", 14, bits=60)


@query("SELECT p_partkey, head FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand || p_size) AS head FROM part) WHERE p_partkey <> head")
def hamming_members(spark, d):
    return retrieval.folded_hashes(_part_hashes(spark, d), "p_partkey", "h")


@query(f"""WITH f AS (SELECT lang || '/' || source AS folder, n_chars FROM documents), a AS (SELECT folder, n_chars FROM f UNION ALL SELECT split_part(folder, '/', 1), n_chars FROM f)
SELECT folder, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM a GROUP BY 1""")
def folder_rollup(spark, d):
    rows = table(spark, d, "documents")
    return facets.folder_rollup(rows, F.concat_ws("/", "lang", "source"), F.col("n_chars"))


@query("SELECT doc_id FROM documents WHERE lang || '/' || source = 'en/src1' OR starts_with(lang || '/' || source, 'de/') OR lang || '/' || source = 'de'")
def folder_scope_members(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("folder"))
    return relations.under_scopes(rows, "folder", ["en/src1", "de"]).select("doc_id")


_FOLDER_WEIGHT = "CASE WHEN f / t::DOUBLE > 0.9 THEN 0 ELSE ln(1 + t::DOUBLE / f) END"


@query(f"""WITH t AS (SELECT count(*) AS t FROM documents), w AS (SELECT ({_FOLDER_WEIGHT.replace('f /', 'count(*) /').replace('/ f)', '/ count(*))')}) AS de FROM documents, t WHERE lang = 'de' GROUP BY t),
x AS (SELECT ({_FOLDER_WEIGHT.replace('f /', 'count(*) /').replace('/ f)', '/ count(*))')}) AS three FROM documents, t WHERE source = 'src3' GROUP BY t)
SELECT 'de/src3' AS path, count(*) AS files, 1.0::DOUBLE AS score, 'de src 3' AS matched FROM documents, w, x WHERE lang = 'de' AND source = 'src3' AND de + three > 0 GROUP BY ALL HAVING count(*) > 0""")
def folder_match(spark, d):
    s = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("folder"), F.lit("indexed").alias("status"))
    got = folders.match_folders(s, "the de src3 notes")
    return got.select("path", "files", F.round("score", 6).alias("score"), F.array_join("matched", " ").alias("matched"))


@query("SELECT 'en/src1' AS path, count(*) AS files FROM documents WHERE lang = 'en' AND source = 'src1' HAVING count(*) > 0")
def folder_typed(spark, d):
    s = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("folder"), F.lit("indexed").alias("status"))
    return folders.match_folders(s, 'reports in "EN / src1"').select("path", "files")


@query("SELECT doc_id AS source_id, 0.5::DOUBLE AS score FROM documents WHERE lang = 'de' AND source <> 'src2' UNION ALL SELECT doc_id, 0.75 FROM documents WHERE source = 'src2' AND lang IN ('de', 'fr')")
def folder_members(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.concat_ws("/", "lang", "source").alias("folder"), F.lit("indexed").alias("status"))
    scopes = spark.createDataFrame([("de", 0.5), ("de/src2", 0.75), ("fr/src2", 0.75)], "path string, score double")
    return folders.scope_members(s, scopes)


_HITS = """h AS (SELECT 'bm25' AS retriever, doc_id AS file, (n_chars % 97)::DOUBLE AS score FROM documents UNION ALL SELECT 'bm25', doc_id, (n_chars % 31)::DOUBLE FROM documents
UNION ALL SELECT 'name', doc_id, (doc_id * 7919 % 1013)::DOUBLE FROM documents UNION ALL SELECT 'folder', doc_id, CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.5 ELSE 0.25 END::DOUBLE FROM documents)"""


def _hits(spark, d):
    """Three lists of all documents with scores, as retrievers give them; the first has two hits of each."""
    docs = table(spark, d, "documents")
    part = lambda name, score: docs.select(F.lit(name).alias("retriever"), F.col("doc_id").alias("file"), score.cast("double").alias("score"))
    folder = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.5).otherwise(0.25)
    return part("bm25", F.col("n_chars") % 97).union(part("bm25", F.col("n_chars") % 31)).union(part("name", F.col("doc_id") * 7919 % 1013)).union(part("folder", folder))


@query(f"WITH {_HITS} SELECT retriever, file, max(score) AS score FROM h GROUP BY 1, 2")
def merge_max(spark, d):
    return fusion.merge_max(_hits(spark, d), ["retriever", "file"])


_FUSED = _HITS + """, m AS (SELECT retriever, file, max(score) AS score FROM h GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY retriever ORDER BY score DESC, file) AS place FROM m),
t AS (SELECT retriever, file, score, CASE WHEN retriever = 'folder' THEN dense_rank() OVER (PARTITION BY retriever ORDER BY score DESC) ELSE place END - 1 AS rank FROM p WHERE place <= CASE WHEN retriever = 'folder' THEN 5000 ELSE 200 END),
f AS (SELECT file, sum(CASE retriever WHEN 'bm25' THEN 1.0 WHEN 'name' THEN 0.7 ELSE 1.2 END::DOUBLE / (61 + rank)) AS fused, count(*) AS n_lists FROM t GROUP BY 1)"""


def _ranks(spark, d):
    h = _hits(spark, d)
    return fusion.file_ranks(h.filter("retriever <> 'folder'")).unionByName(fusion.file_ranks(h.filter("retriever = 'folder'"), tied=True))


@query(f"WITH {_FUSED} SELECT file, round(fused, 9) AS fused, n_lists FROM f")
def rrf_fusion(spark, d):
    return fusion.rrf(_ranks(spark, d)).select("file", F.round("fused", 9).alias("fused"), "n_lists")


@query(f"WITH {_FUSED} SELECT file, rank::INT AS rank FROM t WHERE retriever = 'folder'")
def rrf_tied(spark, d):
    return fusion.file_ranks(_hits(spark, d).filter("retriever = 'folder'"), tied=True).select("file", "rank")


@query(f"""WITH {_FUSED}, t2 AS (SELECT max(fused) AS top FROM f), s AS (SELECT file, 0.25 + 0.4 * fused / top AS score FROM f, t2), b AS (SELECT max(score) AS best FROM s)
SELECT file, round(score, 4) AS score FROM s, b WHERE score >= greatest(0.2, round(best - 0.3, 4))""")
def relevance_score(spark, d):
    f = fusion.rrf(_ranks(spark, d))
    scored = f.crossJoin(F.broadcast(f.agg(F.max("fused").alias("top")))).select("file", fusion.relevance(F.lit(None).cast("double"), F.lit(0.0), F.col("fused") / F.col("top")).alias("score"))
    return fusion.relative_cut(scored, 0.3, 0.2).select("file", F.round("score", 4).alias("score"))


@query("""SELECT vec_id, round(CASE WHEN x <= 0.3 THEN 0 WHEN x <= 0.4 THEN (x - 0.3) / (0.4 - 0.3) * 0.2 WHEN x < 0.7 THEN 0.2 + (x - 0.4) / (0.7 - 0.4) * 0.75 ELSE 0.95 END, 5)::DOUBLE AS relevance
FROM (SELECT vec_id, abs(embedding[1]::DOUBLE) * 3 AS x FROM embeddings)""")
def calibration(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(scores.calibrated(F.lit("dense"), F.abs(F.col("embedding")[0].cast("double")) * 3), 5).alias("relevance"))


@query("SELECT doc_id, score FROM (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents) WHERE score >= greatest(0.2, (SELECT round(max((n_chars % 1000) / 1000.0::DOUBLE) - 0.05, 4) FROM documents))")
def relative_cut(spark, d):
    return fusion.relative_cut(table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("score")), 0.05, 0.2)


@query("SELECT doc_id, lang, score FROM (SELECT doc_id, lang, (n_chars % 997) / 1000.0::DOUBLE AS score, max((n_chars % 997) / 1000.0::DOUBLE) OVER (PARTITION BY lang) AS top FROM documents) WHERE score >= greatest(0.2, round(top - 0.3, 4))")
def bucket_cut(spark, d):
    return fusion.relative_cut(table(spark, d, "documents").select("doc_id", "lang", ((F.col("n_chars") % 997) / 1000.0).alias("score")), 0.3, 0.2, ["lang"])


@query(f"WITH s AS (SELECT e.vec_id, e.label, {_DOT.format(a='e.embedding', b='q.embedding')} AS x FROM embeddings e, embeddings q WHERE q.vec_id = 3) SELECT label, round(max(x), 6) AS best FROM s GROUP BY 1 HAVING max(x) >= 0.42")
def face_gate(spark, d):
    rows = table(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d)))
    return rows.groupBy("label").agg(F.max(scores.dot(F.col("embedding"), F.col("q"))).alias("best")).filter(F.col("best") >= scores.FACE_MATCH).select("label", F.round("best", 6).alias("best"))


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS w FROM documents), q AS (SELECT item_id, list_distinct({TOKENS.format('text')}) AS qw FROM benchmark),
u AS (SELECT item_id, len(qw) AS n, unnest(qw) AS w FROM q), s AS (SELECT item_id, doc_id, count(*) / min(n)::DOUBLE AS score FROM u JOIN t USING (w) GROUP BY 1, 2) SELECT item_id, doc_id, round(score, 6) AS score FROM s WHERE score >= 0.5""")
def rerank_overlap(spark, d):
    got = retrieval.word_shares(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text", 0.5)
    return got.select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT user_id AS file, event_type AS retriever, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS depth FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY depth, list_position(['view', 'click', 'purchase', 'signup', 'error', 'refund'], retriever), event_id) AS place FROM r WHERE depth <= 3) SELECT file, event_id, place::INT AS place FROM p WHERE place <= 3""")
def passage_interleave(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("retriever"), F.col("event_id").alias("entity"), F.col("value").alias("score"))
    return fusion.passages(e, ["view", "click", "purchase", "signup", "error", "refund"]).select("file", F.col("entity").alias("event_id"), "place")


_SOURCES = """s AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 50 = 7 THEN 'missing' ELSE 'indexed' END AS status, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' ELSE 'jpg' END AS ext,
CASE WHEN doc_id % 3 = 2 THEN 'image' ELSE 'document' END AS kind, lang AS library_id, 'Data/' || source AS folder, DATE '2019-01-01' + (doc_id % 2000)::INT AS day FROM documents)"""


def _sources(spark, d):
    """Every document as a file of a library."""
    doc = F.col("doc_id")
    ext = F.when(doc % 3 == 0, "pdf").when(doc % 3 == 1, "txt").otherwise("jpg")
    folder = F.concat(F.lit("Data/"), F.col("source"))
    day = F.date_add(F.lit("2019-01-01").cast("date"), (doc % 2000).cast("int"))
    return table(spark, d, "documents").select(
        doc.alias("source_id"), F.when(doc % 50 == 7, "missing").otherwise("indexed").alias("status"), ext.alias("ext"), T.kind_of(ext).alias("kind"), F.col("lang").alias("library_id"),
        folder.alias("folder"), F.concat(folder, F.lit("/"), doc.cast("string"), F.lit("."), ext).alias("rel_path"), F.when(doc % 2 == 0, day.cast("timestamp")).alias("taken_at"),
        F.unix_timestamp(day.cast("timestamp")).cast("double").alias("mtime"))


@query(f"""WITH {_SOURCES} SELECT source_id AS doc_id FROM s WHERE status = 'indexed' AND library_id IN ('en', 'de') AND kind = 'document' AND ext IN ('pdf', 'jpg') AND folder = 'Data/src1'
AND day >= '2020-03-01' AND day < '2022-01-01' AND source_id % 11 <> 0""")
def allowed_sources(spark, d):
    rows = _sources(spark, d)
    libraries = spark.createDataFrame([("en", "English", True), ("de", "German", True), ("fr", "French", False)], "library_id string, name string, online boolean")
    plan = query_plan.parse_query('kind:docs ext:.PDF,jpg in:english library:"de" folder:data/src1 after:2020-03 before:2022 words')
    return query_plan.allowed_sources(rows, plan.filters, rows.filter("source_id % 11 = 0"), libraries).select(F.col("source_id").alias("doc_id"))


@query(f"WITH {_SOURCES} SELECT source_id AS doc_id FROM s WHERE status = 'indexed' AND day >= '2021-01-01' AND day < '2022-01-01' AND folder = 'Data/src2'")
def allowed_year(spark, d):
    return query_plan.allowed_sources(_sources(spark, d), query_plan.parse_query("year:2021 folder:SRC2").filters).select(F.col("source_id").alias("doc_id"))


@query(f"WITH {_SOURCES}, b AS (SELECT *, folder || '/' || source_id || '.' || ext AS p FROM s WHERE status = 'indexed' AND kind = 'image') SELECT source_id AS file, 1.0::DOUBLE AS score FROM b ORDER BY p LIMIT 5000")
def browse_filter(spark, d):
    plan = query_plan.parse_query("kind:photos")
    allowed = query_plan.allowed_sources(_sources(spark, d), plan.filters)
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("chunk_id"), "text")
    return query_plan.candidate_lists(chunks, allowed, plan).select("file", "score")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE n_chars + 1 END AS score FROM documents")
def union_precedence(spark, d):
    docs = table(spark, d, "documents")
    new = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return fusion.with_precedence(new, docs.select(F.col("doc_id").alias("id"), (F.col("n_chars") + 1).alias("score")), "id")


@query("""WITH h AS (SELECT 'dense' AS retriever, conv_id * 1000 + turn AS entity, (length(text) % 89)::DOUBLE AS score, role FROM conversations
UNION ALL SELECT 'bm25', conv_id * 1000 + turn, (length(text) % 71)::DOUBLE, role FROM conversations UNION ALL SELECT 'name', conv_id * 1000 + turn, 99.0, role FROM conversations)
SELECT entity, max(score) AS score FROM h WHERE retriever IN ('dense', 'bm25') AND role = 'user' GROUP BY 1""")
def transcript_split(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("entity"), F.length("text").alias("n"), "role")
    part = lambda name, score: c.select(F.lit(name).alias("retriever"), "entity", score.cast("double").alias("score"))
    hits = part("dense", F.col("n") % 89).union(part("bm25", F.col("n") % 71)).union(part("name", F.lit(99.0)))
    return fusion.transcript_list(hits, c.filter("role = 'user'").select("entity")).select("entity", "score")


@query()
def burst_collapse(spark, d):
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), folding.hash_column(F.col("text")).alias("hash"), (F.col("n_chars") % 100).alias("relevance"))
    return folding.collapse_bursts(rows, "source", most=14, bits=60)


@query()
def focus_windows(spark, d):
    return chunking.snippets(table(spark, d, "documents"), "doc_id", "text", {"the", "thand"})


def _library(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 7 == 0, "transcript").otherwise("text").alias("kind"), "text", F.col("source").alias("heading"))
    vectors = table(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    return page.Tables(_sources(spark, d), chunks, vectors), vectors


def flagship(spark, sf_dir):
    """A search with words, a phrase and filters over all documents: keyword, name and vector lists, fused, judged by their passages, scored, and cut to a page."""
    tables, vectors = _library(spark, sf_dir)
    one = vectors.orderBy("chunk_id").first()
    return page.search(tables, 'onor thanea "of the" kind:document after:2019', page.Signals(text=list(one["v"]) if one else None))


@query()
def search_page(spark, d):
    return flagship(spark, d)
