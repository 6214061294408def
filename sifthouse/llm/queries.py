"""The registered queries of this subpackage, with oracle SQL where SQL can express them on whole tables.

No operator here has one: shingle joins, window removal and models are too slow or not
expressible in SQL over whole tables, so each is tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import run_folder, table
from . import bpe, centroids, decontaminate, jaccard, language_id, licenses, neighbours, periods, pii, quality, repeats, token_files, toxicity

BYTE_VOCABULARY, WORD_VOCABULARY, WORD_END = "byte_bpe_50k.json", "word_bpe_49k.json", 2


def _fold(column: str, parts: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels.filter(_fold("doc_id", 3) != 1))
    return toxicity.score(docs.select("doc_id", "text"), net).select("doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{run_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, WORD_VOCABULARY, WORD_END)
    return token_files.token_digests(spark, path)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(_fold("doc_id", 4) != 2))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.filter(F.pmod("vec_id", F.lit(20)) == 0))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", F.size("licenses").alias("n_licenses"), "licenses")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(_fold("doc_id", 4) != 2))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def _repeating(doc_id: Column, text: Column) -> Column:
    """The text, of which a tenth of the documents repeat a part: words from number a on are the first p words from there, again and again."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        line = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(line, " ")).otherwise(text)

    # the words are a variable of the function, so they are found once
    return F.when(h % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("runs")
    best = F.when(F.size(runs) > 0, F.aggregate(runs, runs[0], lambda one, r: F.when(r["length"] * one["period"] > one["length"] * r["period"], r).otherwise(one)))
    line = F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = periods.find_runs(docs).select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_ngram_jaccard_join, op3_token_files, op4_substring_dedup, op5_decontamination,
    op6_language_id, op7_pii_surrogates, op8_nearest_neighbours, op9_bpe_round_trip, op10_license_scan,
    op11_quality_classifier, op12_periodic_runs, op13_centroid_clustering)}

ORACLE_SQL: dict[str, str] = {}
