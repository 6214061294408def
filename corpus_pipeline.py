"""A corpus pipeline of five stages: toxic documents go, near copies go, contaminated documents go, personal data is replaced, and the rest is encoded.

Every stage takes null, empty and very long texts, repeated rows, null ids, empty tables and
further columns of any names: rows are judged by their texts, and all but the last stage return
the columns they got with the values of the rows they keep. What is special is said below.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sifthouse.llm import bpe, decontaminate, jaccard, pii, toxicity
from sifthouse.llm.queries import BYTE_VOCABULARY, _fold
from sifthouse.llm.shared import free_prefix
from sifthouse.session import remove_folder, run_folder, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the classifier learns from the fitting fold of ``labels``.

    Texts without words score as such: they stay, unless most of the labelled ones are toxic.
    Where no document is labelled, all stay.
    """
    net = toxicity.train(docs, table(spark, sf_dir, "labels").filter(_fold("doc_id", 3) != 1))
    return toxicity.keep_clean(docs, net)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: at least 0.8 of their five-word shingles are shared.

    Texts without words stay, as do rows without an id, which can't be ranked, and all rows of an id that stays.
    """
    return jaccard.keep_one(docs, k=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in a benchmark window; texts without words stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; ``n_chars`` counts the new text. Null texts stay null."""
    out = pii.replace_pii(docs, prefix=free_prefix(docs, "pii_")).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, and digests of the ids and of what they decode to; null texts have no ids."""
    return bpe.round_trip(docs, BYTE_VOCABULARY)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_copies),
    ("benchmark_decontamination", remove_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode_documents),
]

#: SQL expresses neither the classifier nor the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{run_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
