"""Token ids in ORC files: run-length encoded integers, row indexes, and Bloom filters on document ids.

Documents are dealt out by ranges of ``doc_id`` and encoded in that order, so every stripe and
row group covers a narrow range of ids: a reader takes stripes in parallel, and a look-up by
``doc_id`` is answered from stripe statistics and Bloom filters without reading other stripes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from .bpe import _worker_encoder
from .shared import buffers, chunks, text_column

COLUMNS = "doc_id long, block int, at long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, stripe_bytes: int = 8 << 20, stride: int = 2_000) -> None:
    """Encode every whole text, append ``end_id``, and write ids in ascending ``doc_id`` order as ORC under ``path``.

    ``block`` numbers the ranges of documents and ``at`` counts the ids before a document in its
    block. Null texts hold the end id alone; null document ids come first; rows that repeat an id,
    or lack one, follow each other in the order of a hash of their texts, which also deals them
    out where they are many.
    """
    order = F.asc_nulls_first("doc_id"), F.xxhash64("text")
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_batch = _worker_encoder(vocabulary, False, True, None)
        block, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets):
                ids, first = encode_batch(data, offsets[start : stop + 1])
                counts = np.diff(first) + 1
                whole = np.insert(ids, first[1:], end_id)
                edges = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(np.full(stop - start, block), pa.int32()), pa.array(at + edges[:-1], pa.int64()),
                     pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(whole, pa.int32()))],
                    ["doc_id", "block", "at", "n_tokens", "ids"])
                at += int(edges[-1])

    (ranged.mapInArrow(run, COLUMNS).write.mode("overwrite").format("orc")
     .option("orc.compress", "ZLIB").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", stride)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).save(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).orc(path)


def find_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document's ids; the filter reaches the stripe statistics and Bloom filters of the files."""
    return read_tokens(spark, path).filter(F.col("doc_id") == F.lit(doc_id))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32`` of each document.

    ``start`` adds the block's offset in the file to the ids of all blocks before; only one
    narrow row for each block is summed in order.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(counts)])
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("block"), batch.column("at"), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "block", "at", "n_tokens", "ids_crc32"])

    stored = read_tokens(spark, path)
    blocks = stored.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = blocks.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("before"))
    return (
        stored.select("doc_id", "block", "at", "ids").mapInArrow(run, "doc_id long, block int, at long, n_tokens long, ids_crc32 long")
        .join(before, "block").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )
