"""Token ids as ORC in ascending document order (operator 1).

Documents are dealt by ranges of doc_id, encoded and written: one ORC file a
range, integers run-length encoded, row indexes on, a Bloom filter on doc_id,
so readers go stripe by stripe and skip stripes by metadata. Files also keep
each document's place in its file; a file's place in the whole comes from the
files' totals, a row a file.

A null or empty text has only its end id. Repeated doc_ids stay separate
documents, ordered by text hash; a null doc_id sorts first. An empty table
gives an empty result. Other columns of the input are not written.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import BATCH_ROWS, shared_folder, small_batches
from logweir.llm.tokens import gathered, tokenizer, vocabulary, with_end

SCHEMA = "doc_id long, file_no int, file_start long, n_tokens long, ids array<int>"


def write_token_ids(docs: DataFrame, folder: str, vocab: str | None = None, end_id: int | None = 2, bloom_fpp: float = 0.01, stripe_bytes: int = 64 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files below ``folder``."""
    path = vocab or vocabulary()

    def encode(batches):
        tok, place, number = tokenizer(path), 0, TaskContext.get().partitionId()
        for batch in gathered(batches):
            ids, offsets = with_end(*tok.encode_column(batch.column(1)), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            starts = place + offsets[:-1]
            place += int(offsets[-1])
            cols = [batch.column(0), pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(starts), pa.array(np.diff(offsets)), lists]
            for a in range(0, batch.num_rows, BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(a, BATCH_ROWS) for c in cols], ["doc_id", "file_no", "file_start", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(bloom_fpp), "orc.create.index": "true", "orc.stripe.size": str(stripe_bytes), "compression": "zstd"}
    small_batches(dealt).mapInArrow(encode, SCHEMA).write.options(**options).orc(folder)


def read_token_ids(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the whole output; ``start`` counts the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Two numbers a file: a million files are 16 MB.
    places = F.broadcast(totals.select("file_no", before.alias("_before")))
    return rows.join(places, "file_no").select("doc_id", (F.col("_before") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def ids_digest(rows: DataFrame, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` columns with n_ids and ids_crc32, unsigned, of the ids as little-endian unsigned 32-bit integers."""
    kinds = rows.select(*keep).schema

    def digest(batches):
        for batch in batches:
            lists = batch.column(len(keep))
            values = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            at = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at, at[1:])]
            cols = [*(batch.column(i) for i in range(len(keep))), pa.array(crc, pa.int64()), pa.array(np.diff(at) // 4, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "ids_crc32", "n_ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return small_batches(rows.select(*keep, ids)).mapInArrow(digest, f"{fields}, ids_crc32 long, n_ids long")


def token_output(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write and read back: doc_id, start, n_tokens, ids."""
    folder = folder or shared_folder(docs.sparkSession, "token-ids")
    write_token_ids(docs, folder, **options)
    return read_token_ids(docs.sparkSession, folder)
