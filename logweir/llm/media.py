"""Media columns: texts as AVI motion-JPEG, read back, with timed clip rows (operator 4).

A null or empty text is 64 zero bytes. Equal texts give equal media. Repeated
rows stay; an empty table gives an empty result; other columns are not kept.
A row needs nothing of any other row, so there is no shuffle.
"""

import hashlib
import zlib

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.avi import avi_to_payload, payload_to_avi, shots
from logweir.llm.common import small_batches
from logweir.llm.tokens import slices

CLIP = "struct<clip: int, first_frame: int, last_frame: int, start_ms: long, end_ms: long>"
FACTS = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<{CLIP}>"


def _each(df: DataFrame, work, schema: str, most: int) -> DataFrame:
    """Rows through ``work(columns of a slice) -> columns``, a few MB at a time."""

    def run(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
            for a, b in slices(sizes, most):
                part = batch.slice(a, b - a)
                yield work(part)

    return small_batches(df).mapInArrow(run, schema)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of ``docs`` (doc_id, text)."""

    def work(batch):
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        media = [payload_to_avi(x + b"\x00" * (-len(x) % 64 or (0 if x else 64))) for x in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _each(rows, work, "doc_id long, n_bytes long, media binary", 2_000_000)


def analyse_media(media: DataFrame) -> DataFrame:
    """FACTS of ``media`` (doc_id, n_bytes, media): the payload read back, and its clips."""

    def facts(data):
        payload, film, frames = avi_to_payload(data)
        ms = film["micros"] / 1000
        clips = [{"clip": i, "first_frame": a, "last_frame": b, "start_ms": round(a * ms), "end_ms": round((b + 1) * ms)} for i, (a, b) in enumerate(shots(frames))]
        feature = f"avi/mjpeg {film['width']}x{film['height']} frames={len(frames)} shots={len(clips)} clips=" + ",".join(f"{c['start_ms']}-{c['end_ms']}" for c in clips)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, clips

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), None]
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]

    def work(batch):
        rows = [facts(x) for x in batch.column(2).to_pylist()]
        cols = [pa.array(c, k or clip) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "n_bytes", *names])

    return _each(media.select("doc_id", "n_bytes", "media"), work, FACTS, 4_000_000)


def clip_rows(analysed: DataFrame) -> DataFrame:
    """One row per clip: doc_id, clip, first_frame, last_frame, start_ms, end_ms."""
    return analysed.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
