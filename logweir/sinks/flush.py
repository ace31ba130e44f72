"""Flush: a batch of events to Parquet by service and hour, then one catalog transaction."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.catalog import Catalog, FileMeta
from logweir.functions.scalar import time_bucket
from logweir.schema import COLUMNS, LOG_SCHEMA


def written_files(spark, folder: str, service_of=None) -> list[FileMeta]:
    """Statistics of the Parquet files below a folder, one row a file, from column statistics' columns only."""
    df = spark.read.schema(LOG_SCHEMA).parquet(folder)
    bucket = time_bucket(F.min("timestamp"))
    rows = df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(
        F.min("service").alias("service"),
        bucket.alias("bucket"),
        F.min("timestamp").alias("lo"),
        F.max("timestamp").alias("hi"),
        F.count("*").alias("n"),
        F.min("kafka_offset").alias("first"),
        F.max("kafka_offset").alias("last"),
    )
    return [FileMeta(r["path"], r["service"], r["bucket"], r["lo"], r["hi"], r["size"], r["n"], r["first"], r["last"]) for r in rows.toLocalIterator()]


def write_events(df: DataFrame, folder: str) -> None:
    """Write by (service, hour). The rebalance hint lets AQE split a hot service and merge small ones."""
    keyed = df.select(*COLUMNS).withColumns({"_service": F.col("service"), "_bucket": time_bucket(F.col("timestamp"))})
    keyed.hint("rebalance", "_service", "_bucket").sortWithinPartitions("_service", "_bucket", "timestamp").write.partitionBy("_service", "_bucket").mode("overwrite").parquet(folder)


def flush_events(df: DataFrame, data_dir: str, catalog: Catalog, batch: tuple[str, int] | None = None, metrics=None) -> list[int]:
    """Durably write a batch and register its files; returns catalog ids.

    An empty batch writes no file. A batch already in the catalog, by
    (stream, number), is left alone: a retried micro-batch adds nothing twice.
    Files are visible only once the transaction has committed.
    """
    if batch and catalog.has_batch(*batch):
        return []
    name = f"{batch[0]}-{batch[1]:012d}" if batch else uuid.uuid4().hex
    folder = f"{data_dir.rstrip('/')}/{name}"
    write_events(df, folder)
    files = written_files(df.sparkSession, folder)
    ids = catalog.commit_flush(*files, batch=batch)
    if metrics and ids:
        for f in files:
            metrics.add("events_ingested_total", f.record_count, service=f.service)
    return ids
