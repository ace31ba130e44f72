"""Aggregations over files, buckets and metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.scalar import duplicate_density, time_bucket


def file_rollup(logs: DataFrame, keys=("service", "time_bucket")) -> DataFrame:
    """Per-file statistics (F4): counts and closed ranges of time and offset."""
    if "time_bucket" in keys and "time_bucket" not in logs.columns:
        logs = logs.withColumn("time_bucket", time_bucket(F.col("timestamp")))
    return logs.groupBy(*keys).agg(
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
        F.count("*").alias("record_count"),
        F.min("kafka_offset").alias("min_kafka_offset"),
        F.max("kafka_offset").alias("max_kafka_offset"),
    )


def bucket_stats(files: DataFrame, *keys: str) -> DataFrame:
    """File count, rows, offset span and duplicate density of each bucket of files."""
    keys = keys or ("service", "time_bucket")
    span = F.max("max_kafka_offset") - F.min("min_kafka_offset") + 1
    return (
        files.groupBy(*keys)
        .agg(F.count("*").alias("file_count"), F.sum("record_count").alias("total_records"), span.alias("offset_span"))
        .withColumn("density", duplicate_density(F.col("total_records"), F.col("offset_span")))
    )


def due_buckets(stats: DataFrame, small_file_threshold: int, max_duplicate_ratio: float) -> DataFrame:
    """Buckets that the threshold trigger compacts."""
    return stats.filter((F.col("file_count") >= small_file_threshold) | (F.col("density") >= max_duplicate_ratio))


def overlapping(files: DataFrame, time_from: int, time_to: int) -> DataFrame:
    """Files whose closed time range meets the window."""
    return files.filter(~((F.col("max_ts") < time_from) | (F.col("min_ts") > time_to)))


def scan_stats(files: DataFrame, time_from: int, time_to: int) -> DataFrame:
    """rows_scanned, bytes_scanned, files_pruned of a window."""
    kept = ~((F.col("max_ts") < time_from) | (F.col("min_ts") > time_to))
    return files.agg(
        F.coalesce(F.sum(F.when(kept, F.col("record_count"))), F.lit(0)).alias("rows_scanned"),
        F.coalesce(F.sum(F.when(kept, F.col("size_bytes"))), F.lit(0)).alias("bytes_scanned"),
        F.count_if(~kept).alias("files_pruned"),
    )


def rate_per_second(df: DataFrame, ts: str, by: str, width: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Events a second, per series and window (F8)."""
    win = F.window(F.col(ts).cast("timestamp"), width)
    counted = df.groupBy(by, win.alias("_w")).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("_w.start").alias("window_start"), "n", (F.col("n") / seconds).alias("rate"))


def quantiles(df: DataFrame, value: str, by: str, probs=(0.5, 0.99)) -> DataFrame:
    """Exact interpolated quantiles per series."""
    return df.groupBy(by).agg(*[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in probs])


def hit_ratio(df: DataFrame, hit, by: str) -> DataFrame:
    """hits / (hits + misses) per series."""
    return df.groupBy(by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")).withColumn("ratio", F.col("hits") / (F.col("hits") + F.col("misses")))
