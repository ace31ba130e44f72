"""Deduplication by (kafka_partition, kafka_offset), at query time and in compaction."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("kafka_partition", "kafka_offset")
#: The earliest replica stays; the other columns only make ties repeatable.
ORDER = ("timestamp", "level", "service", "message", "attributes")


def dedup(df: DataFrame) -> DataFrame:
    """One row per key, the one with the least timestamp. Plans as a two-phase WindowGroupLimit."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*ORDER))
    return df.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def logs_view(raw: DataFrame, upper_ns: int | None = None, inclusive: bool = True) -> DataFrame:
    """The ``logs`` relation over raw rows.

    ``upper_ns`` may be pushed below the window: a key's minimum meets an upper
    bound, or no replica of it does. A lower bound or a predicate on other
    columns may not, as another replica could take the minimum's place.
    """
    if upper_ns is not None:
        raw = raw.filter(F.col("timestamp") <= upper_ns if inclusive else F.col("timestamp") < upper_ns)
    return dedup(raw)


def sorted_by_time(df: DataFrame, partitions: int) -> DataFrame:
    """Globally ordered by timestamp over ``partitions`` ranges (H1)."""
    if partitions <= 1:
        return df.coalesce(1).sortWithinPartitions(*ORDER)
    return df.repartitionByRange(partitions, "timestamp").sortWithinPartitions(*ORDER)
