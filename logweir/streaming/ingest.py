"""Streaming ingest: any source of JSON payloads to catalogued Parquet, once per micro-batch.

Offsets live in the checkpoint and are committed after the batch's files and
its catalog transaction, so an event is durable before it counts as read.
A retried batch has the same number and is skipped by the catalog.
"""

import json
import time
from contextlib import nullcontext

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from logweir.catalog import Catalog
from logweir.schema import PAYLOAD_DDL, decode_payload, split_rejects
from logweir.sinks.flush import flush_events
from logweir.streaming.batching import BatchConfig

HIGH_WATER, LOW_WATER = 0.8, 0.4


def file_payloads(spark, folder: str, max_files: int = 1000, max_bytes: str | None = None) -> DataFrame:
    """Lines of text files as payloads; caps per trigger bound a micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if not max_bytes else spark.readStream.option("maxBytesPerTrigger", max_bytes)
    return reader.text(folder)


def start_ingest(payloads: DataFrame, name: str, data_dir: str, catalog: Catalog, checkpoint: str, partition: str | None = None, offset: str | None = None, metrics=None, trigger=None, on_reject=None, permits=None):
    """Start the query; ``trigger`` defaults to one second, the age limit of a batch.

    ``permits``, a semaphore that several queries share, bounds their concurrent flushes.
    """

    def write(batch: DataFrame, number: int) -> None:
        began = time.monotonic()
        known = catalog.has_batch(name, number)
        seen = Observation()
        decoded = decode_payload(batch, "value", partition, offset)
        decoded = decoded.observe(seen, F.count_if(~F.col("valid")).alias("rejects"))
        if on_reject:
            decoded = decoded.persist()  # read twice
        try:
            events, rejects = split_rejects(decoded)
            with permits or nullcontext():
                flush_events(events, data_dir, catalog, batch=(name, number), metrics=metrics)
            if on_reject:
                on_reject(rejects, number)
            if metrics and not known:  # counted as the flush read them
                metrics.add("ingest_rejects_total", seen.get["rejects"])
                metrics.observe("flush_duration_seconds", time.monotonic() - began)
        finally:
            if on_reject:
                decoded.unpersist()

    if metrics:
        payloads.sparkSession.streams.addListener(IngestMonitor(name, metrics))
    return payloads.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(write).start()


def is_ready(query) -> bool:
    """Active, and past its first progress report."""
    return query.isActive and query.lastProgress is not None


def lag(query) -> int:
    """Records behind the newest offsets, as sources report it; 0 where none does."""
    return _behind(query.lastProgress) if query.lastProgress else 0


def _behind(progress) -> int:
    return max(0, sum(int((s.metrics or {}).get("maxOffsetsBehindLatest", 0)) for s in progress.sources))


def lag_by_partition(progress) -> dict[str, int]:
    """Records behind of each topic partition, where a source reports its offsets by partition."""
    behind: dict[str, int] = {}
    for source in progress.sources:
        try:
            ends, latest = json.loads(source.endOffset or "{}"), json.loads(source.latestOffset or "{}")
            for topic, parts in latest.items():
                for part, to in parts.items():
                    behind[part] = behind.get(part, 0) + max(0, to - ends.get(topic, {}).get(part, 0))
        except (AttributeError, TypeError, ValueError):
            continue  # not a source of partitions
    return behind


class IngestMonitor(StreamingQueryListener):
    """Gauges of a query's progress: lag, how full its batches are, and how often they passed the high water mark."""

    def __init__(self, name: str, metrics, cfg: BatchConfig = BatchConfig()):
        self.name, self.metrics, self.cfg, self.paused = name, metrics, cfg, False

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if event.progress.name == self.name:
            self.take(event.progress)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def take(self, progress) -> None:
        behind = lag_by_partition(progress)
        for part, n in behind.items():
            self.metrics.set("kafka_consumer_lag", n, partition=part)
        if not behind:
            self.metrics.set("kafka_consumer_lag", _behind(progress))
        occupancy = min(1.0, progress.numInputRows / self.cfg.max_rows)
        self.metrics.set("buffer_occupancy_ratio", occupancy)
        paused = next_pause_state(self.paused, occupancy, False, False, True)
        if paused and not self.paused:
            self.metrics.add("backpressure_pauses_total")
        self.paused = paused


def stop_gracefully(query, timeout_s: float = 60) -> None:
    """Let the running batch commit, then stop: nothing that was read is lost or counted twice."""
    ends = time.monotonic() + timeout_s
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < ends:
        time.sleep(0.05)
    query.stop()


def next_pause_state(paused: bool, occupancy: float, flushing: bool, flush_due: bool, permit: bool) -> bool:
    """Backpressure as a pure function (K4, K5): what the pull model replaces, kept for sizing."""
    if not paused:
        return (occupancy > HIGH_WATER and not flushing) or (flush_due and not permit)
    return not (occupancy < LOW_WATER)


__all__ = ["PAYLOAD_DDL", "IngestMonitor", "file_payloads", "is_ready", "lag", "lag_by_partition", "next_pause_state", "start_ingest", "stop_gracefully"]
