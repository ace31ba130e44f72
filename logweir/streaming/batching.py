"""Batch slicing by size, count and age: as a small class and as a replay over an ordered log."""

import time
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class BatchConfig:
    max_bytes: int = 64 << 20
    max_rows: int = 50_000
    max_age_ms: int = 1_000


class BatchBuffer:
    """Flushes on bytes, rows or age; the event that triggers is part of the batch."""

    def __init__(self, cfg: BatchConfig = BatchConfig(), now_ms=lambda: time.monotonic_ns() // 1_000_000):
        self.cfg, self._now = cfg, now_ms
        self._events, self._bytes, self._since = [], 0, None

    def push(self, event, size: int):
        if not self._events:
            self._since = self._now()
        self._events.append(event)
        self._bytes += size
        full = self._bytes >= self.cfg.max_bytes or len(self._events) >= self.cfg.max_rows
        return self.drain() if full or self._aged() else None

    def poll(self):
        return self.drain() if self._events and self._aged() else None

    def drain(self):
        out, self._events, self._bytes, self._since = self._events, [], 0, None
        return out

    def _aged(self):
        return self._since is not None and self._now() - self._since >= self.cfg.max_age_ms

    @property
    def occupancy(self) -> float:
        return min(1.0, self._bytes / self.cfg.max_bytes) if self.cfg.max_bytes else 1.0

    def __len__(self):
        return len(self._events)


def slice_batches(df: DataFrame, cfg: BatchConfig, partition: str, order: str, size: str, at_ms: str) -> DataFrame:
    """Adds ``batch``: the number of the flush, per partition, that a replay in order would give.

    Limits reset at each flush, which no window frame expresses. State runs
    over a sorted stream of Arrow batches, so no partition is held in memory.
    """
    laid = df.repartition(partition).sortWithinPartitions(partition, order)
    fields = T.StructType([*laid.schema.fields, T.StructField("batch", T.LongType())])

    def run(frames):
        key = nbytes = rows = since = None
        number = 0
        for pdf in frames:
            out = []
            for k, s, t in zip(pdf[partition], pdf[size], pdf[at_ms]):
                if k != key:
                    key, nbytes, rows, since, number = k, 0, 0, None, 0
                since = t if since is None else since
                nbytes, rows = nbytes + s, rows + 1
                out.append(number)
                if nbytes >= cfg.max_bytes or rows >= cfg.max_rows or t - since >= cfg.max_age_ms:
                    nbytes, rows, since, number = 0, 0, None, number + 1
            yield pdf.assign(batch=pd.Series(out, index=pdf.index, dtype="int64"))

    return laid.mapInPandas(run, fields)
