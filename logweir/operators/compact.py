"""Compaction: a bucket's files become deduplicated, time-ordered files of a target size."""

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from logweir.catalog import Catalog
from logweir.operators.dedup import dedup, sorted_by_time
from logweir.sinks.flush import written_files
from logweir.sources.scan import scan_files


@dataclass(frozen=True)
class CompactionConfig:
    min_files: int = 2
    target_bytes: int = 64 << 20
    interval_s: int = 1800
    small_file_threshold: int = 10
    max_duplicate_ratio: float = 0.5
    threshold_check_s: int = 60


def split_by_size(sizes: list[int], target: int) -> list[list[int]]:
    """Greedy chunks of consecutive items; an item over the target is its own chunk; none is split (L2)."""
    chunks: list[list[int]] = []
    room = -1
    for i, size in enumerate(sizes):
        if chunks and size <= room:
            chunks[-1].append(i)
            room -= size
        else:
            chunks.append([i])
            room = target - size
    return chunks


def compact_bucket(spark, service: str, time_bucket: str, data_dir: str, catalog: Catalog, cfg: CompactionConfig = CompactionConfig()) -> list[int]:
    """New catalog ids, [] with fewer than two files.

    Old files are superseded in the transaction that adds the new ones, and
    left to the sweeper, so that running queries keep their inputs.
    """
    files = catalog.bucket_files(service, time_bucket)
    if len(files) < 2:
        return []
    parts = max(1, math.ceil(sum(f.size_bytes for f in files) / cfg.target_bytes))
    folder = f"{data_dir.rstrip('/')}/compact-{uuid.uuid4().hex}"
    sorted_by_time(dedup(scan_files(spark, files)), parts).write.parquet(folder)
    return catalog.swap_compacted([f.id for f in files], written_files(spark, folder))


def due(catalog: Catalog, cfg: CompactionConfig, scheduled: bool) -> list[tuple[str, str]]:
    """Buckets of the schedule (min_files) or of the threshold check (many files or many duplicates)."""
    if scheduled:
        return catalog.compactable_buckets(max(2, cfg.min_files))
    return [(s["service"], s["time_bucket"]) for s in catalog.hot_bucket_stats() if s["file_count"] >= cfg.small_file_threshold or s["density"] >= cfg.max_duplicate_ratio]


def run_compaction(spark, data_dir: str, catalog: Catalog, cfg: CompactionConfig = CompactionConfig(), scheduled: bool = True, log=print, metrics=None, parallel: int = 4) -> int:
    """One pass over the due buckets, several at once; an error in one is logged and the others go on."""

    def one(bucket) -> bool:
        try:
            return bool(compact_bucket(spark, *bucket, data_dir, catalog, cfg))
        except Exception as e:  # noqa: BLE001
            log(f"compaction of {bucket[0]}/{bucket[1]} failed: {e}")
            return False

    if metrics:
        metrics.set("files_compacting", 1)
    try:
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            return sum(pool.map(one, due(catalog, cfg, scheduled)))
    finally:
        if metrics:
            metrics.set("files_compacting", 0)
