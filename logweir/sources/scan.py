"""Pruned scan: the catalog picks paths, Spark reads them as one relation."""

from pyspark.sql import DataFrame

from logweir.catalog import Catalog, FileEntry
from logweir.schema import LOG_SCHEMA


def scan_files(spark, files: list[FileEntry], resolve=lambda path: path) -> DataFrame:
    """One multi-path scan with the fixed schema: no footer is read for inference."""
    return spark.read.schema(LOG_SCHEMA).parquet(*[resolve(f.path) for f in files])


def window_files(catalog: Catalog, time_from: int, time_to: int) -> tuple[list[FileEntry], dict]:
    """(files of a window, statistics), from one look at the catalog. The window picks files and never filters rows."""
    kept, pruned = catalog.overlapping(time_from, time_to)
    return kept, {"rows_scanned": sum(f.record_count for f in kept), "files_pruned": pruned, "bytes_scanned": sum(f.size_bytes for f in kept)}


def scan_window(spark, catalog: Catalog, time_from: int, time_to: int, resolve=lambda path: path) -> tuple[DataFrame | None, dict]:
    """(raw rows or None if no file survives, statistics)."""
    kept, stats = window_files(catalog, time_from, time_to)
    return (scan_files(spark, kept, resolve) if kept else None), stats
