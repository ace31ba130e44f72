"""Transactional file catalog: one SQLite table on the driver, exposed as a DataFrame.

Pruning picks paths here, before Spark lists or opens anything, so a query's
planning cost follows the files it reads.
"""

import sqlite3
import threading
import time
from dataclasses import dataclass

from logweir.operators import predicates

# Column names, tiers, states and defaults, which catalogs in use have.
FILES_DDL = "id bigint, path string, tier string, service string, time_bucket string, min_ts bigint, max_ts bigint, size_bytes bigint, record_count bigint, state string, min_kafka_offset bigint, max_kafka_offset bigint, superseded_at bigint"
FIELDS = [part.split()[0] for part in FILES_DDL.split(", ")]


@dataclass(frozen=True)
class FileMeta:
    path: str
    service: str
    time_bucket: str
    min_ts: int
    max_ts: int
    size_bytes: int
    record_count: int
    min_kafka_offset: int = 0
    max_kafka_offset: int = 0


@dataclass(frozen=True)
class FileEntry(FileMeta):
    id: int = 0
    tier: str = "hot"
    state: str = "active"
    superseded_at: int = 0


class Catalog:
    def __init__(self, path=":memory:", clock=time.time):
        self._db = sqlite3.connect(path, check_same_thread=False, isolation_level=None)
        self._lock = threading.RLock()
        self._clock = clock
        kinds = {"bigint": "INTEGER", "string": "TEXT"}
        cols = []
        for part in FILES_DDL.split(", "):
            name, kind = part.split()
            extra = {"id": " PRIMARY KEY AUTOINCREMENT", "path": " UNIQUE", "tier": " DEFAULT 'hot'", "state": " DEFAULT 'active'", "superseded_at": " DEFAULT 0"}
            cols.append(f"{name} {kinds[kind]} NOT NULL{extra.get(name, '')}" if name != "id" else f"id INTEGER{extra['id']}")
        with self._lock:
            self._db.execute("PRAGMA journal_mode=WAL")
            self._db.execute(f"CREATE TABLE IF NOT EXISTS files ({', '.join(cols)})")
            self._db.execute("CREATE INDEX IF NOT EXISTS files_by_time ON files (state, max_ts, min_ts)")
            self._db.execute("CREATE TABLE IF NOT EXISTS batches (stream TEXT, batch INTEGER, PRIMARY KEY (stream, batch))")

    # -- writes ----------------------------------------------------------------
    def _insert(self, m: FileMeta) -> int:
        names = [f for f in FileMeta.__dataclass_fields__]
        cur = self._db.execute(f"INSERT INTO files ({', '.join(names)}) VALUES ({', '.join('?' * len(names))})", [getattr(m, n) for n in names])
        return cur.lastrowid

    def _txn(self, work):
        with self._lock:
            self._db.execute("BEGIN IMMEDIATE")
            try:
                out = work()
                self._db.execute("COMMIT")
                return out
            except BaseException:
                self._db.execute("ROLLBACK")
                raise

    def commit_flush(self, *metas: FileMeta, batch: tuple[str, int] | None = None) -> list[int]:
        """Insert files in one transaction; a (stream, batch) seen before changes nothing and gives []."""

        def work():
            if batch and self._db.execute("INSERT OR IGNORE INTO batches VALUES (?, ?)", batch).rowcount == 0:
                return []
            return [self._insert(m) for m in metas]

        return self._txn(work)

    def has_batch(self, stream: str, batch: int) -> bool:
        with self._lock:
            return bool(self._db.execute("SELECT 1 FROM batches WHERE stream = ? AND batch = ?", (stream, batch)).fetchone())

    def swap_compacted(self, old_ids, new) -> list[int]:
        """Insert the new files and supersede the old ones in one transaction (L3)."""

        def work():
            ids = [self._insert(m) for m in new]
            now = int(self._clock())
            self._db.executemany("UPDATE files SET state = 'superseded', superseded_at = ? WHERE id = ?", [(now, i) for i in old_ids])
            return ids

        return self._txn(work)

    def set_cold(self, file_id: int, path: str) -> None:
        with self._lock:
            self._db.execute("UPDATE files SET tier = 'cold', path = ? WHERE id = ?", (path, file_id))

    def delete_file(self, file_id: int) -> None:
        with self._lock:
            self._db.execute("DELETE FROM files WHERE id = ?", (file_id,))

    # -- reads -----------------------------------------------------------------
    def _rows(self, where: str = "1", args=()) -> list[FileEntry]:
        with self._lock:
            got = self._db.execute(f"SELECT {', '.join(FIELDS)} FROM files WHERE {where} ORDER BY id", args).fetchall()
        return [FileEntry(**dict(zip(FIELDS, r))) for r in got]

    def all_files(self):
        return self._rows()

    def active_files(self, service: str | None = None):
        return self._rows("state = 'active'" + (" AND service = ?" if service is not None else ""), (service,) if service is not None else ())

    def overlapping(self, time_from: int, time_to: int) -> tuple[list[FileEntry], int]:
        """(active files that meet the closed window, number pruned)."""
        with self._lock:
            total = self._db.execute("SELECT count(*) FROM files WHERE state = 'active'").fetchone()[0]
            kept = self._rows(predicates.OVERLAPS.format(time_from="?", time_to="?"), (time_from, time_to))
        return kept, total - len(kept)

    def tier_eligible(self, cutoff: int):
        return self._rows(predicates.TIER_ELIGIBLE.format(cutoff="?"), (cutoff,))

    def expired(self, hot_cutoff: int, cold_cutoff: int):
        return self._rows(predicates.EXPIRED.format(hot="?", cold="?"), (hot_cutoff, cold_cutoff))

    def superseded_before(self, cutoff_s: int):
        return self._rows(predicates.PAST_GRACE.format(cutoff="?"), (cutoff_s,))

    def bucket_files(self, service: str, time_bucket: str):
        return self._rows(predicates.BUCKET.format(service="?", time_bucket="?"), (service, time_bucket))

    def tier_counts(self) -> dict[str, int]:
        with self._lock:
            got = dict(self._db.execute("SELECT tier, count(*) FROM files WHERE state = 'active' GROUP BY tier"))
        return {tier: got.get(tier, 0) for tier in ("hot", "cold")}

    def compactable_buckets(self, min_files: int) -> list[tuple[str, str]]:
        with self._lock:
            return self._db.execute("SELECT service, time_bucket FROM files WHERE state = 'active' AND tier = 'hot' GROUP BY 1, 2 HAVING " + predicates.COMPACTABLE.format(count="count(*)", least="?") + " ORDER BY 1, 2", (min_files,)).fetchall()

    def hot_bucket_stats(self) -> list[dict]:
        from logweir.functions.scalar import density

        sql = "SELECT service, time_bucket, count(*), sum(record_count), max(max_kafka_offset) - min(min_kafka_offset) + 1 FROM files WHERE state = 'active' AND tier = 'hot' GROUP BY 1, 2 ORDER BY 1, 2"
        with self._lock:
            got = self._db.execute(sql).fetchall()
        return [dict(service=s, time_bucket=b, file_count=n, total_records=t, offset_span=span, density=density(t, span)) for s, b, n, t, span in got]

    def as_dataframe(self, spark):
        """The whole catalog as a DataFrame, for reports and joins."""
        return spark.createDataFrame([tuple(getattr(r, f) for f in FIELDS) for r in self._rows()], FILES_DDL)

    def close(self):
        self._db.close()
