"""Query API: bounds check, pruning, isolated ``logs`` view, row cap, JSON lines, statistics."""

import json
import re
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from logweir.catalog import Catalog, FileEntry
from logweir.functions.scalar import normalise_sql
from logweir.operators.dedup import logs_view
from logweir.operators.paging import DEFAULT_LIMIT, capped
from logweir.session import query_session
from logweir.sinks.text import ndjson
from logweir.sources.scan import scan_files, window_files


class ApiError(Exception):
    def __init__(self, status: int, body: dict, headers: dict | None = None):
        super().__init__(json.dumps(body))
        self.status, self.body, self.headers = status, body, headers or {}


@dataclass(frozen=True)
class QueryRequest:
    sql: str
    time_from: int | None = None
    time_to: int | None = None
    limit: int = DEFAULT_LIMIT

    @classmethod
    def of(cls, payload: dict) -> "QueryRequest":
        return cls(payload["sql"], payload.get("time_from"), payload.get("time_to"), payload.get("limit", DEFAULT_LIMIT))

    def check(self) -> None:
        if self.time_from is None or self.time_to is None:
            raise ApiError(400, {"code": "missing_time_predicate", "error": "time_from and time_to are required"})


_COMMENTS = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


def require_select(sql: str) -> str:
    """Only queries run: SELECT, WITH, VALUES, FROM, TABLE or a parenthesis first."""
    text = normalise_sql(sql)
    first = re.match(r"\s*(\(|\w+)", _COMMENTS.sub(" ", text))
    if not first or first[1].upper() not in ("(", "SELECT", "WITH", "VALUES", "FROM", "TABLE"):
        raise ValueError("only SELECT queries are accepted")
    if re.search(r"\bINSERT\s+(INTO|OVERWRITE)\b", re.sub(r"'(?:[^']|'')*'", "''", _COMMENTS.sub(" ", text)), re.I):
        raise ValueError("only SELECT queries are accepted")
    return text


class QueryService:
    """In-process counterpart of the HTTP query endpoint."""

    def __init__(self, spark, catalog: Catalog, cold=None, metrics=None, cold_concurrency: int = 4):
        self.spark, self.catalog, self.cold, self.metrics = spark, catalog, cold, metrics
        self._cold_permits = threading.BoundedSemaphore(cold_concurrency)

    def plan(self, req: QueryRequest, files: list[FileEntry]) -> DataFrame | None:
        """The capped user query over ``files``, None without any. Cold files are fetched here."""
        if not files:
            return None
        raw = scan_files(query_session(self.spark), files, self.cold.resolve if self.cold else (lambda p: p))
        logs_view(raw).createOrReplaceTempView("logs")
        return capped(raw.sparkSession.sql(require_select(req.sql)), req.limit)

    def run(self, req: QueryRequest) -> Iterator[str]:
        """JSON rows, then one statistics line. Planning errors are raised before the first row."""
        req.check()
        began = time.monotonic()
        # One look at the catalog: files, statistics and the need for a permit agree.
        files, stats = window_files(self.catalog, req.time_from, req.time_to)
        rows = self._rows(req, files, stats, began)
        next(rows)  # takes the permit and plans; from here on the generator gives it back, read or not
        return rows

    def _rows(self, req, files, stats, began):
        is_cold = any(f.tier == "cold" for f in files)
        if is_cold:
            self._cold_permits.acquire()  # before the first download, until the last row
        if self.metrics:
            self.metrics.add("active_queries", 1)
        try:
            try:
                df = self.plan(req, files)
            except ApiError:
                raise
            except Exception as e:  # noqa: BLE001
                raise ApiError(500, {"error": str(e)}) from e
            if self.metrics:
                self.metrics.add("bytes_scanned_total", stats["bytes_scanned"])
            yield ""
            started = time.monotonic()
            if df is not None:
                yield from ndjson(df)
            yield json.dumps({**stats, "duration_ms": int((time.monotonic() - started) * 1000)})
        finally:
            if is_cold:
                self._cold_permits.release()
            if self.metrics:
                self.metrics.add("active_queries", -1)
                self.metrics.observe("query_duration_seconds", time.monotonic() - began)

    def rows(self, req: QueryRequest) -> tuple[list[dict], dict]:
        lines = [json.loads(x) for x in self.run(req)]
        return lines[:-1], lines[-1]
