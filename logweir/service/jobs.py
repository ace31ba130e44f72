"""Background jobs: bounded concurrency, per-client queue cap, timeout, cancellation, paged results."""

import os
import threading
import uuid
from dataclasses import dataclass, field

from logweir.operators.paging import DEFAULT_PAGE_SIZE, page_slice
from logweir.service.query import ApiError, QueryRequest, QueryService
from logweir.sinks.text import read_result, write_result


@dataclass
class Job:
    id: str
    client: str
    request: QueryRequest
    state: str = "queued"
    error: str | None = None
    result_count: int = 0
    cancel: threading.Event = field(default_factory=threading.Event)
    done: threading.Event = field(default_factory=threading.Event)


class JobService:
    def __init__(self, queries: QueryService, folder: str, max_concurrent: int = 8, timeout_s: float = 300, queue_cap: int = 5):
        self.queries, self.folder, self.timeout_s, self.queue_cap = queries, folder, timeout_s, queue_cap
        self.permits = threading.Semaphore(max_concurrent)
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()

    # -- endpoints -------------------------------------------------------------
    def submit(self, req: QueryRequest, client: str = "local") -> str:
        req.check()
        with self._lock:
            if sum(j.client == client and j.state == "queued" for j in self._jobs.values()) >= self.queue_cap:
                if self.queries.metrics:
                    self.queries.metrics.add("rate_limit_rejected_total")
                raise ApiError(429, {"code": "queue_cap_exceeded", "cap": self.queue_cap}, {"Retry-After": "5"})
            job = Job(str(uuid.uuid4()), client, req)
            self._jobs[job.id] = job
        threading.Thread(target=self._run, args=(job,), daemon=True).start()
        return job.id

    def get(self, job_id: str) -> dict:
        job = self._find(job_id)
        out = {"state": job.state}
        if job.state == "failed":
            out["error"] = job.error
        if job.state == "complete":
            out |= {"result_count": job.result_count, "rows": read_result(self._path(job))}
        return out

    def delete(self, job_id: str) -> None:
        job = self._find(job_id)
        with self._lock:
            if job.state not in ("queued", "running"):
                raise ApiError(409, {"error": f"job is {job.state}"})
            job.state = "cancelled"
            job.cancel.set()
        self.queries.spark.sparkContext.cancelJobsWithTag(self._tag(job))

    def results(self, job_id: str, page: int = 0, page_size: int = DEFAULT_PAGE_SIZE) -> dict:
        job = self._find(job_id)
        if job.state != "complete":
            raise ApiError(409, {"error": f"job is {job.state}"})
        rows = read_result(self._path(job))
        return {"rows": page_slice(rows, page, page_size), "page": page, "page_size": max(1, page_size), "total": len(rows)}

    def wait(self, job_id: str, timeout: float = 60) -> str:
        job = self._find(job_id)
        job.done.wait(timeout)
        return job.state

    # -- running ---------------------------------------------------------------
    def _find(self, job_id: str) -> Job:
        try:
            uuid.UUID(job_id)
        except ValueError as e:
            raise ApiError(400, {"error": "bad job id"}) from e
        if job_id not in self._jobs:
            raise ApiError(404, {"error": "no such job"})
        return self._jobs[job_id]

    def _path(self, job: Job) -> str:
        return os.path.join(self.folder, f"{job.id}.ndjson")

    @staticmethod
    def _tag(job: Job) -> str:
        return f"job-{job.id}"

    def _finish(self, job: Job, state: str, error: str | None = None) -> None:
        with self._lock:
            if job.state in ("queued", "running"):  # a cancelled job stays so
                job.state, job.error = state, error

    def _run(self, job: Job) -> None:
        try:
            while not self.permits.acquire(timeout=0.05):
                if job.cancel.is_set():
                    return
            try:
                with self._lock:
                    if job.state != "queued":
                        return
                    job.state = "running"
                self._work(job)
            finally:
                self.permits.release()
        finally:
            job.done.set()

    def _work(self, job: Job) -> None:
        sc = self.queries.spark.sparkContext
        timer = threading.Timer(self.timeout_s, lambda: (self._finish(job, "failed", "timeout"), sc.cancelJobsWithTag(self._tag(job))))
        timer.start()
        try:
            sc.addJobTag(self._tag(job))
            held = None

            def rows():
                nonlocal held
                for line in self.queries.run(job.request):
                    if job.state != "running":
                        raise InterruptedError(job.state)
                    if held is not None:
                        yield held
                    held = line  # the last line, the statistics, is not a row

            job.result_count = write_result(rows(), self._path(job))
            self._finish(job, "complete")
        except Exception as e:  # noqa: BLE001
            self._finish(job, "failed", str(e))
        finally:
            timer.cancel()
            sc.removeJobTag(self._tag(job))
