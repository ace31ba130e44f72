"""Counters, gauges and histograms with a text exposition."""

import threading
from collections import defaultdict

#: The metric names and kinds that existing dashboards read.
DASHBOARD = {
    "events_ingested_total": "counter",
    "flush_duration_seconds": "histogram",
    "buffer_occupancy_ratio": "gauge",
    "kafka_consumer_lag": "gauge",
    "backpressure_pauses_total": "counter",
    "files_active": "gauge",
    "files_compacting": "gauge",
    "query_duration_seconds": "histogram",
    "bytes_scanned_total": "counter",
    "active_queries": "gauge",
    "rate_limit_rejected_total": "counter",
    "cache_hits_total": "counter",
    "cache_misses_total": "counter",
}
METRICS = {**DASHBOARD, "ingest_rejects_total": "counter"}
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Metrics:
    def __init__(self):
        self._lock = threading.Lock()
        self._values = defaultdict(float)
        self._histograms = defaultdict(list)

    def add(self, name, by=1, **labels):
        with self._lock:
            self._values[name, tuple(sorted(labels.items()))] += by

    def set(self, name, value, **labels):
        with self._lock:
            self._values[name, tuple(sorted(labels.items()))] = value

    def observe(self, name, seconds, **labels):
        with self._lock:
            key = name, tuple(sorted(labels.items()))
            counts = self._histograms[key] or [0] * (len(BUCKETS) + 1) + [0.0]
            at = next((i for i, b in enumerate(BUCKETS) if seconds <= b), len(BUCKETS))
            counts[at] += 1
            counts[-1] += seconds
            self._histograms[key] = counts

    def value(self, name, **labels):
        return self._values.get((name, tuple(sorted(labels.items()))), 0.0)

    def expose(self) -> str:
        """Text exposition format, version 0.0.4."""
        text = lambda labels, *more: "{" + ",".join(f'{k}="{v}"' for k, v in (*labels, *more)) + "}" if labels or more else ""
        lines = []
        with self._lock:
            for name, kind in METRICS.items():
                lines.append(f"# TYPE {name} {kind}")
                for (n, labels), v in sorted(self._values.items()):
                    if n == name:
                        lines.append(f"{name}{text(labels)} {v:g}")
                for (n, labels), counts in sorted(self._histograms.items()):
                    if n == name:
                        total = 0
                        for le, c in zip((*map(str, BUCKETS), "+Inf"), counts[:-1]):
                            total += c
                            lines.append(f"{name}_bucket{text(labels, ('le', le))} {total}")
                        lines += [f"{name}_sum{text(labels)} {counts[-1]:g}", f"{name}_count{text(labels)} {total}"]
        return "\n".join(lines) + "\n"
