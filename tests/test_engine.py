import glob
import json
import os
import threading
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logweir.catalog import Catalog, FileMeta
from logweir.functions import scalar
from logweir.operators.compact import CompactionConfig, compact_bucket, run_compaction, split_by_size
from logweir.operators.dedup import dedup, logs_view
from logweir.operators.lifecycle import LifecycleConfig, run_tiering, sweep_expired, sweep_superseded
from logweir.schema import LOG_SCHEMA, decode_payload, encode_payload, split_rejects
from logweir.service.jobs import JobService
from logweir.service.query import ApiError, QueryRequest, QueryService, require_select
from logweir.sinks.flush import flush_events
from logweir.sinks.metrics import Metrics
from logweir.sinks.text import csv_column, csv_lines
from logweir.sources.cold import ColdCache, ObjectStore
from logweir.sources.push import BadEvent, push
from logweir.sources.synthetic import demo_events
from logweir.streaming.batching import BatchBuffer, BatchConfig, slice_batches
from logweir.streaming.ingest import file_payloads, is_ready, next_pause_state, start_ingest

MAX = 2**63 - 1


@pytest.fixture
def catalog():
    return Catalog()


@pytest.fixture
def store(spark, tmp_path):
    return ObjectStore(spark, f"file://{tmp_path}/cold", "bkt")


def svc(spark, catalog, **kw):
    return QueryService(spark, catalog, **kw)


def test_codec_round_trip(spark):
    row = (1700000000000000000, "INFO", "api-gateway", "request handled", 3, 9999, '{"request_id":"abc-123","status_code":200,"latency_ms":42.5,"cached":false}')
    df = spark.createDataFrame([row], LOG_SCHEMA)
    good, bad = split_rejects(decode_payload(encode_payload(df)))
    got = good.collect()[0]
    assert tuple(got)[:6] == row[:6] and json.loads(got.attributes) == json.loads(row[6]) and bad.count() == 0


def test_decode_rejects_and_overrides(spark):
    ok = {"timestamp": 1, "level": "INFO", "service": "s", "message": "m", "kafka_partition": 0, "kafka_offset": 0, "attributes": {"a": 1, "b": "x", "c": 1.5, "d": True}}
    bad = ["{", "null", "", json.dumps({**ok, "level": "info"}), json.dumps({**ok, "attributes": {"a": None}}), json.dumps({**ok, "attributes": {"a": {}}}), json.dumps({**ok, "attributes": {"a": [1]}}), json.dumps({k: v for k, v in ok.items() if k != "kafka_offset"})]
    df = spark.createDataFrame([(json.dumps(ok), 7, 70)] + [(b, 0, 0) for b in bad] + [(None, 0, 0)], "value string, partition int, offset long")
    good, rejects = split_rejects(decode_payload(df, "value", "partition", "offset"))
    assert [(r.kafka_partition, r.kafka_offset) for r in good.collect()] == [(7, 70)]
    assert rejects.count() == len(bad) + 1


def test_write_and_query(spark, catalog, tmp_path):
    df = spark.createDataFrame([(1700000000000000000, "INFO", "test-svc", "m", 0, 42, '{"request_id":"test-req-1","latency_ms":12.3}')], LOG_SCHEMA)
    flush_events(df, str(tmp_path), catalog)
    rows, stats = svc(spark, catalog).rows(QueryRequest("SELECT * FROM logs;", 0, MAX))
    assert len(rows) == 1 and rows[0]["kafka_offset"] == 42 and json.loads(rows[0]["attributes"])["latency_ms"] == 12.3
    assert stats["rows_scanned"] == 1 and stats["files_pruned"] == 0 and stats["bytes_scanned"] > 0


@pytest.mark.parametrize("bounds", [(None, 1), (1, None), (None, None)])
def test_missing_bounds(spark, catalog, bounds):
    with pytest.raises(ApiError) as e:
        list(svc(spark, catalog).run(QueryRequest("SELECT 1", *bounds)))
    assert e.value.status == 400 and e.value.body["code"] == "missing_time_predicate"


def test_empty_catalog_gives_stats_only_and_does_not_parse(spark, catalog):
    rows, stats = svc(spark, catalog).rows(QueryRequest("NOT SQL", 0, MAX))
    assert rows == [] and stats["rows_scanned"] == 0


def test_prune(spark, catalog, ev, tmp_path):
    for t, o in [(1000, 0), (2000, 1), (5000, 2), (6000, 3)]:
        flush_events(ev([(t, o)]), str(tmp_path), catalog)
    _, stats = svc(spark, catalog).rows(QueryRequest("SELECT * FROM logs", 0, 3000))
    assert stats["files_pruned"] == 2 and stats["rows_scanned"] == 2
    assert stats["bytes_scanned"] == sum(f.size_bytes for f in catalog.active_files() if f.min_ts <= 3000)
    rows, _ = svc(spark, catalog).rows(QueryRequest("SELECT * FROM logs", 2000, 2000))
    assert [r["kafka_offset"] for r in rows] == [1]  # closed interval


def test_dedup_and_projection(spark, catalog, ev, tmp_path):
    flush_events(ev([(1000, 1), (2000, 2)]), str(tmp_path), catalog)
    flush_events(ev([(1000, 1)]), str(tmp_path), catalog)
    q = svc(spark, catalog)
    rows, stats = q.rows(QueryRequest("SELECT * FROM logs ORDER BY kafka_offset", 0, MAX))
    assert stats["rows_scanned"] == 3 and [r["kafka_offset"] for r in rows] == [1, 2] and "_rn" not in rows[0]
    rows, _ = q.rows(QueryRequest("SELECT message, timestamp FROM logs", 0, MAX))
    assert len(rows) == 2 and set(rows[0]) == {"message", "timestamp"}
    rows, _ = q.rows(QueryRequest("SELECT avg(timestamp) a, NULL n FROM logs", 0, MAX))
    assert rows == [{"a": 1500.0, "n": None}]
    rows, _ = q.rows(QueryRequest("SELECT * FROM logs", 0, MAX, limit=1))
    assert len(rows) == 1


def test_pruned_earlier_replica_surfaces(spark, catalog, ev, tmp_path):
    flush_events(ev([(1000, 1)]), str(tmp_path), catalog)
    flush_events(ev([(9000, 1)]), str(tmp_path), catalog)
    rows, _ = svc(spark, catalog).rows(QueryRequest("SELECT timestamp FROM logs", 5000, MAX))
    assert rows == [{"timestamp": 9000}]


def test_upper_bound_pushdown_equals_filter(spark, ev):
    df = ev([(i % 50, i % 17) for i in range(200)])
    assert sorted(logs_view(df, 20).collect()) == sorted(dedup(df).filter("timestamp <= 20").collect())


def test_sql_gate(spark, catalog, ev, tmp_path):
    assert require_select("SELECT 1 ;;") == "SELECT 1"
    for bad in ("DROP TABLE x", "INSERT INTO t VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", ""):
        with pytest.raises(ValueError):
            require_select(bad)
    require_select("SELECT 'insert into x'")
    flush_events(ev([(1, 1)]), str(tmp_path), catalog)
    with pytest.raises(ApiError) as e:
        svc(spark, catalog).rows(QueryRequest("SELECT nope FROM logs", 0, MAX))
    assert e.value.status == 500


def test_mixed_service_batch_splits(spark, catalog, tmp_path):
    flush_events(demo_events(spark, 100), str(tmp_path), catalog)
    got = catalog.active_files()
    assert {f.service for f in got} == {"web", "auth", "billing", "worker"} and sum(f.record_count for f in got) == 100
    assert len(catalog.active_files("web")) == 1 and got[0].time_bucket == "2023-11-14-22"
    assert catalog.as_dataframe(spark).filter("state = 'active'").count() == len(got)


def test_compaction(spark, catalog, ev, tmp_path):
    for pairs in ([(3000, 3)], [(1000, 1)], [(1000, 1), (2000, 2)]):
        flush_events(ev(pairs), str(tmp_path), catalog)
    assert compact_bucket(spark, "svc", "1970-01-01-00", str(tmp_path), catalog)
    (only,) = catalog.active_files()
    assert only.record_count == 3 and only.tier == "hot"
    path = only.path.removeprefix("file://")
    table = pq.read_table(path)
    assert table["timestamp"].to_pylist() == [1000, 2000, 3000] and len(set(table["kafka_offset"].to_pylist())) == 3
    meta = pq.ParquetFile(path).metadata.row_group(0)
    ts = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema == "timestamp")
    assert ts.is_stats_set and ts.statistics.min == 1000
    assert compact_bucket(spark, "svc", "1970-01-01-00", str(tmp_path), catalog) == []
    assert len(catalog.superseded_before(int(time.time()) + 10)) == 3


def test_threshold_trigger(spark, catalog, ev, tmp_path):
    for i in range(5):
        flush_events(ev([(1_000_000 + i, i)]), str(tmp_path), catalog)
    cfg = CompactionConfig(min_files=100, small_file_threshold=3, max_duplicate_ratio=1.0)
    assert run_compaction(spark, str(tmp_path), catalog, cfg, scheduled=True) == 0
    assert run_compaction(spark, str(tmp_path), catalog, cfg, scheduled=False) == 1
    assert len(catalog.active_files()) < 5


def test_chunking():
    assert split_by_size([10, 10, 10], 5) == [[0], [1], [2]]
    assert split_by_size([10, 10, 10], 100) == [[0, 1, 2]]
    assert split_by_size([], 5) == []


def meta(path, max_ts=0, **kw):
    return FileMeta(path, kw.get("service", "s"), "b", 0, max_ts, 1, kw.get("n", 1), kw.get("lo", 0), kw.get("hi", 0))


def test_catalog_filters():
    now = 1_000_000
    c = Catalog(clock=lambda: now - 3600)
    a, b = c.commit_flush(meta("a", 1000), meta("b", MAX))
    assert [f.path for f in c.expired(10**9, 0)] == ["a"] and [f.path for f in c.tier_eligible(1001)] == ["a"] and c.tier_eligible(1000) == []
    c.swap_compacted([a], [meta("c")])
    c._clock = lambda: now
    c.swap_compacted([b], [])
    assert [f.path for f in c.superseded_before(now - 600)] == ["a"]
    c.delete_file(a)
    assert [f.path for f in c.all_files()] == ["b", "c"]
    c.set_cold(3, "s3://x")
    assert c.tier_counts() == {"hot": 0, "cold": 1}
    with pytest.raises(Exception):
        c.commit_flush(meta("z"), meta("s3://x"))
    assert [f.path for f in c.all_files()] == ["b", "s3://x"]  # the failed transaction left nothing


def test_bucket_stats():
    c = Catalog()
    c.commit_flush(meta("a", n=10, lo=0, hi=9), meta("b", n=10, lo=0, hi=9))
    (s,) = c.hot_bucket_stats()
    assert (s["file_count"], s["total_records"], s["offset_span"], s["density"]) == (2, 20, 10, 0.5)
    assert c.compactable_buckets(2) == [("s", "b")] and c.compactable_buckets(3) == []
    assert scalar.density(0, 5) == scalar.density(5, 0) == 0.0


def test_tiering_cold_query_cache_and_retention(spark, catalog, store, ev, tmp_path):
    for i in range(4):
        flush_events(ev([(1000 * (i + 1), 10 + i)]), str(tmp_path / "hot"), catalog)
    metrics = Metrics()
    assert run_tiering(catalog, store, LifecycleConfig(tier_threshold_days=0), now_ns=lambda: 4500, metrics=metrics) == 4
    for i in range(2):
        flush_events(ev([(5000 + 1000 * i, 20 + i)]), str(tmp_path / "hot"), catalog)
    assert metrics.value("files_active", tier="cold") == 4 and catalog.tier_counts() == {"hot": 2, "cold": 4}
    cache = ColdCache(store, str(tmp_path / "cache"), metrics=metrics)
    q = svc(spark, catalog, cold=cache, metrics=metrics)
    for _ in range(2):
        rows, _ = q.rows(QueryRequest("SELECT kafka_offset FROM logs ORDER BY kafka_offset", 0, MAX))
        assert [r["kafka_offset"] for r in rows] == [10, 11, 12, 13, 20, 21]
        for f in glob.glob(str(tmp_path / "cold" / "**" / "*.parquet"), recursive=True):
            os.remove(f)
    assert metrics.value("cache_misses_total") == 4 and metrics.value("cache_hits_total") == 4
    cfg = LifecycleConfig(hot_retention_days=0, cold_retention_days=0)
    assert sweep_expired(catalog, store, cfg, now_ns=lambda: 5500) == 5  # missing objects count as deleted
    assert [f.max_ts for f in catalog.active_files()] == [6000]


def test_sweep_superseded(spark, catalog, store, ev, tmp_path):
    for i in range(2):
        flush_events(ev([(i, i)]), str(tmp_path), catalog)
    compact_bucket(spark, "svc", "1970-01-01-00", str(tmp_path), catalog)
    assert sweep_superseded(catalog, store) == 0
    assert sweep_superseded(catalog, store, now_ns=lambda: time.time_ns() + 700 * 10**9) == 2
    assert svc(spark, catalog).rows(QueryRequest("SELECT * FROM logs", 0, MAX))[1]["rows_scanned"] == 2


def test_cache_evicts_least_recent(tmp_path):
    class Fake:
        def get(self, uri, local):
            open(local, "w").write("x" * 40)

    cache = ColdCache(Fake(), str(tmp_path), max_bytes=100)
    a, b = cache.get_or_fetch("s3://k/a"), cache.get_or_fetch("s3://k/b")
    cache.get_or_fetch("s3://k/a")
    c = cache.get_or_fetch("s3://k/c")
    assert os.path.exists(a) and not os.path.exists(b) and os.path.exists(c)


def test_push(spark, catalog, tmp_path):
    body = {"timestamp": 5, "level": "warn", "service": "s", "message": "m", "kafka_partition": 0, "kafka_offset": 1}
    push(spark, body, str(tmp_path), catalog)
    rows, _ = svc(spark, catalog).rows(QueryRequest("SELECT level, attributes FROM logs", 0, MAX))
    assert rows == [{"level": "WARN", "attributes": "{}"}]
    for bad in ({**body, "level": "x"}, {**body, "attributes": {"a": None}}, {k: v for k, v in body.items() if k != "service"}):
        with pytest.raises(BadEvent):
            push(spark, bad, str(tmp_path), catalog)


# -- jobs -------------------------------------------------------------------------------
@pytest.fixture
def jobs(spark, catalog, ev, tmp_path):
    flush_events(ev([(1000 + i, i) for i in range(5)]), str(tmp_path), catalog)
    return JobService(svc(spark, catalog), str(tmp_path / "jobs"))


REQ = QueryRequest("SELECT * FROM logs ORDER BY kafka_offset", 0, MAX)


def test_job_equals_query_and_pages(jobs):
    began = time.monotonic()
    job = jobs.submit(REQ)
    assert time.monotonic() - began < 0.05
    assert jobs.wait(job) == "complete"
    got = jobs.get(job)
    assert got["result_count"] == 5 and got["rows"] == jobs.queries.rows(REQ)[0]
    pages = [jobs.results(job, p, 2) for p in range(3)]
    assert [len(p["rows"]) for p in pages] == [2, 2, 1] and {p["total"] for p in pages} == {5}
    assert [p["rows"][0]["kafka_offset"] for p in pages] == [0, 2, 4]
    with pytest.raises(ApiError) as e:
        jobs.delete(job)
    assert e.value.status == 409
    for bad, status in (("nope", 400), ("00000000-0000-0000-0000-000000000000", 404)):
        with pytest.raises(ApiError) as e:
            jobs.get(bad)
        assert e.value.status == status


def test_queue_cap_and_cancel_queued(jobs):
    jobs.permits = threading.Semaphore(0)
    ids = [jobs.submit(REQ, "c") for _ in range(5)]
    with pytest.raises(ApiError) as e:
        jobs.submit(REQ, "c")
    assert e.value.status == 429 and e.value.headers["Retry-After"] == "5" and e.value.body == {"code": "queue_cap_exceeded", "cap": 5}
    jobs.submit(REQ, "other")
    jobs.delete(ids[0])
    assert jobs.wait(ids[0], 5) == "cancelled" and jobs.get(ids[0]) == {"state": "cancelled"}
    jobs.submit(REQ, "c")


def test_cancel_running_timeout_and_failure(jobs):
    slow = QueryRequest("SELECT count(*) FROM logs a, range(100000000000) r WHERE hash(r.id, a.kafka_offset) = 5", 0, MAX)
    job = jobs.submit(slow)
    while jobs.get(job)["state"] == "queued":
        time.sleep(0.02)
    time.sleep(1)
    jobs.delete(job)
    assert jobs.wait(job, 30) == "cancelled"
    jobs.timeout_s = 1
    job = jobs.submit(slow)
    assert jobs.wait(job, 30) == "failed" and jobs.get(job)["error"] == "timeout"
    job = jobs.submit(QueryRequest("SELECT nope FROM logs", 0, MAX))
    assert jobs.wait(job, 30) == "failed"


def test_http(spark, jobs, tmp_path):
    import urllib.request

    from logweir.service.http import make_server

    metrics = Metrics()
    jobs.queries.metrics = metrics
    server = make_server(jobs.queries, jobs, str(tmp_path), metrics, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    post = lambda path, body: urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode(), method="POST"))
    lines = post("/query", {"sql": "SELECT * FROM logs", "time_from": 0, "time_to": MAX}).read().decode().splitlines()
    assert len(lines) == 6
    assert post("/ingest", {"timestamp": 5, "level": "info", "service": "s", "message": "m", "kafka_partition": 9, "kafka_offset": 1}).status == 204
    text = urllib.request.urlopen(base + "/metrics").read().decode()
    assert 'events_ingested_total{service="s"} 1' in text and "query_duration_seconds_sum" in text
    with pytest.raises(urllib.error.HTTPError) as e:
        post("/query", {"sql": "SELECT 1"})
    assert e.value.code == 400
    server.shutdown()


# -- batching and streaming -------------------------------------------------------------
def test_batching_rules():
    now = [0]
    b = BatchBuffer(BatchConfig(max_age_ms=1000), lambda: now[0])
    assert b.push("a", 1) is None and b.poll() is None
    now[0] = 1001
    assert b.poll() == ["a"] and b.poll() is None
    assert b.push("b", 1) is None
    now[0] = 2002
    assert b.push("c", 1) == ["b", "c"]
    assert BatchBuffer(BatchConfig(max_rows=2)).push("a", 1) is None
    b = BatchBuffer(BatchConfig(max_bytes=100))
    assert b.push("a", 60) is None and b.occupancy == 0.6 and b.push("b", 60) == ["a", "b"]
    assert BatchBuffer(BatchConfig(max_bytes=10)).push("x", 1000) == ["x"]


def test_slice_batches_matches_buffer(spark):
    rows = [(i % 3, i, (i * 7) % 50, i * 100) for i in range(300)]
    cfg = BatchConfig(max_bytes=120, max_rows=6, max_age_ms=1500)
    got = {(r.p, r.o): r.batch for r in slice_batches(spark.createDataFrame(rows, "p int, o long, s long, t long"), cfg, "p", "o", "s", "t").collect()}
    for part in range(3):
        now, number = [0], 0
        buf = BatchBuffer(cfg, lambda: now[0])
        for p, o, s, t in rows:
            if p == part:
                now[0] = t
                assert got[p, o] == number
                if buf.push(o, s) is not None:
                    number += 1


def test_byte_size(spark):
    df = spark.createDataFrame([(0, "INFO", "svc", "", 0, 0, "{}"), (0, "INFO", "svc", "", 0, 0, '{"key":"value","count":42}')], LOG_SCHEMA)
    assert [r[0] for r in df.select(scalar.event_byte_size()).collect()] == [27, 48]


def test_stream_ingest_and_replay(spark, catalog, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    encode_payload(demo_events(spark, 50)).write.text(src)
    seen = []

    def once():
        q = start_ingest(file_payloads(spark, src), "s1", out, catalog, ck, trigger={"availableNow": True}, on_reject=lambda df, n: seen.append(df.count()))
        q.awaitTermination(60)
        return q

    once()
    n = len(catalog.active_files())
    once()
    assert len(catalog.active_files()) == n
    spark.createDataFrame([("not json",), (demo_payload(51),)], "value string").coalesce(1).write.mode("append").text(src)
    once()
    rows, _ = svc(spark, catalog).rows(QueryRequest("SELECT count(*) n FROM logs", 0, MAX))
    assert rows == [{"n": 51}] and seen[-1] == 1
    assert flush_events(demo_events(spark, 5), out, catalog, batch=("s1", 0)) == []  # a retried batch


def demo_payload(offset):
    return json.dumps({"timestamp": 1, "level": "INFO", "service": "s", "message": "m", "kafka_partition": 0, "kafka_offset": offset, "attributes": {}})


def test_backpressure_state():
    assert next_pause_state(False, 0.9, False, False, True) and not next_pause_state(False, 0.5, False, False, True)
    assert next_pause_state(False, 0.1, False, True, False) and next_pause_state(True, 0.5, False, False, True) and not next_pause_state(True, 0.3, False, False, True)


def test_text_and_names(spark):
    assert list(csv_lines(["a", "b"], [{"a": 'x"y', "b": None}, {"a": "1", "b": 2}])) == ['"a","b"', '"x""y",', '"1",2']
    assert [r[0] for r in csv_column(spark.createDataFrame([('x"y', 2), (None, None)], "a string, b int")).collect()] == ['"x""y",2', ","]
    uri = scalar.cold_uri("bkt", "svc", "2024-01-01-00", "f.parquet")
    assert uri == "s3://bkt/svc/2024-01-01-00/f.parquet" and scalar.cache_filename(uri) == "bkt_svc_2024-01-01-00_f.parquet"
    assert scalar.object_key("zz", "bkt", strict=False) == "zz"
    with pytest.raises(ValueError):
        scalar.object_key("zz", "bkt")
    assert scalar.human_bytes(1536) == "1.5 KB" and scalar.millis_to_ns(5) == 5_000_000
    assert spark.range(1).select(scalar.time_bucket(F.lit(-1))).first()[0] == "1969-12-31-23"


def test_plans(spark, ev):
    text = dedup(ev([(1, 1)]))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in text


# -- names that dashboards read ---------------------------------------------------------
#: The metrics of the dashboard's panels.
PANELS = ("events_ingested_total", "kafka_consumer_lag", "flush_duration_seconds", "query_duration_seconds", "active_queries", "files_active", "cache_hits_total", "cache_misses_total", "rate_limit_rejected_total", "bytes_scanned_total", "backpressure_pauses_total", "buffer_occupancy_ratio")


def test_every_dashboard_metric_is_set(spark, catalog, store, ev, tmp_path):
    """Each panel's metric has a value after ingest, tiering, queries, a refused job and progress of a stream."""
    from types import SimpleNamespace

    from logweir.streaming.ingest import IngestMonitor

    metrics = Metrics()
    for i in range(3):
        flush_events(ev([(1000 * (i + 1), i)]), str(tmp_path / "hot"), catalog, metrics=metrics)
    run_tiering(catalog, store, LifecycleConfig(tier_threshold_days=0), now_ns=lambda: 2500, metrics=metrics)
    q = svc(spark, catalog, cold=ColdCache(store, str(tmp_path / "cache"), metrics=metrics), metrics=metrics)
    for _ in range(2):
        assert len(q.rows(QueryRequest("SELECT * FROM logs", 0, MAX))[0]) == 3
    jobs = JobService(q, str(tmp_path / "jobs"), queue_cap=0)
    with pytest.raises(ApiError):
        jobs.submit(QueryRequest("SELECT 1", 0, MAX))
    monitor = IngestMonitor("s", metrics)
    source = SimpleNamespace(endOffset='{"logs": {"0": 5, "1": 7}}', latestOffset='{"logs": {"0": 9, "1": 7}}', metrics={})
    for n in (100, 50_000, 45_000, 10, 50_000):
        monitor.take(SimpleNamespace(sources=[source], numInputRows=n))
    metrics.observe("flush_duration_seconds", 0.1)
    run_compaction(spark, str(tmp_path / "hot"), catalog, metrics=metrics)
    text = metrics.expose()
    for name in PANELS:
        assert any(line.startswith((name + " ", name + "{", name + "_bucket")) for line in text.splitlines()), name
    assert metrics.value("events_ingested_total", service="svc") == 3 and metrics.value("files_active", tier="cold") == 2
    assert metrics.value("cache_misses_total") == 2 and metrics.value("cache_hits_total") == 2 and metrics.value("rate_limit_rejected_total") == 1
    assert metrics.value("kafka_consumer_lag", partition="0") == 4 and metrics.value("kafka_consumer_lag", partition="1") == 0
    assert metrics.value("backpressure_pauses_total") == 2 and metrics.value("buffer_occupancy_ratio") == 1.0
    assert metrics.value("bytes_scanned_total") > 0 and metrics.value("files_compacting") == 0 and metrics.value("active_queries") == 0


def test_cold_downloads_wait_for_permits(spark, catalog, store, ev, tmp_path):
    """With more cold queries than permits, no more than the permits download at once."""
    flush_events(ev([(1000, 1)]), str(tmp_path / "hot"), catalog)
    assert run_tiering(catalog, store, LifecycleConfig(tier_threshold_days=0), now_ns=lambda: 5000) == 1
    cache = ColdCache(store, str(tmp_path / "cache"))
    lock, now, most = threading.Lock(), [0], [0]

    class Slow:
        def resolve(self, path):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.2)
            with lock:
                now[0] -= 1
                return cache.resolve(path)

    q = svc(spark, catalog, cold=Slow(), cold_concurrency=2)
    threads = [threading.Thread(target=lambda: q.rows(QueryRequest("SELECT * FROM logs", 0, MAX))) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert most[0] == 2
    for bad in ("SELECT nope FROM logs", "SELECT nope FROM logs", "SELECT nope FROM logs"):  # failed plans give permits back
        with pytest.raises(ApiError):
            q.run(QueryRequest(bad, 0, MAX))
    unread = [q.run(QueryRequest("SELECT * FROM logs", 0, MAX)) for _ in range(2)]
    [rows.close() for rows in unread]  # so do results that nobody reads
    assert len(q.rows(QueryRequest("SELECT * FROM logs", 0, MAX))[0]) == 1


def test_first_fill(spark):
    from logweir.sources.synthetic import first_fill

    rows = first_fill(spark, 10**18).collect()
    assert len(rows) == 20 and [r.level for r in rows[:4]] == ["INFO", "WARN", "ERROR", "INFO"] and rows[5].kafka_partition == 1
    assert rows[19].timestamp == 10**18 - 19 * 10**9 and json.loads(rows[2].attributes) == {"request_id": "req-0002", "duration_ms": 14.0, "retries": 2}
    assert json.loads(demo_events(spark, 3).collect()[2].attributes)["request_id"] == "req-000002"


def test_console_page(spark, jobs, tmp_path):
    import urllib.request

    from logweir.service.http import make_server

    server = make_server(jobs.queries, jobs, str(tmp_path), Metrics(), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for path in ("/", "/history/1"):
        got = urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{path}")
        assert got.status == 200 and "<title>logweir</title>" in got.read().decode()
    server.shutdown()
