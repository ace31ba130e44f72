"""Registered queries over the test tables, each with DuckDB SQL for the same rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.scalar import event_byte_size, floor_div, time_bucket, typed_attribute
from logweir.operators import predicates, rollups
from logweir.operators.asof import asof_join
from logweir.operators.dedup import dedup, logs_view
from logweir.operators.paging import capped, page
from logweir.schema import LEVELS, decode_payload, encode_payload, logs_from_events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RAW_SQL = """
WITH base AS (
  SELECT epoch_us(ts) * 1000 AS "timestamp",
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
    event_type AS service, event_type || ' by user ' || CAST(user_id AS VARCHAR) AS message,
    CAST(user_id % 4 AS INTEGER) AS kafka_partition, event_id AS kafka_offset, props AS attributes
  FROM events),
raw AS (SELECT * FROM base UNION ALL SELECT "timestamp" + 1, level, service, message, kafka_partition, kafka_offset, attributes FROM base WHERE kafka_offset % 10 = 0),
logs AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY kafka_partition, kafka_offset ORDER BY "timestamp", level, service, message, attributes) AS _rn FROM raw) WHERE _rn = 1),
files AS (SELECT service, strftime(make_timestamp("timestamp" // 1000), '%Y-%m-%d-%H') AS time_bucket, min("timestamp") AS min_ts, max("timestamp") AS max_ts,
  count(*) AS record_count, min(kafka_offset) AS min_kafka_offset, max(kafka_offset) AS max_kafka_offset FROM raw GROUP BY 1, 2)
"""


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_logs(spark, sf_dir: str) -> DataFrame:
    return logs_from_events(table(spark, sf_dir, "events"))


def logs(spark, sf_dir: str) -> DataFrame:
    return logs_view(raw_logs(spark, sf_dir))


def files(spark, sf_dir: str) -> DataFrame:
    """One synthetic file per service and hour, with its statistics."""
    return rollups.file_rollup(raw_logs(spark, sf_dir))


def register(sql: str, with_logs: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (RAW_SQL if with_logs else "") + sql
        return f

    return add


def spark_sql(name: str, spark_text: str, duck_text: str | None = None, *tables: str):
    """A query given as SQL in both engines over test tables (and ``logs``)."""

    def run(spark, sf_dir):
        text = spark_text
        names = {t: table(spark, sf_dir, t) for t in tables}
        if "{logs}" in text:
            names["logs"] = logs(spark, sf_dir)
        return spark.sql(text, **names)

    QUERIES[name] = run
    duck = (duck_text or spark_text).replace("{", "").replace("}", "")
    ORACLES[name] = (RAW_SQL + duck) if "{logs}" in spark_text else duck


# -- the logs relation (A1, C7, D2, G1, I) and the SQL that clients send (P) ----------
@register('SELECT count(*) AS n, CAST(sum(kafka_offset) AS BIGINT) AS offsets, min("timestamp") AS first_ts FROM logs')
def logs_dedup_count(spark, sf_dir):
    return logs(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("kafka_offset").alias("offsets"), F.min("timestamp").alias("first_ts"))


@register('SELECT * FROM logs ORDER BY "timestamp", kafka_partition, kafka_offset LIMIT 1000')
def logs_select_all_capped(spark, sf_dir):
    return capped(logs(spark, sf_dir).orderBy("timestamp", "kafka_partition", "kafka_offset"))


@register("SELECT service, count(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY service")
def errors_by_service(spark, sf_dir):
    return logs(spark, sf_dir).filter("level = 'ERROR'").groupBy("service").agg(F.count("*").alias("n"))


UPPER = 1_705_500_000_000_000_000


@register(f'SELECT * FROM logs WHERE "timestamp" <= {UPPER}')
def logs_where_upper_ts(spark, sf_dir):
    return logs_view(raw_logs(spark, sf_dir), upper_ns=UPPER)


@register('SELECT message, "timestamp" FROM logs')
def logs_projection_dedup(spark, sf_dir):
    return logs(spark, sf_dir).select("message", "timestamp")


@register("SELECT kafka_offset FROM logs ORDER BY kafka_offset LIMIT 100")
def logs_order_limit(spark, sf_dir):
    return logs(spark, sf_dir).select("kafka_offset").orderBy("kafka_offset").limit(100)


@register("SELECT * FROM logs WHERE service = 'purchase'")
def logs_where_service(spark, sf_dir):
    return logs(spark, sf_dir).filter("service = 'purchase'")


@register('SELECT "timestamp", kafka_offset FROM logs ORDER BY "timestamp", kafka_offset OFFSET 200 LIMIT 100')
def page_2_of_results(spark, sf_dir):
    return page(logs(spark, sf_dir).select("timestamp", "kafka_offset").orderBy("timestamp", "kafka_offset"), 2, 100)


@register("SELECT * FROM raw")
def raw_scan(spark, sf_dir):
    """The scan of all rows, replays too."""
    return raw_logs(spark, sf_dir)


@register('SELECT level, service, message, kafka_partition, kafka_offset, "timestamp", attributes FROM logs ORDER BY "timestamp"')
def compacted_output(spark, sf_dir):
    """What compaction writes, over all rows: each offset once, by timestamp."""
    return dedup(raw_logs(spark, sf_dir)).orderBy("timestamp")


# -- file statistics, pruning, compaction and lifecycle decisions ---------------------
@register("SELECT * FROM files")
def file_rollup_by_bucket(spark, sf_dir):
    return files(spark, sf_dir)


BUCKET_SQL = """, slices AS (SELECT kafka_offset // 1000 AS slice, kafka_partition, min(kafka_offset) AS lo, max(kafka_offset) AS hi, count(*) AS record_count FROM raw GROUP BY 1, 2)
SELECT slice, count(*) AS file_count, CAST(sum(record_count) AS BIGINT) AS total_records, max(hi) - min(lo) + 1 AS offset_span,
 CASE WHEN sum(record_count) > 0 AND max(hi) - min(lo) + 1 > 0 THEN CAST(greatest(sum(record_count) - (max(hi) - min(lo) + 1), 0) AS DOUBLE) / sum(record_count) ELSE 0.0 END AS density
FROM slices GROUP BY slice"""


def slices(spark, sf_dir):
    parted = raw_logs(spark, sf_dir).withColumn("slice", floor_div(F.col("kafka_offset"), 1000))
    return rollups.file_rollup(parted, ("slice", "kafka_partition"))


@register(BUCKET_SQL)
def bucket_stats_density(spark, sf_dir):
    return rollups.bucket_stats(slices(spark, sf_dir), "slice")


@register(f"SELECT * FROM ({BUCKET_SQL[BUCKET_SQL.index('SELECT slice, count'):]}) WHERE file_count >= 10 OR density >= 0.09")
def compaction_due(spark, sf_dir):
    return rollups.due_buckets(rollups.bucket_stats(slices(spark, sf_dir), "slice"), 10, 0.09)


ORACLES["compaction_due"] = RAW_SQL + BUCKET_SQL.split("\nSELECT slice, count")[0] + "\n" + ORACLES["compaction_due"][len(RAW_SQL):]


@register("SELECT service, substr(time_bucket, 1, 10) AS day, count(*) AS file_count FROM files GROUP BY 1, 2 HAVING count(*) >= 20")
def compactable_buckets(spark, sf_dir):
    day = F.substring("time_bucket", 1, 10).alias("day")
    return files(spark, sf_dir).groupBy("service", day).agg(F.count("*").alias("file_count")).filter(predicates.COMPACTABLE.format(count="file_count", least=20))


@register(f"SELECT CASE WHEN max_ts < {UPPER} THEN 'cold' ELSE 'hot' END AS tier, count(*) AS n FROM files GROUP BY 1")
def tier_counts(spark, sf_dir):
    tier = F.when(F.col("max_ts") < UPPER, "cold").otherwise("hot").alias("tier")
    return files(spark, sf_dir).groupBy(tier).agg(F.count("*").alias("n"))


@register(f"""SELECT CAST(coalesce(sum(record_count) FILTER (WHERE k), 0) AS BIGINT) AS rows_scanned, CAST(coalesce(sum(size_bytes) FILTER (WHERE k), 0) AS BIGINT) AS bytes_scanned,
 count(*) FILTER (WHERE NOT k) AS files_pruned FROM (SELECT *, record_count * 100 AS size_bytes, NOT (max_ts < {UPPER - 10**15} OR min_ts > {UPPER}) AS k FROM files)""")
def pruned_scan_stats(spark, sf_dir):
    return rollups.scan_stats(files(spark, sf_dir).withColumn("size_bytes", F.col("record_count") * 100), UPPER - 10**15, UPPER)


@register(f"SELECT service, time_bucket, max_ts FROM files WHERE NOT (max_ts < {UPPER - 10**14} OR min_ts > {UPPER})")
def files_in_window(spark, sf_dir):
    return rollups.overlapping(files(spark, sf_dir), UPPER - 10**14, UPPER).select("service", "time_bucket", "max_ts")


@register(f"SELECT service, time_bucket, CASE WHEN min_kafka_offset % 2 = 0 THEN 'hot' ELSE 'cold' END AS tier FROM files WHERE (min_kafka_offset % 2 = 0 AND max_ts < {UPPER}) OR (min_kafka_offset % 2 <> 0 AND max_ts < {UPPER - 10**15})")
def expired_files(spark, sf_dir):
    gone = predicates.EXPIRED.format(hot=UPPER, cold=UPPER - 10**15)
    return _stated(spark, sf_dir).filter(gone).select("service", "time_bucket", "tier")


@register(f"SELECT service, time_bucket, CASE WHEN record_count % 3 = 0 THEN 0 ELSE max_ts // 1000000000 END AS superseded_at FROM files WHERE record_count % 3 <> 0 AND max_ts // 1000000000 > 0 AND max_ts // 1000000000 < {UPPER // 10**9 - 600}")
def superseded_past_grace(spark, sf_dir):
    stamp = F.when(F.col("record_count") % 3 == 0, F.lit(0)).otherwise(floor_div(F.col("max_ts"), 1_000_000_000))
    marked = files(spark, sf_dir).withColumns({"superseded_at": stamp, "state": F.lit("superseded")})
    return marked.filter(predicates.PAST_GRACE.format(cutoff=UPPER // 10**9 - 600)).select("service", "time_bucket", "superseded_at")


# -- scalar functions -----------------------------------------------------------------
@register("SELECT kafka_offset, 8 + strlen(level) + strlen(service) + strlen(message) + 12 + CAST(coalesce(list_sum(list_transform(json_keys(attributes), lambda k: strlen(k) + 8)), 0) AS BIGINT) AS bytes FROM logs")
def event_bytes(spark, sf_dir):
    return logs(spark, sf_dir).select("kafka_offset", event_byte_size().alias("bytes"))


@register("SELECT kafka_offset, strftime(make_timestamp(\"timestamp\" // 1000), '%Y-%m-%d-%H') AS bucket FROM logs")
def time_bucket_label(spark, sf_dir):
    return logs(spark, sf_dir).select("kafka_offset", time_bucket(F.col("timestamp")).alias("bucket"))


@register("SELECT kafka_offset, upper(lower(level)) AS level, lower(level) IN ('DEBUG', 'INFO', 'WARN', 'ERROR') AS exact FROM logs")
def level_normalise(spark, sf_dir):
    return logs(spark, sf_dir).select("kafka_offset", F.upper(F.lower("level")).alias("level"), F.lower("level").isin(*LEVELS).alias("exact"))


@register("SELECT kafka_offset, CAST(json_extract_string(attributes, '$.k') AS BIGINT) AS k FROM logs")
def attr_typed_extract(spark, sf_dir):
    return logs(spark, sf_dir).select("kafka_offset", typed_attribute("k", "bigint").alias("k"))


@register("SELECT kafka_offset % 5 > 1 AS valid, count(*) AS n, CAST(sum(CASE WHEN kafka_offset % 5 > 1 THEN kafka_offset END) AS BIGINT) AS offsets FROM logs GROUP BY 1")
def rejects_split(spark, sf_dir):
    events = logs(spark, sf_dir).withColumn("attributes", F.when(F.col("kafka_offset") % 5 == 1, F.lit('{"k": null}')).otherwise(F.col("attributes")))
    sent = encode_payload(events.withColumn("level", F.when(F.col("kafka_offset") % 5 == 0, F.lit("info")).otherwise(F.col("level"))))
    got = decode_payload(sent)
    return got.groupBy("valid").agg(F.count("*").alias("n"), F.sum(F.when(F.col("valid"), F.col("kafka_offset"))).alias("offsets"))


# -- dashboards -----------------------------------------------------------------------
@register("SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n, count(*) / 60 AS rate FROM events GROUP BY 1, 2", with_logs=False)
def ingest_rate_per_minute(spark, sf_dir):
    got = rollups.rate_per_second(table(spark, sf_dir, "events"), "ts", "event_type")
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1", with_logs=False)
def latency_p50_p99(spark, sf_dir):
    got = rollups.quantiles(table(spark, sf_dir, "events"), "value", "event_type")
    return got.select("event_type", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@register("SELECT event_type, count(*) FILTER (WHERE value >= 50) AS hits, count(*) FILTER (WHERE value < 50) AS misses, count(*) FILTER (WHERE value >= 50) / count(*) AS ratio FROM events GROUP BY 1", with_logs=False)
def hit_ratio(spark, sf_dir):
    return rollups.hit_ratio(table(spark, sf_dir, "events"), F.col("value") >= 50, "event_type")


@register("""SELECT e.event_id, e.user_id, e.ts, p.ts AS ts_right, p.value AS value_right FROM (SELECT * FROM events WHERE event_type = 'click') e
 ASOF LEFT JOIN (SELECT user_id, max(value) AS value, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""", with_logs=False)
def asof_click_after_view(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value")).withColumn("ts_right", F.col("ts"))
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return asof_join(clicks, views, "user_id", "ts", ["ts_right", "value"]).withColumnRenamed("value", "value_right")


@register("""SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events)""", with_logs=False)
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 1 DAY"), 0).otherwise(1)
    return table(spark, sf_dir, "events").withColumn("f", fresh).select("user_id", "event_id", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))


# -- reachable relational coverage (Q), as the SQL a client would send ----------------
spark_sql("q_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2", None, "lineitem")
spark_sql("q_join_inner", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name", None, "orders", "customer", "nation")
spark_sql("q_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey", None, "customer", "orders")
spark_sql("q_join_right", "SELECT c_custkey, count(o_orderkey) AS n FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey GROUP BY c_custkey", None, "customer", "orders")
spark_sql("q_join_full", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, nc, ns FROM (SELECT c_nationkey, count(*) AS nc FROM {customer} WHERE c_nationkey < 15 GROUP BY 1) FULL OUTER JOIN (SELECT s_nationkey, count(*) AS ns FROM {supplier} WHERE s_nationkey > 8 GROUP BY 1) ON c_nationkey = s_nationkey", None, "customer", "supplier")
spark_sql("q_join_semi", "SELECT c_custkey, c_name FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey", "customer", "orders")
spark_sql("q_join_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey", "customer", "orders")
spark_sql("q_join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}", None, "region", "nation")
spark_sql("q_join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", "supplier")
spark_sql("q_distinct", "SELECT DISTINCT p_brand, p_size FROM {part}", None, "part")
spark_sql("q_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY 1", None, "lineitem")
spark_sql("q_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())", None, "lineitem")
spark_sql("q_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", None, "lineitem")
spark_sql("q_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", None, "orders")
spark_sql("q_filter_agg", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, max(o_totalprice) AS top FROM {orders} GROUP BY 1 HAVING count(*) > 10", None, "orders")
spark_sql("q_rank", "SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE n <= 3", None, "orders")
spark_sql("q_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS first, ntile(4) OVER w AS quarter FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None, "orders")
spark_sql("q_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM {orders}", None, "orders")
spark_sql("q_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", None, "customer", "supplier")
spark_sql("q_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}", None, "customer", "supplier")
spark_sql("q_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", None, "customer", "supplier")
spark_sql("q_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}", None, "customer", "supplier")
spark_sql("q_cte_subquery", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})) SELECT o_custkey, count(*) AS n FROM big GROUP BY 1", None, "orders")
spark_sql("q_correlated_exists", "SELECT count(*) AS n FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", None, "customer", "orders")
spark_sql("q_string_math", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substr(p_type, 1, 3) AS t, replace(p_brand, '#', '-') AS b, round(sqrt(p_retailprice), 4) AS s, p_size % 7 AS m, abs(p_size - 25) AS a FROM {part}", None, "part")
spark_sql("q_date_parts", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM {orders} GROUP BY 1, 2", None, "orders")
spark_sql("q_date_bin", "SELECT CAST(to_unix_timestamp(CAST(ts AS TIMESTAMP)) div 900 * 900 AS BIGINT) AS bin, count(*) AS n FROM {events} GROUP BY 1", "SELECT CAST(epoch_us(ts) // 1000000 // 900 * 900 AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1", "events")
spark_sql("q_regex", "SELECT count(*) AS n FROM {customer} WHERE c_name RLIKE '[0-9]*7$'", "SELECT count(*) AS n FROM customer WHERE regexp_matches(c_name, '[0-9]*7$')", "customer")
spark_sql("q_arrays", "SELECT o_custkey, array_join(array_sort(collect_list(CAST(o_orderkey AS STRING))), ',') AS keys FROM {orders} GROUP BY 1", "SELECT o_custkey, array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR))), ',') AS keys FROM orders GROUP BY 1", "orders")
spark_sql("q_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", "events")
spark_sql("q_case_nulls", "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS urgent, count(nullif(o_orderpriority, '5-LOW')) AS n FROM {orders} GROUP BY 1", "SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, count(nullif(o_orderpriority, '5-LOW')) AS n FROM orders GROUP BY 1", "orders")
spark_sql("q_logs_self_join", "SELECT a.kafka_offset AS first_offset, count(*) AS n FROM {logs} a JOIN {logs} b ON a.message = b.message AND a.kafka_offset < b.kafka_offset GROUP BY 1", None)
spark_sql("q_logs_level_counts", "SELECT level, count(*) AS n, min(kafka_offset) AS first_offset FROM {logs} GROUP BY level", None)
spark_sql("q_except", "SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}", None, "customer", "supplier")
spark_sql("q_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}", None, "customer", "supplier")
spark_sql("q_distinct_on", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM {events}) WHERE n = 1", "SELECT DISTINCT ON (user_id) user_id, event_id, ts FROM events ORDER BY user_id, ts DESC, event_id", "events")
spark_sql("q_qualify", "SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM {orders}) WHERE r <= 5", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) <= 5", "orders")
spark_sql("q_int_division", "SELECT o_orderkey, o_orderkey div 7 AS whole, o_orderkey / 7 AS ratio, -o_orderkey div 7 AS below FROM {orders}", "SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS whole, o_orderkey / 7 AS ratio, CAST(-(o_orderkey // 7) AS BIGINT) AS below FROM orders", "orders")
spark_sql("q_nulls_first_last", "SELECT n, CAST(row_number() OVER (ORDER BY k ASC NULLS LAST, n) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY k DESC NULLS FIRST, n) AS BIGINT) AS down FROM (SELECT o_orderkey AS n, nullif(o_orderkey % 5, 0) AS k FROM {orders})", None, "orders")
spark_sql("q_maps", "SELECT o_custkey, element_at(m, 'F') AS f, element_at(m, 'O') AS o, CAST(size(m) AS BIGINT) AS n FROM (SELECT o_custkey, map_from_entries(collect_list(struct(o_orderstatus, c))) AS m FROM (SELECT o_custkey, o_orderstatus, count(*) AS c FROM {orders} GROUP BY 1, 2) GROUP BY 1)", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN c END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN c END) AS o, count(*) AS n FROM (SELECT o_custkey, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2) GROUP BY 1", "orders")
spark_sql("q_structs", "SELECT o_custkey, top.price AS price, top.key AS key FROM (SELECT o_custkey, max(named_struct('price', o_totalprice, 'key', o_orderkey)) AS top FROM {orders} GROUP BY 1)", "SELECT o_custkey, top.price AS price, top.key AS key FROM (SELECT o_custkey, max({'price': o_totalprice, 'key': o_orderkey}) AS top FROM orders GROUP BY 1)", "orders")
ORACLES["q_structs"] = "SELECT o_custkey, max(o_totalprice) AS price, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS key FROM orders GROUP BY 1"
spark_sql("q_array_higher_order", "SELECT o_custkey, aggregate(filter(keys, k -> k % 2 = 0), 0L, (a, k) -> a + k) AS evens, exists(keys, k -> k % 97 = 0) AS hit, array_contains(keys, 1) AS one FROM (SELECT o_custkey, collect_list(CAST(o_orderkey AS BIGINT)) AS keys FROM {orders} GROUP BY 1)", "SELECT o_custkey, CAST(coalesce(sum(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0), 0) AS BIGINT) AS evens, bool_or(o_orderkey % 97 = 0) AS hit, bool_or(o_orderkey = 1) AS one FROM orders GROUP BY 1", "orders")
spark_sql("q_unnest", "SELECT o_custkey, part, count(*) AS n FROM (SELECT o_custkey, explode(split(o_orderpriority, '-')) AS part FROM {orders}) GROUP BY 1, 2", "SELECT o_custkey, part, count(*) AS n FROM (SELECT o_custkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders) GROUP BY 1, 2", "orders")
# A sketch's value depends on its hashes, so what is compared is its error: five standard deviations, a hundredth of ranks.
spark_sql("q_approx_distinct", "SELECT l_returnflag, abs(approx_count_distinct(l_partkey, 0.02) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS near FROM {lineitem} GROUP BY 1", "SELECT DISTINCT l_returnflag, true AS near FROM lineitem", "lineitem")
spark_sql("q_approx_quantile", "SELECT event_type, percentile_approx(value, 0.99, 10000) BETWEEN percentile(value, 0.98) AND max(value) AS near FROM {events} GROUP BY 1", "SELECT DISTINCT event_type, true AS near FROM events", "events")


# -- joins on ranges of time -----------------------------------------------------------
@register("""SELECT e.event_id, count(*) AS views FROM (SELECT * FROM events WHERE event_type = 'purchase') e JOIN (SELECT * FROM events WHERE event_type = 'view') v
 ON e.user_id = v.user_id AND v.ts BETWEEN e.ts - INTERVAL 1 DAY AND e.ts GROUP BY 1""", with_logs=False)
def q_interval_join(spark, sf_dir):
    """Views in the day before each purchase of the same user: an equi-join by user and day, so no user's rows all meet."""
    events = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("until"), F.explode(F.array("day", F.col("day") - F.expr("INTERVAL 1 DAY"))).alias("day"))
    views = events.filter("event_type = 'view'").select("user_id", "day", "ts")
    met = bought.join(views, ["user_id", "day"]).filter("ts BETWEEN until - INTERVAL 1 DAY AND until")
    return met.groupBy("event_id").agg(F.count("*").alias("views"))


# -- lifecycle predicates as the catalog states them (D4 to D7) ------------------------
@register(f"SELECT service, time_bucket, max_ts FROM files WHERE min_kafka_offset % 2 = 0 AND max_ts < {UPPER}")
def tier_eligible_files(spark, sf_dir):
    return _stated(spark, sf_dir).filter(predicates.TIER_ELIGIBLE.format(cutoff=UPPER)).select("service", "time_bucket", "max_ts")


@register("SELECT service, time_bucket, max_ts FROM files WHERE record_count % 3 = 0 AND min_kafka_offset % 2 = 0 AND service = 'click'")
def bucket_hot_files(spark, sf_dir):
    marked = _stated(spark, sf_dir).withColumn("state", F.when(F.col("record_count") % 3 == 0, "active").otherwise("superseded"))
    return marked.filter(predicates.BUCKET.format(service="'click'", time_bucket="time_bucket")).select("service", "time_bucket", "max_ts")


def _stated(spark, sf_dir):
    """The files with a tier by parity of their first offset, all active."""
    return files(spark, sf_dir).withColumns({"tier": F.when(F.col("min_kafka_offset") % 2 == 0, "hot").otherwise("cold"), "state": F.lit("active"), "superseded_at": F.lit(0).cast("bigint")})
