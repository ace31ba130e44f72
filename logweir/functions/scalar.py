"""Scalar functions of the engine, as Column expressions or plain Python for driver work."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def floor_div(ns: Column, by: int) -> Column:
    """Integer division that rounds down for negative values too; never through a double."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(by)), F.lit(by))


def time_bucket(ns: Column) -> Column:
    """UTC hour label ``yyyy-MM-dd-HH`` of nanoseconds since the epoch."""
    return F.date_format(F.timestamp_micros(floor_div(ns, 1000)), "yyyy-MM-dd-HH")


def event_byte_size(attributes="attributes") -> Column:
    """Estimated in-memory bytes of an event (C5): fixed fields, string bytes, attributes by kind."""
    kinds = F.from_json(F.col(attributes), "map<string,variant>")
    each = F.transform(
        F.map_entries(kinds),
        lambda e: F.octet_length(e["key"])
        + F.when(F.schema_of_variant(e["value"]) == "STRING", F.octet_length(e["value"].cast("string")))
        .when(F.schema_of_variant(e["value"]) == "BOOLEAN", F.lit(1))
        .otherwise(F.lit(8)),
    )
    fixed = F.octet_length("level") + F.octet_length("service") + F.octet_length("message") + F.lit(8 + 4 + 8)
    return (fixed + F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(0))).cast("bigint")


def duplicate_density(total: Column, span: Column) -> Column:
    """max(total - span, 0) / total; 0.0 where total or span is not positive."""
    return F.when((total > 0) & (span > 0), F.greatest(total - span, F.lit(0)).cast("double") / total).otherwise(F.lit(0.0))


def density(total: int, span: int) -> float:
    return max(total - span, 0) / total if total > 0 and span > 0 else 0.0


def typed_attribute(name: str, kind: str, attributes="attributes") -> Column:
    return F.get_json_object(F.col(attributes), f"$.{name}").cast(kind)


def cold_uri(bucket: str, service: str, time_bucket: str, filename: str) -> str:
    return f"s3://{bucket}/{service}/{time_bucket}/{filename}"


def object_key(uri: str, bucket: str, strict: bool = True) -> str:
    """The key below ``s3://bucket/``; another prefix is an error if strict, else the whole string."""
    prefix = f"s3://{bucket}/"
    if uri.startswith(prefix):
        return uri[len(prefix):]
    if strict:
        raise ValueError(f"{uri} is not below {prefix}")
    return uri


def cache_filename(uri: str) -> str:
    """Flat cache name: no scheme, slashes as underscores."""
    return uri.removeprefix("s3://").replace("/", "_")


def normalise_sql(sql: str) -> str:
    """Trailing semicolons go first, then white space."""
    return sql.rstrip(";").strip()


def millis_to_ns(ms: int) -> int:
    return int(ms) * 1_000_000


def human_bytes(n: int) -> str:
    for unit, scale in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= scale:
            return f"{n / scale:.1f} {unit}"
    return f"{n} B"


def cutoff_ns(now_ns: int, days: float) -> int:
    return now_ns - int(days * DAY_NS)


def cutoff_seconds(now_s: int, grace_s: int) -> int:
    return now_s - grace_s
