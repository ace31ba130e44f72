"""The event schema, payload decoding and the ``logs`` relation over test events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("kafka_partition", T.IntegerType(), False),
        T.StructField("kafka_offset", T.LongType(), False),
        T.StructField("attributes", T.StringType(), False),
    ]
)
COLUMNS = LOG_SCHEMA.fieldNames()
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
PAYLOAD_DDL = "timestamp bigint, level string, service string, message string, kafka_partition int, kafka_offset bigint, attributes map<string,variant>"


def attribute_kind(value: Column) -> Column:
    """String, Int, Float or Bool for a variant; null for kinds that events may not hold."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "String")
        .when(kind == "BIGINT", "Int")
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "Float")
        .when(kind == "BOOLEAN", "Bool")
    )


def decode_payload(df: DataFrame, value: str = "value", partition: str | None = None, offset: str | None = None) -> DataFrame:
    """Parse JSON payloads into LOG_SCHEMA plus ``valid``.

    A payload is valid when all seven keys are there, the level is one of the
    four upper-case names and no attribute is null or nested. The message's own
    partition and offset, if given, replace those of a valid payload.
    """
    text = F.col(value).cast("string")
    e = F.from_json(text, PAYLOAD_DDL)
    parsed = df.withColumn("_e", e).withColumn("_raw", F.get_json_object(text, "$.attributes"))
    kinds_ok = F.forall(F.map_values("_e.attributes"), lambda v: attribute_kind(v).isNotNull())
    present = F.lit(True)
    for name in COLUMNS:
        present = present & F.col(f"_e.{name}").isNotNull()
    valid = F.coalesce(present & F.col("_e.level").isin(*LEVELS) & kinds_ok, F.lit(False))
    out = {name: F.col(f"_e.{name}") for name in COLUMNS[:-1]} | {"attributes": F.col("_raw")}
    if partition:
        out["kafka_partition"] = F.col(partition).cast("int")
    if offset:
        out["kafka_offset"] = F.col(offset).cast("bigint")
    return parsed.select(*[c.alias(n) for n, c in out.items()], valid.alias("valid"), text.alias("payload"))


def split_rejects(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events in LOG_SCHEMA, rejected payloads)."""
    return decoded.filter("valid").select(*COLUMNS), decoded.filter("NOT valid").select("payload")


def encode_payload(df: DataFrame) -> DataFrame:
    """Events to JSON payloads with ``attributes`` as an object (inverse of decode_payload)."""
    body = F.struct(*COLUMNS[:-1], F.parse_json("attributes").alias("attributes"))
    return df.select(F.to_json(body).alias("value"))


def logs_from_events(events: DataFrame, replays: bool = True) -> DataFrame:
    """``logs`` rows from the test table ``events``; each tenth event is replayed 1 ns later."""
    base = events.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"),
        F.expr("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END").alias("level"),
        F.col("event_type").alias("service"),
        F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        (F.col("user_id") % 4).cast("int").alias("kafka_partition"),
        F.col("event_id").alias("kafka_offset"),
        F.col("props").alias("attributes"),
    )
    if not replays:
        return base
    # One scan: every row yields itself and, for each tenth, its replay.
    shift = F.when(F.col("kafka_offset") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = base.withColumn("_shift", F.explode(shift))
    return both.withColumn("timestamp", F.col("timestamp") + F.col("_shift")).select(*COLUMNS)
