"""Kafka producer: keyed JSON payloads. Needs the spark-sql-kafka package on the cluster."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.schema import encode_payload


def to_kafka_rows(events: DataFrame, key: str = "service") -> DataFrame:
    """(key, value) rows for a Kafka sink."""
    keyed = events.withColumn("_key", F.col(key))
    return encode_payload(keyed.drop("_key")).select(F.get_json_object("value", f"$.{key}").alias("key"), "value")


def produce(events: DataFrame, brokers: str, topic: str, key: str = "service") -> None:
    to_kafka_rows(events, key).write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()
