"""Kafka source: subscribe to one topic from the earliest offset, capped per trigger."""

from dataclasses import dataclass


@dataclass(frozen=True)
class KafkaConfig:
    brokers: str = "localhost:9092"
    topic: str = "logs"
    max_offsets_per_trigger: int = 50_000 * 8


def kafka_options(cfg: KafkaConfig) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": cfg.brokers,
        "subscribe": cfg.topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        "maxOffsetsPerTrigger": str(cfg.max_offsets_per_trigger),
    }


def kafka_stream(spark, cfg: KafkaConfig):
    """Columns value, partition, offset among others. Needs the spark-sql-kafka package on the cluster."""
    return spark.readStream.format("kafka").options(**kafka_options(cfg)).load()
