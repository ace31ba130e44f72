"""Direct push: one event, validated on the driver, flushed at once (A4, M8)."""

import json

from logweir.catalog import Catalog
from logweir.schema import COLUMNS, LEVELS, LOG_SCHEMA
from logweir.sinks.flush import flush_events


class BadEvent(ValueError):
    """The payload can't become an event."""


def event_row(payload: dict) -> tuple:
    """Upper-cases the level; attributes are optional and hold strings, numbers and booleans only."""
    level = str(payload.get("level", "")).upper()
    if level not in LEVELS:
        raise BadEvent(f"unknown level {payload.get('level')!r}")
    attributes = payload.get("attributes", {})
    if not isinstance(attributes, dict) or any(not isinstance(v, (str, bool, int, float)) for v in attributes.values()):
        raise BadEvent("attributes must be an object of strings, numbers and booleans")
    missing = [c for c in COLUMNS if c not in ("level", "attributes") and payload.get(c) is None]
    if missing:
        raise BadEvent(f"missing {', '.join(missing)}")
    return (int(payload["timestamp"]), level, str(payload["service"]), str(payload["message"]), int(payload["kafka_partition"]), int(payload["kafka_offset"]), json.dumps(attributes))


def push(spark, payload: dict, data_dir: str, catalog: Catalog, metrics=None) -> list[int]:
    return flush_events(spark.createDataFrame([event_row(payload)], LOG_SCHEMA), data_dir, catalog, metrics=metrics)
