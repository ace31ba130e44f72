"""Row cap and offset paging."""

from pyspark.sql import DataFrame

DEFAULT_LIMIT = 1000
DEFAULT_PAGE_SIZE = 100


def capped(df: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The server's cap on top of the user's plan; over ORDER BY it plans as TakeOrderedAndProject."""
    return df.limit(limit)


def page(df: DataFrame, number: int = 0, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Zero-based page of an ordered result; a size below 1 counts as 1 (H4)."""
    size = max(1, size)
    return df.offset(max(0, number) * size).limit(size)


def page_slice(rows: list, number: int = 0, size: int = DEFAULT_PAGE_SIZE) -> list:
    size = max(1, size)
    return rows[number * size:(number + 1) * size]
