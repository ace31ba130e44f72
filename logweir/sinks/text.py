"""Text sinks: NDJSON with a trailing statistics line, job results, CSV."""

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row; nulls are kept as keys and every Spark type is written."""
    if not df.columns:
        return df.select(F.lit("{}").alias("value"))
    # Positional names keep columns with equal names apart until the JSON is made.
    names = [f"_c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    body = F.struct(*[F.col(n).alias(c) for n, c in zip(names, df.columns)])
    return plain.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def ndjson(df: DataFrame) -> Iterator[str]:
    """Rows as JSON lines, a partition at a time."""
    for row in json_rows(df).toLocalIterator(prefetchPartitions=True):
        yield row[0]


def write_result(lines: Iterator[str], path: str) -> int:
    """Job result file, moved into place when whole; returns its number of rows."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    n = 0
    with open(f"{path}.part", "w", encoding="utf-8") as out:
        for line in lines:
            out.write(line + "\n")
            n += 1
    os.replace(f"{path}.part", path)
    return n


def read_result(path: str) -> list[dict]:
    """Rows of a result file; empty and broken lines are skipped, a missing file is empty."""
    rows = []
    try:
        with open(path, encoding="utf-8") as src:
            for line in src:
                try:
                    if line.strip():
                        rows.append(json.loads(line))
                except ValueError:
                    continue
    except FileNotFoundError:
        return []
    return rows


def csv_lines(columns: list[str], rows: list[dict]) -> Iterator[str]:
    """CSV: quoted header, strings quoted with doubled quotes, null empty."""
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    cell = lambda v: "" if v is None else quote(v) if isinstance(v, str) else json.dumps(v) if isinstance(v, (bool, int, float)) else quote(json.dumps(v))
    yield ",".join(quote(c) for c in columns)
    for row in rows:
        yield ",".join(cell(row.get(c)) for c in columns)


def csv_column(df: DataFrame) -> DataFrame:
    """The same rule as a column, for exports too large for the driver."""
    kinds = dict(df.dtypes)
    cells = []
    for c in df.columns:
        text = F.col(c).cast("string") if kinds[c] not in ("string",) else F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.coalesce(text, F.lit("")))
    return df.select(F.concat_ws(",", *cells).alias("value"))
