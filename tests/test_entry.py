import __spark_entry__ as e
import duckdb
import pytest

from logweir.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert e.entry(spark).columns == ["service", "n"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, duck, name):
    got = e.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda row: tuple(round(v, 4) if isinstance(v, float) else str(v) for v in row)
    ours = sorted(plain(tuple(r[c] for c in cols)) for r in got.collect())
    theirs = sorted(plain(r) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM want").fetchall())
    assert ours == theirs


def test_compaction_and_scan_over_all_partitions(spark):
    """No partition is left out, each offset is there once, and rows come by timestamp."""
    rows = e.queries()["compacted_output"](spark, SF).collect()
    scan = e.queries()["raw_scan"](spark, SF).collect()
    keys = [(r.kafka_partition, r.kafka_offset) for r in rows]
    assert {k for k, _ in keys} == {0, 1, 2, 3} and len(keys) == len(set(keys))
    assert set(keys) == {(r.kafka_partition, r.kafka_offset) for r in scan} and len(scan) > len(rows)
    assert [r.timestamp for r in rows] == sorted(r.timestamp for r in rows)
