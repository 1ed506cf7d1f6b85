"""Each query against its SQL in DuckDB."""

import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from siltlog import catalogue

from .conftest import DATA

SF = str(DATA / "sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(map(repr, (tuple(r) for r in df.select(cols).collect())))
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    assert rows == sorted(map(repr, rel.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_check_sums_are_zlibs(spark):
    from siltlog.plans.oplog import load

    want = {}
    for r in load(spark, SF).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).collect():
        key, value = r.key.encode(), (r.value or "").encode()
        want[r.seq] = zlib.crc32(struct.pack(">IBQIQB", 0xCAFEBABE, 1, r.ms, len(key), len(value), int(r.is_tombstone)) + key + value)
    assert {r.seq: r.crc for r in catalogue.queries()["op_record_crc"](spark, SF).collect()} == want


def test_compressed_sizes_are_zlibs(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        o, c = want.get(r.lang, (0, 0))
        text = (r.text or "").encode()
        want[r.lang] = (o + len(text), c + (len(zlib.compress(text, 6)) if r.text is not None else 0))
    got = {r.lang: (r.original_size, r.compressed_size, r.ratio) for r in catalogue.queries()["op_zlib_stats"](spark, SF).collect()}
    assert got == {k: (o, c, round((o - c) / o, 6)) for k, (o, c) in want.items()}


def test_each_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_is_sorted(spark):
    import __spark_entry__ as e

    keys = [r.key for r in e.entry(spark).collect()]
    assert keys and keys == sorted(keys)
