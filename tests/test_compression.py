import os

import pytest
from pyspark.sql import functions as F

from siltlog import config
from siltlog.functions import compression as C


@pytest.mark.parametrize("algorithm", C.ALGORITHMS)
def test_segments_round_trip(algorithm):
    for data in (b"", b"repetitive_pattern_" * 1000, os.urandom(1000)):
        assert C.unpack_segment(C.pack_segment(data, algorithm)) == data
    assert C.pack_segment(b"x")[:4] == b"COMP"


def test_broken_segments_and_unknown_algorithms():
    raw = C.pack_segment(b"abc", "none")
    with pytest.raises(ValueError, match="size mismatch"):
        C.unpack_segment(raw + b"d")
    with pytest.raises(ValueError, match="not a compressed"):
        C.unpack_segment(b"data")
    with pytest.raises(ValueError, match="unknown algorithm"):
        C.pack(b"x", "brotli")


def test_columns(spark):
    df = spark.createDataFrame([("a" * 5000,), ("",), (None,)], "v string").withColumn("c", C.compressed(F.col("v")))
    rows = df.select("v", F.octet_length("c").alias("n"), C.decompressed(F.col("c")).cast("string").alias("back")).collect()
    assert [r.back for r in rows] == [r.v for r in rows] and rows[0].n < 100


def test_settings():
    s = config.load({"SILTLOG_SEGMENT_MAX_BYTES": "2048x", "SILTLOG_MERGE_TRIGGER_RATIO": "abc", "SILTLOG_DATA_DIR": "/d"})
    assert (s.segment_max_bytes, s.merge_trigger_ratio, s.data_dir, s.cache_ttl_seconds) == (2048, 0.3, "/d", 300)
