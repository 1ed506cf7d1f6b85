"""Compression of values and segments: named algorithms, ratios, and the file header of a compressed segment."""

from __future__ import annotations

import gzip
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siltlog.functions.codec import saved_ratio

#: Fixed numbers of the algorithms in a compressed segment's header.
ALGORITHMS = {"none": 0, "zlib": 1, "gzip": 2}
MAGIC, HEADER = b"COMP", 16


def pack(data: bytes, algorithm: str = "zlib", level: int = 6) -> bytes:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return {"none": lambda: data, "zlib": lambda: zlib.compress(data, level), "gzip": lambda: gzip.compress(data, level, mtime=0)}[algorithm]()


def unpack(data: bytes, algorithm: str = "zlib") -> bytes:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return {"none": lambda: data, "zlib": lambda: zlib.decompress(data), "gzip": lambda: gzip.decompress(data)}[algorithm]()


def pack_segment(data: bytes, algorithm: str = "zlib") -> bytes:
    return MAGIC + struct.pack(">BQ3x", ALGORITHMS[algorithm], len(data)) + pack(data, algorithm)


def unpack_segment(raw: bytes) -> bytes:
    if raw[:4] != MAGIC or len(raw) < HEADER:
        raise ValueError("not a compressed segment")
    number, size = struct.unpack(">BQ3x", raw[4:HEADER])
    data = unpack(raw[HEADER:], next(k for k, v in ALGORITHMS.items() if v == number))
    if len(data) != size:
        raise ValueError(f"size mismatch: {len(data)} {size}")
    return data


def compressed(value: Column, algorithm: str = "zlib", level: int = 6) -> Column:
    """Bytes of a binary or string column compressed, in Arrow batches; null stays null."""

    @pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else pack(bytes(v), algorithm, level))

    return run(value.cast("binary"))


def decompressed(value: Column, algorithm: str = "zlib") -> Column:
    @pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unpack(bytes(v), algorithm))

    return run(value)


def zlib_stats(docs: DataFrame) -> DataFrame:
    """Bytes before and after compression and the share saved, by language."""
    sized = docs.select("lang", F.octet_length("text").alias("o"), F.octet_length(compressed(F.col("text"))).alias("c"))
    g = sized.groupBy("lang").agg(F.sum("o").cast("long").alias("original_size"), F.sum("c").cast("long").alias("compressed_size"))
    return g.withColumn("ratio", F.round(saved_ratio(F.col("original_size"), F.col("compressed_size")), 6))
