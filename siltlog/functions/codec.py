"""Expressions over the record format: sizes, check sums, big-endian numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format.
RECORD_MAGIC, RECORD_VERSION, RECORD_HEADER = 0xCAFEBABE, 1, 30
HINT_HEADER, HINT_ENTRY = 13, 27
WAL_MAGIC, WAL_HEADER = 0xDEADBEEF, 22
TOMBSTONE_FLAG = 1


def record_size(key: str, value: str) -> Column:
    """Header, key and value in bytes."""
    return (F.lit(RECORD_HEADER) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def big_endian(number: Column, width: int) -> Column:
    """A number as ``width`` bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * width, "0"))


def number_at(data: Column, at: int, width: int) -> Column:
    """The big-endian number of ``width`` bytes from byte ``at`` (from 0)."""
    return F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("decimal(20,0)").cast("long")


def encode_record(key: Column, value: Column, ts_ms: Column, tombstone: Column) -> Column:
    """A record's bytes: magic, version, time, lengths, flags, check sum over the rest of the header and the payload, key, value."""
    k, v = key.cast("binary"), F.coalesce(F.when(~tombstone, value.cast("binary")), F.lit(b""))
    head = F.concat(
        big_endian(F.lit(RECORD_MAGIC), 4),
        big_endian(F.lit(RECORD_VERSION), 1),
        big_endian(ts_ms, 8),
        big_endian(F.octet_length(k), 4),
        big_endian(F.octet_length(v), 8),
        big_endian(F.when(tombstone, TOMBSTONE_FLAG).otherwise(0), 1),
    )
    return F.concat(head, big_endian(F.crc32(F.concat(head, k, v)), 4), k, v)


def decode_record(data: Column) -> Column:
    """A struct of the fields of one record's bytes and whether the check sum holds; a wrong magic or length gives ``ok`` false."""
    n = number_at(data, 13, 4)
    key = F.call_function("substring", data, F.lit(RECORD_HEADER + 1), n.cast("int"))
    value = F.call_function("substring", data, F.lit(RECORD_HEADER + 1) + n.cast("int"), number_at(data, 17, 8).cast("int"))
    tombstone = number_at(data, 25, 1).bitwiseAND(TOMBSTONE_FLAG) == 1
    whole = F.concat(F.call_function("substring", data, F.lit(1), F.lit(26)), key, value)
    ok = (F.octet_length(data) >= RECORD_HEADER) & (number_at(data, 0, 4) == RECORD_MAGIC) & (F.octet_length(data) == F.lit(RECORD_HEADER) + n + number_at(data, 17, 8)) & (F.crc32(whole) == number_at(data, 26, 4))
    return F.struct(number_at(data, 5, 8).alias("ts_ms"), key.cast("string").alias("key"), F.when(~tombstone, value.cast("string")).alias("value"), tombstone.alias("is_tombstone"), F.coalesce(ok, F.lit(False)).alias("ok"))


def value_size(value: Column) -> Column:
    """Bytes a cached value takes; 64 for what has no size of its own."""
    return F.coalesce(F.octet_length(value), F.lit(64)).cast("long")


def saved_ratio(original: Column, compressed: Column) -> Column:
    """Share of bytes saved; 0.0 for nothing."""
    return F.when(original == 0, 0.0).otherwise((original - compressed).cast("double") / original)
