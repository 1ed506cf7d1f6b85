"""Segment, hint and write-ahead files as tables.

Files are read with Spark's ``binaryFile`` source, so any store Spark reads will do; records are framed one after another, so a file is one
task's work (segments have a size limit). Framing runs in Arrow batches; fields are decoded as they are framed.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions.codec import HINT_ENTRY, HINT_HEADER, RECORD_HEADER, RECORD_MAGIC, WAL_HEADER, WAL_MAGIC, big_endian, encode_record

#: Numbers beyond a long are read as its end.
LONG = 2**63 - 1
RECORDS = "segment_id int, offset long, record_size long, ts_ms long, key string, value string, is_tombstone boolean, crc_ok boolean, status string, version int"
HINTS = "segment_id int, offset long, size long, ts_ms long, is_tombstone boolean, key string"
WAL = "offset long, type int, ts_ms long, payload string, status string"


def frame_records(data: bytes) -> Iterator[tuple]:
    """(offset, size, ts_ms, key, value, tombstone, crc_ok, status, version); a bad record ends the file with its status."""
    at = 0
    while at < len(data):
        head = data[at : at + RECORD_HEADER]
        bad = None
        if len(head) < RECORD_HEADER:
            bad = f"incomplete_header {len(head)}"
        else:
            magic, version, ts, n, m, flags, crc = struct.unpack(">IBQIQBI", head)
            if magic != RECORD_MAGIC:
                bad = f"invalid_magic {magic}"
            elif len(data) - at - RECORD_HEADER < n + m:
                bad = f"incomplete_payload {len(data) - at - RECORD_HEADER} {n + m}"
        if bad:
            yield at, len(data) - at, None, None, None, None, None, bad, None
            return
        key, value = data[at + RECORD_HEADER : at + RECORD_HEADER + n], data[at + RECORD_HEADER + n : at + RECORD_HEADER + n + m]
        gone = bool(flags & 1)
        yield at, RECORD_HEADER + n + m, min(ts, LONG), key.decode("utf-8", "replace"), None if gone else value.decode("utf-8", "replace"), gone, zlib.crc32(head[:26] + key + value) == crc, "ok", version
        at += RECORD_HEADER + n + m


def frame_hints(data: bytes) -> Iterator[tuple]:
    if len(data) < HINT_HEADER:
        raise ValueError(f"incomplete_header {len(data)}")
    magic, _, count, _ = struct.unpack(">IBII", data[:HINT_HEADER])
    if magic != RECORD_MAGIC:
        raise ValueError(f"invalid_magic {magic:X}")
    at = HINT_HEADER
    for _ in range(count):
        if len(data) - at < HINT_ENTRY:
            raise ValueError(f"incomplete_entry {len(data) - at}")
        n, segment, offset, size, ts, flags = struct.unpack(">HIQIQB", data[at : at + HINT_ENTRY])
        yield min(segment, LONG >> 32), min(offset, LONG), size, min(ts, LONG), bool(flags & 1), data[at + HINT_ENTRY : at + HINT_ENTRY + n].decode("utf-8", "replace")
        at += HINT_ENTRY + n


def pack_hints(entries: Iterable[tuple]) -> bytes:
    """Bytes of a hint file from (segment_id, offset, size, ts_ms, tombstone, key)."""
    body = [struct.pack(">HIQIQB", len(k := key.encode()), segment, offset, size, ts, int(gone)) + k for segment, offset, size, ts, gone, key in entries]
    return struct.pack(">IBII", RECORD_MAGIC, 1, len(body), 0) + b"".join(body)


def frame_wal(data: bytes) -> Iterator[tuple]:
    """Entries in order with JSON payloads; a corrupt one is reported and ends the replay."""
    at = 0
    while at < len(data):
        head = data[at : at + WAL_HEADER]
        if len(head) < WAL_HEADER:
            yield at, None, None, None, "incomplete_header"
            return
        magic, _, kind, ts, size, crc = struct.unpack(">IBBQII", head)
        payload = data[at + WAL_HEADER : at + WAL_HEADER + size]
        if magic != WAL_MAGIC or len(payload) < size or zlib.crc32(payload) != crc:
            yield at, None, None, None, "corrupt"
            return
        yield at, kind, min(ts, LONG), payload.decode("utf-8", "replace"), "ok"
        at += WAL_HEADER + size


def pack_wal(kind: int, ts_ms: int, payload: dict) -> bytes:
    body = json.dumps(payload, sort_keys=True).encode()
    return struct.pack(">IBBQII", WAL_MAGIC, 1, kind, ts_ms, len(body), zlib.crc32(body)) + body


KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def framed(raw: DataFrame, frame: Callable, schema: str) -> DataFrame:
    """Rows of ``frame(number, bytes)`` for each (n, content), some thousands at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([(x.split(" ")[0], KINDS[x.split(" ")[1]]) for x in schema.split(", ")])
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = iter(frame(n, data.as_py()))
                while some := list(islice(rows, 8192)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), fields, strict=True)], schema=fields)

    return raw.mapInArrow(run, schema)


def contents(spark: SparkSession, path: str, ending: str, numbered: bool = True) -> DataFrame:
    """(n, content) of the files with an ending; n is the number in their name, other names are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(path)
    number = F.expr(r"try_cast(regexp_extract(path, '([0-9]+)\\.[a-z]+$', 1) as int)")
    return raw.select((number if numbered else F.lit(0)).alias("n"), "content").where("n is not null")


def scan(raw: DataFrame) -> DataFrame:
    """The records in the bytes of segments (n, content), one segment a row. A broken end is a row with its status."""
    return framed(raw, lambda n, data: ((n, *r) for r in frame_records(data)), RECORDS)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ``N.data`` files; other names are left out. A file's broken end is a row with its status."""
    return scan(contents(spark, path, ".data"))


def read_record(spark: SparkSession, path: str, offset: int) -> DataFrame:
    """The record at an offset of one segment file."""
    return read_segments(spark, path).where(F.col("offset") == offset)


def hint_rows(n: int, data: bytes) -> list[tuple]:
    """The entries of a hint file; none of a broken one, so that its segment is scanned."""
    try:
        return list(frame_hints(data))
    except ValueError:
        return []


def hint_state(n: int, data: bytes) -> list[tuple]:
    try:
        return [(n, sum(1 for _ in frame_hints(data)), "ok")]
    except ValueError as e:
        return [(n, 0, str(e))]


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all whole ``N.hint`` files."""
    return framed(contents(spark, path, ".hint"), hint_rows, HINTS)


def hint_states(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, entries, status ('ok' or what is wrong) of each hint file."""
    return framed(contents(spark, path, ".hint"), hint_state, "segment_id int, entries long, status string")


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    return framed(contents(spark, path, ".log", numbered=False), lambda n, data: frame_wal(data), WAL)


def encoded(log: DataFrame) -> DataFrame:
    """seq, segment_id and the bytes of each record of a log."""
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    return log.select("seq", "segment_id", encode_record(F.col("key"), F.col("value"), ts, F.col("is_tombstone")).alias("record"))


def segment_bytes(log: DataFrame, fault: Column | None = None) -> DataFrame:
    """(n, content): the bytes of each segment of a log, its records in the order of ``seq``. Records of which ``fault`` holds get a wrong check sum."""
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    record = encode_record(F.col("key"), F.col("value"), ts, F.col("is_tombstone"))
    if fault is not None:
        last = F.call_function("substring", record, F.lit(RECORD_HEADER), F.lit(1))
        other = big_endian(F.conv(F.hex(last), 16, 10).cast("int").bitwiseXOR(F.lit(1)), 1)
        record = F.when(fault, F.concat(F.call_function("substring", record, F.lit(1), F.lit(RECORD_HEADER - 1)), other, F.call_function("substring", record, F.lit(RECORD_HEADER + 1), F.octet_length(record)))).otherwise(record)
    rows = log.select("segment_id", F.struct("seq", F.hex(record).alias("hex")).alias("r"))
    whole = rows.groupBy("segment_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return whole.select(F.col("segment_id").alias("n"), F.unhex(F.array_join("r.hex", "")).alias("content"))
