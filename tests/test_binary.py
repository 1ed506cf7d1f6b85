import struct
import zlib

import pytest
from pyspark.sql import functions as F

from siltlog.functions.codec import decode_record, encode_record
from siltlog.sources import binary


def record(key: bytes, value: bytes, ts=1234567890, gone=False):
    head = struct.pack(">IBQIQB", 0xCAFEBABE, 1, ts, len(key), len(value), int(gone))
    return head + struct.pack(">I", zlib.crc32(head + key + value)) + key + value


def test_encode_matches_the_layout(spark):
    df = spark.createDataFrame([("k", "välue", 5, False), ("", "", 2**40, False), ("gone", None, 7, True)], "k string, v string, t long, g boolean")
    got = [bytes(r[0]) for r in df.select(encode_record(F.col("k"), F.col("v"), F.col("t"), F.col("g"))).collect()]
    assert got == [record(b"k", "välue".encode(), 5), record(b"", b"", 2**40), record(b"gone", b"", 7, True)]
    back = df.select(decode_record(encode_record(F.col("k"), F.col("v"), F.col("t"), F.col("g"))).alias("r")).select("r.*").collect()
    assert [(r.key, r.value, r.ts_ms, r.is_tombstone, r.ok) for r in back] == [("k", "välue", 5, False, True), ("", "", 2**40, False, True), ("gone", None, 7, True, True)]


def test_segments_are_framed_to_the_torn_tail(spark, tmp_path):
    (tmp_path / "1.data").write_bytes(record(b"a", b"1") + record(b"b", b"", gone=True) + b"garbage")
    (tmp_path / "2.data").write_bytes(record(b"c", b"3")[:-1] + b"x")
    (tmp_path / "3.data").write_bytes(b"")
    (tmp_path / "notes.data").write_bytes(b"zz")
    rows = {(r.segment_id, r.offset): r for r in binary.read_segments(spark, str(tmp_path)).collect()}
    assert len(rows) == 4
    assert rows[1, 0].value == "1" and rows[1, 32].is_tombstone and rows[1, 63].status == "incomplete_header 7"
    assert rows[2, 0].crc_ok is False


def test_hints_round_trip(spark, tmp_path):
    entries = [(1, 0, 50, 1234567890, False, "key1"), (1, 50, 60, 1234567891, False, "🔑_ключ"), (1, 110, 40, 1234567892, True, "")]
    raw = binary.pack_hints(entries)
    assert raw[:9] == bytes.fromhex("cafebabe0100000003") and len(binary.pack_hints([])) == 13
    (tmp_path / "1.hint").write_bytes(raw)
    assert [tuple(r) for r in binary.read_hints(spark, str(tmp_path)).collect()] == [(s, o, n, t, g, k) for s, o, n, t, g, k in entries]
    with pytest.raises(ValueError, match="invalid_magic DEADBEEF"):
        list(binary.frame_hints(bytes.fromhex("deadbeef") + raw[4:]))
    with pytest.raises(ValueError, match="incomplete_header 9"):
        list(binary.frame_hints(raw[:9]))


def test_wal_stops_at_corruption(spark, tmp_path):
    good = binary.pack_wal(1, 5, {"key": "key1", "value": "value1"}) + binary.pack_wal(2, 6, {"key": "key2"})
    bad = bytearray(binary.pack_wal(5, 7, {"timestamp": 123456}))
    bad[-1] ^= 1
    (tmp_path / "wal.log").write_bytes(good + bytes(bad) + binary.pack_wal(1, 8, {}))
    rows = binary.read_wal(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.type, r.status) for r in rows] == [(1, "ok"), (2, "ok"), (None, "corrupt")]


def test_recovery_takes_hints_and_scans_where_they_fail(spark, tmp_path):
    from siltlog.operators import recovery

    bad = bytearray(record(b"late", b"x"))
    bad[-1] ^= 1
    (tmp_path / "1.data").write_bytes(record(b"a", b"1") + record(b"b", b"2"))
    (tmp_path / "2.data").write_bytes(record(b"a", b"", gone=True) + bytes(bad) + record(b"after", b"y"))
    (tmp_path / "3.data").write_bytes(record(b"c", b"3"))
    (tmp_path / "4.data").write_bytes(b"text only")
    (tmp_path / "1.hint").write_bytes(binary.pack_hints([(1, 0, 32, 5, False, "a"), (1, 32, 32, 5, False, "b")]))
    (tmp_path / "3.hint").write_bytes(b"\xca\xfe\xba")
    states = {r.segment_id: (r.entries, r.status) for r in binary.hint_states(spark, str(tmp_path)).collect()}
    assert states == {1: (2, "ok"), 3: (0, "incomplete_header 3")}
    got = {r.key: (r.segment_id, r.offset, r.size, r.is_tombstone) for r in recovery.recover(spark, str(tmp_path)).collect()}
    assert got == {"a": (2, 0, 31, True), "b": (1, 32, 32, False), "c": (3, 0, 32, False)}
    records = binary.read_segments(spark, str(tmp_path))
    assert {r.segment_id: r.first_bad for r in recovery.failed_segments(records).collect()} == {2: 31, 4: 0}
    assert {r.segment_id: (r.kept, r.truncate_at) for r in recovery.torn_tail(records).collect()} == {1: (2, 64), 2: (1, 31), 3: (1, 32)}
    assert binary.read_record(spark, str(tmp_path / "1.data"), 32).first().key == "b"


@pytest.mark.parametrize(("at", "byte"), [(0, 0), (4, 9), (5, 0xFF), (26, None), (30, None)])
def test_a_record_holds_only_whole(spark, tmp_path, at, byte):
    """Magic, version, time, check sum, key."""
    from siltlog.operators import recovery

    raw = bytearray(record(b"key", b"value"))
    raw[at] = raw[at] ^ 1 if byte is None else byte
    if at in (4, 5):  # with a check sum that fits
        raw[26:30] = struct.pack(">I", zlib.crc32(bytes(raw[:26] + raw[30:])))
    (tmp_path / "1.data").write_bytes(bytes(raw))
    assert [r.is_valid for r in recovery.validate(binary.read_segments(spark, str(tmp_path))).collect()] == [False]
