import pytest

from siltlog.store import Store


def test_verbs(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.get("key1") is None
    s.put("key1", "value1")
    assert s.get("key1") == "value1"
    s.delete("key1")
    s.delete("never")
    assert s.get("key1") is None
    assert s.batch_put([("key2", "x"), ("key3", "value3"), ("key2", "value2")]) == 3
    assert [(r.key, r.value) for r in s.range("key2", "key3").collect()] == [("key2", "value2"), ("key3", "value3")]
    assert s.batch_put([]) is None
    with pytest.raises(ValueError):
        s.atomic_batch([("put", "k", "v"), ("move", "k")])
    st = s.status()
    assert (st["keydir_size"], st["key_set_size"], st["last_seq"]) == (4, 2, 5)
    assert s.as_of(0).count() == 1
    assert s.multi_get(spark.createDataFrame([("key2",), ("key9",)], "key string")).count() == 1


def test_batches_apply_in_order_and_whole(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.atomic_batch([("put", "a", "1"), ("delete", "a"), ("put", "b", "2"), ("delete", "c"), ("put", "a", "3")])
    assert {r.key: r.value for r in s.range("", "z").collect()} == {"a": "3", "b": "2"}


def test_rotation_and_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), segment_max_bytes=80)
    for i in range(6):
        s.batch_put([("hot", f"v{i}"), (f"key_{i}", "x" * 40)])
    s.delete("key_0")
    before = {r.key: r.value for r in s.range("", "~").collect()}
    parts = len(s.manifest()["parts"])
    stats = s.compact()
    assert stats["segments_merged"] >= 3
    assert {r.key: r.value for r in s.range("", "~").collect()} == before
    assert len(s.manifest()["parts"]) < parts and s.vacuum() > 0
    assert {r.key: r.value for r in s.range("", "~").collect()} == before
    s.put("hot", "last")
    assert s.get("hot") == "last"
