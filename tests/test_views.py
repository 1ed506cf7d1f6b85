import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltlog.functions.codec import record_size
from siltlog.operators import caching, maintenance, segments, views

SCHEMA = "seq long, segment_id int, key string, value string, is_tombstone boolean"


def log_of(spark, ops, per_segment=3):
    rows = [(i, i // per_segment + 1, k, v, v is None) for i, (k, v) in enumerate(ops)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("record_size", record_size("key", "value"))


def pairs(df):
    return [(r.key, r.value) for r in df.collect()]


OPS = [("a", "1"), ("b", "2"), ("a", None), ("c", "3"), ("b", "4"), ("é", "5"), ("d", None), ("a", "6")]


def test_last_write_wins_and_deletes_hide(spark):
    log = log_of(spark, OPS)
    assert sorted(pairs(views.live_pairs(log))) == [("a", "6"), ("b", "4"), ("c", "3"), ("é", "5")]
    assert pairs(views.get(log, "d")) == [] == pairs(views.get(log, "absent"))
    assert pairs(views.as_of(log, 3)) != pairs(views.as_of(log, 7))
    assert {r.key for r in views.resurrected(log).collect()} == {"a"}


def test_range_is_inclusive_and_bytewise(spark):
    log = log_of(spark, OPS)
    assert pairs(views.range_scan(log, "a", "c")) == [("a", "6"), ("b", "4"), ("c", "3")]
    assert pairs(views.range_scan(log, "a", "é"))[-1] == ("é", "5")
    assert pairs(views.range_scan(log, "c", "a")) == []


def test_status_counts_tombstones_apart(spark):
    log = log_of(spark, [(f"key_{i}", "v") for i in range(1, 11)] + [("key_2", None), ("key_4", None)])
    r = views.status(log).first()
    assert (r.keydir_size, r.key_set_size) == (10, 8)


def test_empty_log(spark):
    log = log_of(spark, OPS).where("false")
    assert views.live_pairs(log).count() == 0
    assert segments.next_segment(log).first().next_id == 1
    assert maintenance.stale_ratio_index(log).first().stale_ratio == 0.0
    assert caching.memory(log).first()[0] is None


def test_key_filter_reaches_the_scan(spark):
    import io
    from contextlib import redirect_stdout

    from siltlog.plans.oplog import load

    from .conftest import DATA

    out = io.StringIO()
    with redirect_stdout(out):
        views.get(load(spark, str(DATA / "sf0.001")).where("seq > 5"), "user_000001").explain("formatted")
    plan = out.getvalue()
    assert "GreaterThan(event_id,5)" in plan and "Filter" in plan.split("HashAggregate")[-1]


@pytest.mark.parametrize("name", ["op_get", "op_range"])
def test_key_bounds_reach_the_scan(spark, name):
    import io
    from contextlib import redirect_stdout

    from siltlog import catalogue

    from .conftest import DATA

    out = io.StringIO()
    with redirect_stdout(out):
        catalogue.queries()[name](spark, str(DATA / "sf0.001")).explain("formatted")
    pushed = next(x for x in out.getvalue().splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(user_id," in pushed and "LessThanOrEqual(user_id," in pushed


def test_previous_record_over_stretches(spark):
    from siltlog.plans.oplog import with_previous

    log = log_of(spark, [(k, str(i)) for i, k in enumerate("abaacbaabcaaab")])
    last, want = {}, {}
    for r in sorted(log.collect(), key=lambda r: r.seq):
        want[r.seq], last[r.key] = last.get(r.key), r.value
    for every in (1, 3, 1000):
        assert {r.seq: r.previous and r.previous.value for r in with_previous(log, "value", every=every).collect()} == want


def test_rotation_of_large_segments(spark):
    log = spark.range(300_000).select(F.col("id").alias("seq"), (F.col("id") % 50 + 40).alias("record_size"))
    got = segments.rotation(log, 10_000_000, 100_000).groupBy("segment").agg(F.sum("record_size").alias("n")).orderBy("segment").collect()
    assert [r.segment for r in got] == [1, 2] and 10_000_000 <= got[0].n < 10_000_100


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.one_of(st.none(), st.text(min_size=0, max_size=30))), max_size=40), st.integers(31, 200), st.integers(1, 9))
def test_rotation_is_the_greedy_rule(spark, ops, most, chunk):
    log = log_of(spark, ops)
    got = {r.seq: r.segment for r in segments.rotation(log, most, chunk).collect()}
    want, segment, fill = {}, 1, 0
    for r in sorted(log.collect(), key=lambda r: r.seq):
        if fill >= most:
            segment, fill = segment + 1, 0
        want[r.seq], fill = segment, fill + r.record_size
    assert got == want


def test_compaction_keeps_the_live_view(spark):
    log = log_of(spark, OPS)
    active = log.agg(F.max("segment_id")).first()[0]
    kept = maintenance.compacted(log).select("key", "value")
    rest = log.where(F.col("segment_id") == active)
    again = kept.withColumn("seq", F.lit(-1).cast("long")).withColumn("is_tombstone", F.lit(False)).unionByName(rest.select("key", "value", "seq", "is_tombstone"))
    assert sorted(pairs(views.live_pairs(again))) == sorted(pairs(views.live_pairs(log)))
