import datetime as dt

from siltlog.streaming.views import append_batches, expiring


def rows(spark, path, data):
    base = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(k, base + dt.timedelta(seconds=s)) for k, s in data], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def test_micro_batches_reach_the_log(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "log")
    rows(spark, src, [("a", 0), ("b", 1)])
    for _ in range(2):
        append_batches(spark.readStream.schema("key string, ts timestamp").parquet(src), out, str(tmp_path / "ck")).awaitTermination()
        rows(spark, src, [("c", 2)])
    assert spark.read.parquet(out).count() == 3


def test_ttl_hits(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark, src, [("a", 0), ("a", 300), ("a", 601), ("b", 5)])
    q = expiring(spark.readStream.schema("key string, ts timestamp").parquet(src)).writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.key: (r.accesses, r.hits) for r in spark.sql("select key, sum(accesses) accesses, sum(hits) hits from ttl group by key").collect()}
    assert got == {"a": (3, 1), "b": (1, 0)}
