"""A value cache, simulated over the log of accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltlog.functions.codec import value_size
from siltlog.operators.views import keydir, live_pairs
from siltlog.plans.oplog import with_previous


def ttl_hits(log: DataFrame, seconds: int = 300) -> DataFrame:
    """An access hits if the key's last one is at most so old; expiry is strict."""
    age = F.col("ts") - F.col("previous.ts") <= F.expr(f"INTERVAL '{seconds}' SECOND")
    return with_previous(log.select("key", "seq", "ts"), "ts").withColumn("hit", F.coalesce(age, F.lit(False))).agg(F.count("*").alias("accesses"), F.count_if("hit").alias("hits"))


def hit_rate(log: DataFrame, seconds: int = 300) -> DataFrame:
    return ttl_hits(log, seconds).select(F.when(F.col("accesses") == 0, 0.0).otherwise(F.col("hits").cast("double") / F.col("accesses")).alias("hit_rate"))


def _ends(log: DataFrame, n: int, newest: bool, name: str) -> DataFrame:
    last = log.groupBy("key").agg(F.max("seq").alias("last"))
    order = F.desc("last") if newest else F.asc("last")
    few = last.orderBy(order).limit(n)  # a top-n: the window below has n rows
    return few.select("key", F.row_number().over(W.orderBy(order)).cast("long").alias(name))


def most_recent(log: DataFrame, n: int = 10) -> DataFrame:
    return _ends(log, n, True, "recency")


def evicted_first(log: DataFrame, n: int = 10) -> DataFrame:
    return _ends(log, n, False, "eviction_rank")


def bounded(log: DataFrame, capacity: int = 100) -> DataFrame:
    """A cache of the values last written, of which only the ``capacity`` most recent are held: what it holds, has evicted, was told."""
    live = keydir(log.select("key", "seq", "segment_id", "value", "is_tombstone")).where(~F.col("is_tombstone"))
    size = live.orderBy(F.desc("seq")).limit(capacity).agg(F.sum(value_size(F.col("value"))).cast("long").alias("bytes")).scalar()
    n = live.agg(F.count("*").alias("n")).scalar()
    told = log.agg(F.count_if(~F.col("is_tombstone")).alias("puts"), F.count_if("is_tombstone").alias("deletes"))
    return told.select(F.least(n, F.lit(capacity)).cast("long").alias("entries"), F.greatest(n - capacity, F.lit(0)).cast("long").alias("evicted"), "puts", "deletes", size.alias("bytes"))


def memory(log: DataFrame) -> DataFrame:
    return live_pairs(log).agg(F.sum(value_size(F.col("value"))).cast("long").alias("bytes"))
