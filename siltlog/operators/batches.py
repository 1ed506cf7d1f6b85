"""Batches: what a list of operations leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_puts(log: DataFrame) -> DataFrame:
    """Of each transaction the last put of each key."""
    puts = log.where(~F.col("is_tombstone"))
    return puts.groupBy("txn_id", "key").agg(F.max_by("value", "seq").alias("value"))


def last_operations(log: DataFrame) -> DataFrame:
    """Of each transaction the last operation on each key, puts and deletes in the order of the list."""
    x = log.groupBy("txn_id", "key").agg(F.max_by(F.struct("value", "is_tombstone"), "seq").alias("x"))
    return x.select("txn_id", "key", "x.value", "x.is_tombstone")


def status(log: DataFrame) -> DataFrame:
    """Of each transaction how many operations it has, how many can be done (a key, and for a put a value) and whether all can."""
    can = F.col("key").isNotNull() & (F.col("is_tombstone") | F.col("value").isNotNull())
    out = log.groupBy("txn_id").agg(F.count("*").alias("operations"), F.count_if(can).alias("succeeded"), F.count_if(~can).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "ok").when(F.col("succeeded") == 0, "failed").otherwise("partial"))


def report(log: DataFrame) -> DataFrame:
    return log.groupBy(F.when(F.col("is_tombstone"), "delete").otherwise("put").alias("op")).agg(F.count("*").alias("n"))
