"""The operation log: one row per put or delete, in the order of ``seq``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltlog.functions.codec import record_size

OPLOG = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("transaction_id", T.LongType()),
    T.StructField("segment_id", T.IntegerType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("is_tombstone", T.BooleanType(), False),
    T.StructField("record_size", T.LongType(), False),
])

#: Records a segment and operations a transaction, where a log is made of the events table.
SEGMENT_ROWS, TXN_OPS = 100, 7


def from_events(events: DataFrame) -> DataFrame:
    """The events table as a log: a user is a key, an ``error`` event deletes it, any other puts it. Narrow: filters on seq reach the scan."""
    gone = F.col("event_type") == "error"
    key = F.concat(F.lit("user_"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    out = events.select(
        F.col("event_id").alias("seq"),
        (F.floor(F.col("event_id") / SEGMENT_ROWS) + 1).cast("int").alias("segment_id"),
        (F.floor(F.col("event_id") / TXN_OPS) + 1).cast("long").alias("txn_id"),
        key.alias("key"),
        gone.alias("is_tombstone"),
        F.when(~gone, F.concat(F.col("event_type"), F.lit(":"), F.col("props"))).alias("value"),
        "ts",
    )
    return out.withColumn("record_size", record_size("key", "value"))


def load(spark: SparkSession, sf_dir: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """The log of a folder's events. Bounds of keys become bounds of users that reach the scan; the keys' own filter is still to be applied."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = [re.fullmatch(r"user_(\d{6})", x or "") for x in (low, high)]
    if all(ends):
        user, (a, b) = F.col("user_id"), (int(x[1]) for x in ends)
        events = events.where(user.between(a, b) | (user < 0) | (user > 999_999))  # keys of others aren't padded numbers
    return from_events(events)


def with_previous(log: DataFrame, *cols: str, every: int = 1_000_000) -> DataFrame:
    """Adds ``previous``, a struct of these columns of the key's record before.

    A key is sorted in stretches of ``every`` sequence numbers; the last record of each stretch is an aggregate and is carried on to the next one.
    """
    x = log.withColumn("_b", F.floor(F.col("seq") / every)).withColumn("_row", F.struct(*cols))
    lasts = x.groupBy("key", "_b").agg(F.max_by("_row", "seq").alias("_last"))
    carry = lasts.select("key", "_b", F.lag("_last").over(W.partitionBy("key").orderBy("_b")).alias("_carry"))
    own = x.withColumn("_own", F.lag("_row").over(W.partitionBy("key", "_b").orderBy("seq")))
    return own.join(carry, ["key", "_b"]).withColumn("previous", F.coalesce("_own", "_carry")).drop("_b", "_row", "_own", "_carry")


def with_offsets(log: DataFrame) -> DataFrame:
    """Adds ``off``, the place of a record in its segment: the bytes of those before it. Segments are bounded, so a window each is."""
    before = W.partitionBy("segment_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return log.withColumn("off", F.coalesce(F.sum("record_size").over(before), F.lit(0)).cast("long"))


def with_rank(log: DataFrame) -> DataFrame:
    """Adds ``rnk``, the record's number in the whole log from 1.

    Numbers within segments are windows of their own, and so are the segments of a stretch of 4,096; only the counts of stretches meet in one task.
    """
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = log.groupBy("segment_id").agg(F.count("*").alias("_n")).withColumn("_g", F.floor(F.col("segment_id") / 4096))
    stretches = counts.groupBy("_g").agg(F.sum("_n").alias("_n")).select("_g", before(W.orderBy("_g")).alias("_base"))
    within = counts.withColumn("_in", before(W.partitionBy("_g").orderBy("segment_id")))
    first = within.join(stretches, "_g").select("segment_id", (F.col("_base") + F.col("_in")).alias("_before"))
    numbered = log.withColumn("_r", F.row_number().over(W.partitionBy("segment_id").orderBy("seq")))
    return numbered.join(first, "segment_id").withColumn("rnk", (F.col("_before") + F.col("_r")).cast("long")).drop("_before", "_r")


def active_segment(log: DataFrame) -> DataFrame:
    return log.agg(F.max("segment_id").alias("a"))


def closed(log: DataFrame) -> DataFrame:
    """Records of all segments but the one being written."""
    return log.where(F.col("segment_id") < active_segment(log).scalar())
