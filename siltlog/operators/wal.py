"""The write-ahead log: entries, replay, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.operators.views import live_pairs
from siltlog.plans.oplog import TXN_OPS, with_rank

#: Fixed entry types.
PUT, DELETE, BATCH_START, BATCH_END, CHECKPOINT = 1, 2, 3, 4, 5


def whole_batches(log: DataFrame) -> DataFrame:
    return log.groupBy("txn_id").agg(F.count("*").alias("batch_size")).where(F.col("batch_size") == TXN_OPS)


def wal_entries(log: DataFrame) -> DataFrame:
    """Start, operations and (for whole batches) end of each transaction."""
    no_key, no_size = F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("batch_size")
    start = log.select("txn_id").distinct().select(F.lit(BATCH_START).alias("type"), "txn_id", no_key, no_size)
    ops = log.select(F.when(F.col("is_tombstone"), DELETE).otherwise(PUT).alias("type"), "txn_id", "key", no_size)
    end = whole_batches(log).select(F.lit(BATCH_END).alias("type"), "txn_id", no_key, "batch_size")
    return start.unionByName(ops).unionByName(end)


def replay(log: DataFrame) -> DataFrame:
    """The live view after applying whole batches only."""
    return live_pairs(log.join(whole_batches(log).select("txn_id"), "txn_id", "left_semi"))


def replay_stats(log: DataFrame) -> DataFrame:
    """Entries applied, and those of batches without an end, which count as errors."""
    sizes = log.groupBy("txn_id").agg(F.count("*").alias("n"))
    sums = lambda whole: F.coalesce(F.sum(F.when((F.col("n") == TXN_OPS) == whole, F.col("n"))), F.lit(0)).cast("long")
    return sizes.agg(sums(True).alias("entries"), sums(False).alias("errors"))


def checkpoints(log: DataFrame, every: int = 1000) -> DataFrame:
    """A checkpoint each so many operations, with what lies before it."""
    g = with_rank(log.select("seq", "segment_id")).groupBy(F.floor((F.col("rnk") - 1) / every).cast("long").alias("ckpt"))
    return g.agg(F.count("*").alias("ops"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def after_checkpoint(log: DataFrame, every: int = 999) -> DataFrame:
    """What a log keeps when it is cut at its last checkpoint, one each ``every`` operations."""
    done = log.agg((F.floor(F.count("*") / every) * every).alias("n")).scalar()
    return with_rank(log.select("seq", "segment_id", "key")).where(F.col("rnk") > done).select("seq", "key")


def durability_status(log: DataFrame, every: int = 999) -> DataFrame:
    return log.agg((F.count("*") % every).alias("operations_since_checkpoint"), F.max("seq").cast("long").alias("last_seq"))
