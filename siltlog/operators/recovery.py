"""Crash recovery: which records hold, where a segment is torn, the key directory out of hints and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions.codec import RECORD_HEADER, RECORD_VERSION
from siltlog.sources.binary import hint_states, read_hints, read_segments

#: The times a record may have, in milliseconds: up to the year 2100.
LAST_MS = 4_102_444_800_000


def is_valid() -> Column:
    """Of a log's records: a whole record, with a key, and a value unless it is a tombstone."""
    return (F.col("record_size") >= RECORD_HEADER) & F.col("key").isNotNull() & (F.col("is_tombstone") | F.col("value").isNotNull())


def holds() -> Column:
    """Of records read from bytes: magic and lengths (``status``), version, time and check sum."""
    return F.coalesce((F.col("status") == "ok") & (F.col("version") == RECORD_VERSION) & F.col("ts_ms").between(0, LAST_MS) & F.col("crc_ok"), F.lit(False))


def validate(records: DataFrame) -> DataFrame:
    return records.select("segment_id", "offset", holds().alias("is_valid"))


def verify_integrity(records: DataFrame) -> DataFrame:
    return records.groupBy("segment_id").agg(F.count_if(holds()).alias("valid"), F.count_if(~holds()).alias("invalid"))


def failed_segments(records: DataFrame) -> DataFrame:
    """Segments with a record that doesn't hold, and where the first of them lies."""
    return records.where(~holds()).groupBy("segment_id").agg(F.min("offset").alias("first_bad"))


def valid_prefix(records: DataFrame) -> DataFrame:
    """Each segment's records up to the first that doesn't hold."""
    return records.join(failed_segments(records), "segment_id", "left").where("first_bad is null or offset < first_bad").drop("first_bad")


def torn_tail(records: DataFrame) -> DataFrame:
    """How many records of each segment stay, and the offset behind them at which the segment is cut."""
    return valid_prefix(records).groupBy("segment_id").agg(F.count("*").alias("kept"), F.max(F.col("offset") + F.col("record_size")).cast("long").alias("truncate_at"))


def recovery_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("segment_id").alias("segments_found"), F.count("*").alias("entries"), F.count_if("is_tombstone").alias("tombstones"), F.count_distinct("key").alias("keydir_entries"))


def keydir_of(hints: DataFrame, good: DataFrame, records: DataFrame) -> DataFrame:
    """The key directory: entries of the hints of the segments in ``good``, and of all other segments their records, as far as they hold; the last of each key wins."""
    names = ["key", "segment_id", "offset", "size", "ts_ms", "is_tombstone"]
    scanned = valid_prefix(records.join(good, "segment_id", "left_anti")).withColumnRenamed("record_size", "size")
    every = hints.join(good, "segment_id", "left_semi").select(names).unionByName(scanned.select(names))
    last = every.groupBy("key").agg(F.max_by(F.struct(*names[1:]), F.struct("segment_id", "offset")).alias("x"))
    return last.select("key", "x.*")


def recover(spark: SparkSession, path: str) -> DataFrame:
    """The key directory of a folder of ``N.data`` and ``N.hint`` files. A segment whose hint file is missing or broken is scanned."""
    good = hint_states(spark, path).where("status = 'ok'").select("segment_id")
    return keydir_of(read_hints(spark, path), good, read_segments(spark, path))
