"""What a reader sees of a log: the last version of each key, and what of it is alive.

Filters on keys commute with the last-version aggregate and reach the scan; the tombstone filter doesn't, and always follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltlog.plans.oplog import with_previous


def keydir(log: DataFrame) -> DataFrame:
    """The last version of each key by arrival, tombstones too. One aggregate with partial combining: a hot key costs a row a task."""
    rest = [c for c in log.columns if c not in ("key", "seq")]
    last = log.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("x"), F.max("seq").alias("seq"))
    return last.select("key", "x.*", "seq")


def live(log: DataFrame) -> DataFrame:
    return keydir(log).where(~F.col("is_tombstone"))


def live_pairs(log: DataFrame) -> DataFrame:
    return live(log.select("key", "seq", "value", "is_tombstone")).select("key", "value")


def get(log: DataFrame, key: str) -> DataFrame:
    """The value of a key; nothing for one that is absent or deleted."""
    return live_pairs(log.where(F.col("key") == key))


def range_scan(log: DataFrame, start: str, end: str) -> DataFrame:
    """Live pairs with start <= key <= end, in bytewise order of the key; nothing if the bounds are inverted."""
    return live_pairs(log.where(F.col("key").between(start, end))).orderBy("key")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Live pairs of the keys of a table; the semi-join stands below the aggregate, so only their versions are shuffled."""
    return live_pairs(log.join(keys.select("key").distinct(), "key", "left_semi"))


def as_of(log: DataFrame, seq: Column | int) -> DataFrame:
    """The live view as it was once ``seq`` had been written."""
    return live_pairs(log.where(F.col("seq") <= seq))


def latest_by_time(log: DataFrame) -> DataFrame:
    """The version of each key with the latest time; of equal times the one that came first."""
    return log.groupBy("key").agg(F.max_by("value", F.struct("ts", -F.col("seq"))).alias("value"))


def key_set(log: DataFrame) -> DataFrame:
    """Keys of the key directory without the deleted ones."""
    every = keydir(log.select("key", "seq", "is_tombstone"))
    return every.select("key").exceptAll(every.where("is_tombstone").select("key"))


def deleted(log: DataFrame) -> DataFrame:
    return keydir(log.select("key", "seq", "is_tombstone")).where("is_tombstone").select("key", "is_tombstone")


def resurrected(log: DataFrame) -> DataFrame:
    """Keys put again straight after a delete."""
    return with_previous(log.select("key", "seq", "is_tombstone"), "is_tombstone").where("previous.is_tombstone and not is_tombstone").select("key").distinct()


def versions(log: DataFrame, most: int = 3) -> DataFrame:
    """The last versions of each key, the newest first; the rank filter limits each task's rows before the shuffle."""
    r = F.row_number().over(W.partitionBy("key").orderBy(F.desc("seq")))
    return log.select("key", "seq").withColumn("version_rank", r.cast("long")).where(F.col("version_rank") <= most)


def superseded(log: DataFrame) -> DataFrame:
    """Records with a newer version of the key in a later segment."""
    last = log.groupBy("key").agg(F.max("segment_id").alias("last"))
    return log.select("key", "seq", "segment_id").join(last, "key").where(F.col("segment_id") < F.col("last")).select("seq")


def current(log: DataFrame) -> DataFrame:
    """Records without a newer version: an anti-join with all but the last, said as an aggregate."""
    return log.groupBy("key").agg(F.max("seq").alias("seq")).select("seq", "key")


def status(log: DataFrame) -> DataFrame:
    """Active segment, keys with tombstones, live keys."""
    per_key = keydir(log.select("key", "seq", "segment_id", "is_tombstone"))
    counts = per_key.agg(F.max("segment_id").alias("active_segment_id"), F.count("*").alias("keydir_size"), F.count_if(~F.col("is_tombstone")).alias("key_set_size"))
    return counts


def index_join(log: DataFrame) -> DataFrame:
    """Live keys with where their record lies."""
    d = keydir(log.select("key", "seq", "segment_id", "off", "is_tombstone"))
    return d.where(~F.col("is_tombstone")).select("key").join(d.select("key", "segment_id", "off"), "key")


def fetch_values(log: DataFrame) -> DataFrame:
    """Values by an equi-join of the directory with the records on (segment, offset)."""
    d = keydir(log.select("key", "seq", "segment_id", "off", "is_tombstone")).where(~F.col("is_tombstone"))
    return d.select("key", "segment_id", "off").join(log.select("segment_id", "off", "value"), ["segment_id", "off"]).select("key", "value")
