"""Stale data, compaction, compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.functions.codec import saved_ratio
from siltlog.operators.views import keydir
from siltlog.plans.oplog import active_segment, closed


def marked(log: DataFrame) -> DataFrame:
    """Records with whether each is stale: a tombstone, or not the last of its key. The last of each key is an aggregate, joined back."""
    last = log.groupBy("key").agg(F.max("seq").alias("last"))
    return log.join(last, "key").withColumn("stale", F.col("is_tombstone") | (F.col("seq") < F.col("last")))


def ratio(hit: Column) -> Column:
    """Share of rows; 0.0 of none."""
    return F.coalesce(F.count_if(hit).cast("double") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))


def stale_ratio(log: DataFrame) -> DataFrame:
    return closed(marked(log.select("key", "seq", "segment_id", "is_tombstone"))).agg(ratio(F.col("stale")).alias("stale_ratio"))


def stale_ratio_index(log: DataFrame) -> DataFrame:
    """Over the key directory, which holds one version a key: tombstones alone are stale."""
    d = keydir(log.select("key", "seq", "segment_id", "is_tombstone"))
    return d.where(F.col("segment_id") < active_segment(log).scalar()).agg(ratio(F.col("is_tombstone")).alias("stale_ratio"))


def should_compact(log: DataFrame, segments: int = 3, least: float = 0.3) -> DataFrame:
    m = closed(marked(log.select("key", "seq", "segment_id", "is_tombstone")))
    return m.agg(((F.count_distinct("segment_id") >= segments) & (ratio(F.col("stale")) >= least)).alias("should_compact"))


def compacted(log: DataFrame) -> DataFrame:
    """What one segment in place of all closed ones holds: the live last versions that lie in them."""
    d = keydir(log.select("key", "seq", "segment_id", "value", "is_tombstone"))
    out = d.where(F.col("segment_id") < active_segment(log).scalar()).where(~F.col("is_tombstone"))
    return out.select("key", "value", F.col("segment_id").alias("src_segment"))


def compaction_stats(log: DataFrame) -> DataFrame:
    d = keydir(log.select("key", "seq", "segment_id", "record_size", "is_tombstone")).where(F.col("segment_id") < active_segment(log).scalar())
    merged = closed(log.select("segment_id")).agg(F.count_distinct("segment_id").alias("segments_merged"))
    out = d.agg(F.count_if("is_tombstone").alias("tombstones_removed"), F.coalesce(F.sum(F.when(F.col("is_tombstone"), 0).otherwise(F.col("record_size"))), F.lit(0)).cast("long").alias("total_size"), F.count_if(~F.col("is_tombstone")).alias("entries"))
    return out.select("*", merged.scalar().alias("segments_merged")).select("segments_merged", "entries", "tombstones_removed", "total_size")


def compactor_status(log: DataFrame, segments: int = 3, least: float = 0.3) -> DataFrame:
    """Closed segments, their stale share in percent and whether both are enough for a compaction."""
    m = closed(marked(log.select("key", "seq", "segment_id", "is_tombstone"))).agg(F.count_distinct("segment_id").alias("closed_segments"), ratio(F.col("stale")).alias("r"))
    return m.select("closed_segments", F.round(100 * F.col("r"), 1).alias("stale_percent"), ((F.col("closed_segments") >= segments) & (F.col("r") >= least)).alias("due"))


def compression_stats(docs: DataFrame) -> DataFrame:
    """Bytes against characters, as a stand-in for a compressed size, by language."""
    g = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).cast("long").alias("original_size"), F.sum("n_chars").cast("long").alias("other"))
    saved = F.col("original_size") - F.col("other")
    out = g.withColumn("ratio", F.round(saved_ratio(F.col("original_size"), F.col("other")), 6)).withColumn("saved", saved)
    return out.withColumn("percent", F.round(F.lit(100.0) * saved.cast("double") / F.col("original_size"), 1))


def should_compress(docs: DataFrame, least: int = 1024) -> DataFrame:
    return docs.select("doc_id", (F.octet_length("text") >= least).alias("should_compress"))
