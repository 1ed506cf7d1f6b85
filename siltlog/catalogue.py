"""Every registered query of the log engine and the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions.codec import number_at
from siltlog.functions.compression import zlib_stats
from siltlog.operators import batches, caching, maintenance, recovery, replication, segments, views, wal
from siltlog.plans.oplog import load, with_offsets
from siltlog.sources.binary import encoded, scan, segment_bytes
from siltlog.streaming.views import latest


def _key(n) -> F.Column:
    return F.concat(F.lit("user_"), F.lpad(n.cast("string"), 6, "0"))


def _on_log(step: Callable[[DataFrame], DataFrame], offsets: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = load(spark, sf_dir)
        return step(with_offsets(log) if offsets else log)

    return run


def _on_documents(step: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: step(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the keys named by the customers table."""
    return views.multi_get(load(spark, sf_dir), spark.read.parquet(f"{sf_dir}/customer.parquet").select(_key(F.col("c_custkey")).alias("key")))


def _read_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the keys that follow those accessed."""
    nxt = spark.read.parquet(f"{sf_dir}/events.parquet").select(_key(F.col("user_id") + 1).alias("key"))
    return views.multi_get(load(spark, sf_dir), nxt)


def _as_of(log: DataFrame) -> DataFrame:
    """The view as of half of the log."""
    return views.as_of(log, F.floor(log.agg(F.max("seq")).scalar() / 2))


def _planted() -> F.Column:
    """Faults set into a log that has none: records of these sequence numbers get a wrong check sum."""
    return F.col("seq") % 97 == 13


def _scanned(log: DataFrame) -> DataFrame:
    """The records in the bytes of the log's segments, read by another code than wrote them, with the faults."""
    return scan(segment_bytes(log, _planted()))


def _numbered(log: DataFrame, records: DataFrame) -> DataFrame:
    """Records with the sequence number of what lies at their place."""
    return records.join(with_offsets(log).select("seq", "segment_id", F.col("off").alias("offset")), ["segment_id", "offset"])


def _segment_scan(log: DataFrame) -> DataFrame:
    found = _numbered(log, scan(segment_bytes(log)))
    return found.select("seq", "segment_id", "key", "value", "is_tombstone", recovery.holds().alias("ok"))


def _recover(log: DataFrame) -> DataFrame:
    """The key directory where even segments have hints and odd ones are scanned."""
    offsets = with_offsets(log).withColumn("offset", F.col("off")).withColumn("size", F.col("record_size")).withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    last = offsets.groupBy("segment_id", "key").agg(F.max_by(F.struct("offset", "size", "ts_ms", "is_tombstone"), "seq").alias("x"))
    good = log.select("segment_id").where("segment_id % 2 = 0").distinct()
    found = recovery.keydir_of(last.select("segment_id", "key", "x.*"), good, scan(segment_bytes(log.where("segment_id % 2 = 1"))))
    return found.select("key", "segment_id", F.col("offset").alias("off"), F.col("size").alias("record_size"), "is_tombstone")


def _append(rl: DataFrame) -> DataFrame:
    """Requests to three nodes, whose logs are of another term behind the commit index."""
    sent = replication.log_match(rl).withColumnRenamed("match_index", "prev_log_index")
    late = (F.col("prev_log_index") > replication.commit_index(rl).scalar()).cast("long")
    return replication.append_accepted(sent, sent.select("node", F.col("prev_log_index").alias("idx"), (F.col("prev_log_term") + late).alias("term")))


def _record_crc(log: DataFrame) -> DataFrame:
    return encoded(log).select("seq", number_at(F.col("record"), 26, 4).alias("crc"))


def _key_path(log: DataFrame) -> DataFrame:
    """Where each key is found by name, and its number."""
    path = F.concat(F.lit("/kv/"), F.regexp_replace(F.url_encode("key"), r"\\+", "%20"))
    return log.select("key").distinct().select("key", path.alias("path"), F.split_part("key", F.lit("_"), F.lit(2)).alias("number"))


def _keyed(step: Callable[[DataFrame], DataFrame], low: str, high: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: step(load(spark, sf_dir, low, high))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    rl = lambda f: _on_log(lambda log: f(replication.entries(log)))
    return {
        "op_range": _keyed(lambda log: views.range_scan(log, "user_000010", "user_000040"), "user_000010", "user_000040"),
        "op_range_empty": _on_log(lambda log: views.range_scan(log, "zzz", "aaa")),
        "op_get": _keyed(lambda log: views.get(log, "user_000042"), "user_000042", "user_000042"),
        "op_get_deleted": _on_log(views.deleted),
        "op_resurrected": _on_log(views.resurrected),
        "op_put_latest": _on_log(views.live_pairs),
        "op_live_view": _on_log(views.live_pairs),
        "op_key_set": _on_log(views.key_set),
        "op_delete_view": _on_log(views.deleted),
        "op_tombstone_count": _on_log(lambda log: views.deleted(log).agg(F.count("*").alias("n"))),
        "op_keydir": _on_log(lambda log: views.keydir(log).select("key", "segment_id", "off", "record_size", "ts", "is_tombstone"), True),
        "op_keydir_by_segment": _on_log(lambda log: views.keydir(log).where(F.col("segment_id") == log.agg(F.max("segment_id")).scalar()).select("key", "segment_id", "off", "record_size", "is_tombstone"), True),
        "op_latest_by_ts": _on_log(views.latest_by_time),
        "op_as_of": _on_log(_as_of),
        "op_version_history": _on_log(views.versions),
        "op_superseded": _on_log(views.superseded),
        "op_current_antijoin": _on_log(views.current),
        "op_multi_get": _multi_get,
        "op_read_ahead": _read_ahead,
        "op_status": _on_log(views.status),
        "op_index_join": _on_log(views.index_join, True),
        "op_fetch_values": _on_log(views.fetch_values, True),
        "op_batch_put": _on_log(batches.last_puts),
        "op_atomic_batch": _on_log(batches.last_operations),
        "op_batch_report": _on_log(batches.report),
        "op_batch_status": _on_log(batches.status),
        "op_record_size": _on_log(lambda log: log.select("seq", "record_size")),
        "op_offsets": _on_log(lambda log: log.select("seq", "segment_id", "off", "record_size"), True),
        "op_record_crc": _on_log(_record_crc),
        "op_segment_scan": _on_log(_segment_scan),
        "op_list_segments": _on_log(lambda log: segments.list_segments(log).orderBy("segment_id")),
        "op_next_segment": _on_log(segments.next_segment),
        "op_closed_segments": _on_log(segments.closed_segments),
        "op_segment_entries": _on_log(segments.entries),
        "op_hint_entries": _on_log(segments.hint_entries),
        "op_list_hints": _on_log(lambda log: segments.hint_entries(log).select("segment_id")),
        "op_segment_hint_join": _on_log(segments.segment_hints),
        "op_union_segments": _on_log(segments.union_segments),
        "op_rotation": _on_log(segments.rotation),
        "op_stale_ratio": _on_log(maintenance.stale_ratio),
        "op_stale_ratio_index": _on_log(maintenance.stale_ratio_index),
        "op_should_compact": _on_log(maintenance.should_compact),
        "op_compacted": _on_log(maintenance.compacted),
        "op_compaction_stats": _on_log(maintenance.compaction_stats),
        "op_compactor_status": _on_log(maintenance.compactor_status),
        "op_compression_stats": _on_documents(maintenance.compression_stats),
        "op_should_compress": _on_documents(maintenance.should_compress),
        "op_zlib_stats": _on_documents(zlib_stats),
        "op_validate": _on_log(lambda log: _numbered(log, recovery.validate(_scanned(log))).select("seq", "is_valid")),
        "op_verify_integrity": _on_log(lambda log: recovery.verify_integrity(_scanned(log))),
        "op_recovery_stats": _on_log(recovery.recovery_stats),
        "op_torn_tail": _on_log(lambda log: recovery.torn_tail(_scanned(log))),
        "op_failed_segments": _on_log(lambda log: recovery.failed_segments(_scanned(log))),
        "op_recover_keydir": _on_log(_recover),
        "op_wal_entries": _on_log(wal.wal_entries),
        "op_wal_replay": _on_log(wal.replay),
        "op_wal_replay_stats": _on_log(wal.replay_stats),
        "op_checkpoints": _on_log(wal.checkpoints),
        "op_wal_truncated": _on_log(wal.after_checkpoint),
        "op_durability_status": _on_log(wal.durability_status),
        "op_cache_ttl": _on_log(caching.ttl_hits),
        "op_cache_hit_rate": _on_log(caching.hit_rate),
        "op_cache_lru_top": _on_log(caching.most_recent),
        "op_cache_evict": _on_log(caching.evicted_first),
        "op_cache_bounded": _on_log(caching.bounded),
        "op_key_path": _on_log(_key_path),
        "op_cache_memory": _on_log(caching.memory),
        "op_election": rl(replication.election),
        "op_commit_index": rl(replication.commit_index),
        "op_commit_of_term": rl(replication.commit_of_term),
        "op_peers": rl(replication.peers),
        "op_append_accepted": rl(_append),
        "op_log_match": rl(replication.log_match),
        "op_raft_apply": rl(replication.applied),
        "st_latest": latest,
    }


BASE = """
WITH RECURSIVE raw AS (SELECT event_id AS seq, CAST(floor(event_id / 100.0) AS INT) + 1 AS segment_id, CAST(floor(event_id / 7.0) AS BIGINT) + 1 AS txn_id,
    concat('user_', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS key, event_type = 'error' AS is_tombstone,
    CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, ':', props) END AS value, ts FROM events),
sized AS (SELECT *, CAST(30 + strlen(key) + coalesce(strlen(value), 0) AS BIGINT) AS record_size FROM raw),
oplog AS (SELECT *, CAST(coalesce(sum(record_size) OVER (PARTITION BY segment_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM oplog),
keydir AS (SELECT * FROM ranked WHERE rn = 1),
live AS (SELECT key, value FROM keydir WHERE NOT is_tombstone),
act AS (SELECT max(segment_id) AS a FROM oplog),
rl AS (SELECT seq + 1 AS idx, CAST(floor(seq / 1000.0) AS BIGINT) + 1 AS term, key, CASE WHEN is_tombstone THEN 'delete' ELSE 'put' END AS operation, value FROM oplog),
nodes AS (SELECT node, CAST(max(idx) AS BIGINT) AS match_index FROM (SELECT concat('node', CAST(idx % 3 + 1 AS VARCHAR)) AS node, idx FROM rl
    WHERE idx <= (SELECT max(idx) FROM rl) - 1000 + 300 * (idx % 3)) t GROUP BY node),
ci AS (SELECT match_index AS commit_index FROM (SELECT match_index, row_number() OVER (ORDER BY match_index) AS r, count(*) OVER () AS n FROM nodes) t WHERE r = CAST(floor(n / 2.0) AS BIGINT) + 1),
whole AS (SELECT txn_id FROM oplog GROUP BY txn_id HAVING count(*) = 7),
sums AS (SELECT seq, record_size, CAST(sum(record_size) OVER (ORDER BY seq) - record_size AS BIGINT) AS bytes_before FROM oplog),
starts AS (SELECT CAST(1 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS start_at UNION ALL
    SELECT s.segment + 1, min(c.bytes_before) FROM starts s JOIN sums c ON c.bytes_before - s.start_at >= 4096 GROUP BY s.segment)
"""
VALID = "(seq % 97 <> 13 AND record_size >= 30 AND key IS NOT NULL AND (is_tombstone OR value IS NOT NULL))"
STALE = "CAST(sum(CASE WHEN rn > 1 OR is_tombstone THEN 1 ELSE 0 END) AS DOUBLE) / count(*)"
COUNT = "CAST(sum(CASE WHEN {} THEN 1 ELSE 0 END) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    live, deleted = "SELECT key, value FROM live", "SELECT key, is_tombstone FROM keydir WHERE is_tombstone"
    ttl = f"SELECT count(*) AS accesses, {COUNT.format("ts - prev <= INTERVAL '300' SECOND")} AS hits FROM (SELECT ts, lag(ts) OVER (PARTITION BY key ORDER BY seq) AS prev FROM oplog) t"
    own = {
        "op_range": f"{live} WHERE key BETWEEN 'user_000010' AND 'user_000040'",
        "op_range_empty": f"{live} WHERE key BETWEEN 'zzz' AND 'aaa'",
        "op_get": f"{live} WHERE key = 'user_000042'",
        "op_get_deleted": deleted,
        "op_resurrected": "SELECT DISTINCT key FROM (SELECT key, is_tombstone, lag(is_tombstone) OVER (PARTITION BY key ORDER BY seq) AS p FROM oplog) t WHERE p AND NOT is_tombstone",
        "op_put_latest": live,
        "op_live_view": live,
        "op_key_set": "SELECT key FROM keydir EXCEPT SELECT key FROM keydir WHERE is_tombstone",
        "op_delete_view": deleted,
        "op_tombstone_count": "SELECT count(*) AS n FROM keydir WHERE is_tombstone",
        "op_keydir": "SELECT key, segment_id, off, record_size, ts, is_tombstone FROM keydir",
        "op_keydir_by_segment": "SELECT key, segment_id, off, record_size, is_tombstone FROM keydir WHERE segment_id = (SELECT a FROM act)",
        "op_latest_by_ts": "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq) AS r FROM oplog) t WHERE r = 1",
        "op_as_of": "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM oplog WHERE seq <= (SELECT floor(max(seq) / 2.0) FROM oplog)) t WHERE r = 1 AND NOT is_tombstone",
        "op_version_history": "SELECT key, seq, rn AS version_rank FROM ranked WHERE rn <= 3",
        "op_superseded": "SELECT o.seq FROM oplog o WHERE EXISTS (SELECT 1 FROM oplog n WHERE n.key = o.key AND n.seq > o.seq AND n.segment_id > o.segment_id)",
        "op_current_antijoin": "SELECT o.seq, o.key FROM oplog o WHERE NOT EXISTS (SELECT 1 FROM oplog n WHERE n.key = o.key AND n.seq > o.seq)",
        "op_multi_get": f"{live} WHERE key IN (SELECT concat('user_', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) FROM customer)",
        "op_read_ahead": f"{live} WHERE key IN (SELECT concat('user_', lpad(CAST(user_id + 1 AS VARCHAR), 6, '0')) FROM events)",
        "op_status": f"SELECT (SELECT a FROM act) AS active_segment_id, count(*) AS keydir_size, {COUNT.format('NOT is_tombstone')} AS key_set_size FROM keydir",
        "op_index_join": "SELECT key, segment_id, off FROM keydir WHERE NOT is_tombstone",
        "op_fetch_values": "SELECT k.key, o.value FROM keydir k JOIN oplog o ON k.segment_id = o.segment_id AND k.off = o.off WHERE NOT k.is_tombstone",
        "op_batch_put": "SELECT txn_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, key ORDER BY seq DESC) AS r FROM oplog WHERE NOT is_tombstone) t WHERE r = 1",
        "op_atomic_batch": "SELECT txn_id, key, value, is_tombstone FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, key ORDER BY seq DESC) AS r FROM oplog) t WHERE r = 1",
        "op_batch_report": "SELECT CASE WHEN is_tombstone THEN 'delete' ELSE 'put' END AS op, count(*) AS n FROM oplog GROUP BY 1",
        "op_batch_status": f"SELECT txn_id, count(*) AS operations, {COUNT.format('key IS NOT NULL AND (is_tombstone OR value IS NOT NULL)')} AS succeeded, {COUNT.format('NOT (key IS NOT NULL AND (is_tombstone OR value IS NOT NULL))')} AS failed, CASE WHEN bool_and(key IS NOT NULL AND (is_tombstone OR value IS NOT NULL)) THEN 'ok' WHEN bool_or(key IS NOT NULL AND (is_tombstone OR value IS NOT NULL)) THEN 'partial' ELSE 'failed' END AS status FROM oplog GROUP BY txn_id",
        "op_record_size": "SELECT seq, record_size FROM oplog",
        "op_offsets": "SELECT seq, segment_id, off, record_size FROM oplog",
        "op_segment_scan": "SELECT seq, segment_id, key, value, is_tombstone, true AS ok FROM oplog",
        "op_list_segments": "SELECT DISTINCT segment_id FROM oplog",
        "op_next_segment": "SELECT coalesce(max(segment_id), 0) + 1 AS next_id FROM oplog",
        "op_closed_segments": "SELECT DISTINCT segment_id FROM oplog WHERE segment_id < (SELECT a FROM act)",
        "op_segment_entries": "SELECT segment_id, count(*) AS n FROM oplog GROUP BY segment_id",
        "op_hint_entries": f"SELECT segment_id, count(*) AS entries, {COUNT.format('is_tombstone')} AS tombs FROM keydir GROUP BY segment_id",
        "op_list_hints": "SELECT DISTINCT segment_id FROM keydir",
        "op_segment_hint_join": "SELECT s.segment_id, coalesce(h.n, 0) AS hint_entries, h.n IS NULL AS needs_scan FROM (SELECT DISTINCT segment_id FROM oplog) s LEFT JOIN (SELECT segment_id, count(*) AS n FROM keydir GROUP BY segment_id) h ON s.segment_id = h.segment_id",
        "op_union_segments": "SELECT seq FROM oplog WHERE segment_id < (SELECT a FROM act)",
        "op_rotation": "SELECT c.seq, c.record_size, s.segment FROM sums c ASOF JOIN starts s ON c.bytes_before >= s.start_at",
        "op_stale_ratio": f"SELECT {STALE} AS stale_ratio FROM ranked WHERE segment_id < (SELECT a FROM act)",
        "op_stale_ratio_index": "SELECT coalesce(CAST(sum(CASE WHEN is_tombstone THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 0.0) AS stale_ratio FROM keydir WHERE segment_id < (SELECT a FROM act)",
        "op_should_compact": f"SELECT count(DISTINCT segment_id) >= 3 AND {STALE} >= 0.3 AS should_compact FROM ranked WHERE segment_id < (SELECT a FROM act)",
        "op_compacted": "SELECT key, value, segment_id AS src_segment FROM keydir WHERE segment_id < (SELECT a FROM act) AND NOT is_tombstone",
        "op_compaction_stats": f"SELECT (SELECT count(DISTINCT segment_id) FROM oplog WHERE segment_id < (SELECT a FROM act)) AS segments_merged, coalesce({COUNT.format('NOT is_tombstone')}, 0) AS entries, coalesce({COUNT.format('is_tombstone')}, 0) AS tombstones_removed, CAST(coalesce(sum(CASE WHEN is_tombstone THEN 0 ELSE record_size END), 0) AS BIGINT) AS total_size FROM keydir WHERE segment_id < (SELECT a FROM act)",
        "op_compactor_status": f"SELECT count(DISTINCT segment_id) AS closed_segments, round(100 * ({STALE}), 1) AS stale_percent, count(DISTINCT segment_id) >= 3 AND {STALE} >= 0.3 AS due FROM ranked WHERE segment_id < (SELECT a FROM act)",
        "op_compression_stats": "SELECT lang, CAST(sum(strlen(text)) - sum(n_chars) AS BIGINT) AS saved, round(100.0::DOUBLE * CAST(sum(strlen(text)) - sum(n_chars) AS DOUBLE) / sum(strlen(text)), 1) AS percent, CAST(sum(strlen(text)) AS BIGINT) AS original_size, CAST(sum(n_chars) AS BIGINT) AS other, round(CAST(sum(strlen(text)) - sum(n_chars) AS DOUBLE) / sum(strlen(text)), 6) AS ratio FROM documents GROUP BY lang",
        "op_should_compress": "SELECT doc_id, strlen(text) >= 1024 AS should_compress FROM documents",
        "op_validate": f"SELECT seq, {VALID} AS is_valid FROM oplog",
        "op_verify_integrity": f"SELECT segment_id, {COUNT.format(VALID)} AS valid, {COUNT.format('NOT ' + VALID)} AS invalid FROM oplog GROUP BY segment_id",
        "op_recovery_stats": f"SELECT count(DISTINCT segment_id) AS segments_found, count(*) AS entries, {COUNT.format('is_tombstone')} AS tombstones, count(DISTINCT key) AS keydir_entries FROM oplog",
        "op_torn_tail": "SELECT segment_id, count(*) AS kept, CAST(max(off + record_size) AS BIGINT) AS truncate_at FROM (SELECT *, min(CASE WHEN seq % 97 = 13 THEN seq END) OVER (PARTITION BY segment_id) AS bad FROM oplog) t WHERE bad IS NULL OR seq < bad GROUP BY segment_id",
        "op_failed_segments": "SELECT segment_id, CAST(min(off) AS BIGINT) AS first_bad FROM oplog WHERE seq % 97 = 13 GROUP BY segment_id",
        "op_recover_keydir": "SELECT key, segment_id, off, record_size, is_tombstone FROM keydir",
        "op_wal_entries": "SELECT 3 AS type, txn_id, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS BIGINT) AS batch_size FROM oplog GROUP BY txn_id UNION ALL SELECT CASE WHEN is_tombstone THEN 2 ELSE 1 END, txn_id, key, CAST(NULL AS BIGINT) FROM oplog UNION ALL SELECT 4, txn_id, CAST(NULL AS VARCHAR), CAST(7 AS BIGINT) FROM whole",
        "op_wal_replay": "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM oplog WHERE txn_id IN (SELECT txn_id FROM whole)) t WHERE r = 1 AND NOT is_tombstone",
        "op_wal_replay_stats": f"SELECT {COUNT.format('txn_id IN (SELECT txn_id FROM whole)')} AS entries, {COUNT.format('txn_id NOT IN (SELECT txn_id FROM whole)')} AS errors FROM oplog",
        "op_checkpoints": "SELECT CAST(floor((rnk - 1) / 1000.0) AS BIGINT) AS ckpt, count(*) AS ops, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS rnk FROM oplog) t GROUP BY 1",
        "op_wal_truncated": "SELECT seq, key FROM (SELECT *, row_number() OVER (ORDER BY seq) AS rnk, count(*) OVER () AS n FROM oplog) t WHERE rnk > floor(n / 999.0) * 999",
        "op_durability_status": "SELECT count(*) % 999 AS operations_since_checkpoint, max(seq) AS last_seq FROM oplog",
        "op_cache_ttl": ttl,
        "op_cache_hit_rate": f"SELECT CAST(hits AS DOUBLE) / accesses AS hit_rate FROM ({ttl}) u",
        "op_cache_lru_top": "SELECT key, r AS recency FROM (SELECT key, row_number() OVER (ORDER BY max(seq) DESC) AS r FROM oplog GROUP BY key) t WHERE r <= 10",
        "op_cache_evict": "SELECT key, r AS eviction_rank FROM (SELECT key, row_number() OVER (ORDER BY max(seq)) AS r FROM oplog GROUP BY key) t WHERE r <= 10",
        "op_cache_bounded": f"SELECT CAST(least(count(*), 100) AS BIGINT) AS entries, CAST(greatest(count(*) - 100, 0) AS BIGINT) AS evicted, (SELECT {COUNT.format('NOT is_tombstone')} FROM oplog) AS puts, (SELECT {COUNT.format('is_tombstone')} FROM oplog) AS deletes, CAST(sum(CASE WHEN r <= 100 THEN strlen(value) END) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS r FROM keydir WHERE NOT is_tombstone) t",
        "op_key_path": "SELECT DISTINCT key, concat('/kv/', url_encode(key)) AS path, split_part(key, '_', 2) AS number FROM oplog",
        "op_cache_memory": "SELECT CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM live",
        "op_election": "SELECT count(*) AS votes, count(*) > floor(3 / 2.0) AS won FROM nodes WHERE match_index >= (SELECT max(idx) FROM rl) - 1000",
        "op_commit_index": "SELECT commit_index FROM ci",
        "op_commit_of_term": "SELECT r.idx AS majority_index, r.term, CASE WHEN r.term = (SELECT max(term) FROM rl) THEN r.idx ELSE 0 END AS commit_index FROM rl r JOIN ci ON r.idx = ci.commit_index",
        "op_peers": "SELECT a.node, string_agg(b.node, ',' ORDER BY b.node) AS peers FROM nodes a JOIN nodes b ON a.node <> b.node GROUP BY a.node",
        "op_append_accepted": "SELECT node, match_index AS prev_log_index, match_index <= (SELECT commit_index FROM ci) AS accepted FROM nodes",
        "op_log_match": "SELECT n.node, n.match_index, r.term AS prev_log_term FROM nodes n JOIN rl r ON r.idx = n.match_index",
        "op_raft_apply": "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS r FROM rl WHERE idx <= (SELECT commit_index FROM ci)) t WHERE r = 1 AND operation = 'put'",
        "st_latest": "SELECT key, seq, segment_id, is_tombstone, value FROM keydir",
    }
    return {k: (v if "FROM documents" in v else BASE + v) for k, v in own.items()}
