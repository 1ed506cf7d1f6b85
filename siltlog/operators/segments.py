"""Segments: lists, hints, rotation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.operators.views import keydir
from siltlog.plans.oplog import active_segment


def list_segments(log: DataFrame) -> DataFrame:
    return log.select("segment_id").distinct()


def next_segment(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("segment_id"), F.lit(0)) + 1).alias("next_id"))


def closed_segments(log: DataFrame) -> DataFrame:
    return list_segments(log).where(F.col("segment_id") < active_segment(log).scalar())


def entries(log: DataFrame) -> DataFrame:
    return log.groupBy("segment_id").agg(F.count("*").alias("n"))


def hint_entries(log: DataFrame) -> DataFrame:
    """Current versions in each segment, values left out."""
    d = keydir(log.select("key", "seq", "segment_id", "is_tombstone"))
    return d.groupBy("segment_id").agg(F.count("*").alias("entries"), F.count_if("is_tombstone").alias("tombs"))


def segment_hints(log: DataFrame) -> DataFrame:
    """Each segment with its hint entries; without any it must be scanned."""
    h = hint_entries(log).select("segment_id", "entries")
    return list_segments(log).join(h, "segment_id", "left").select("segment_id", F.coalesce("entries", F.lit(0)).alias("hint_entries"), F.col("entries").isNull().alias("needs_scan"))


def union_segments(log: DataFrame) -> DataFrame:
    """Records of all closed segments, the even and the odd ones put together."""
    last = active_segment(log).scalar()
    part = lambda r: log.where((F.col("segment_id") % 2 == r) & (F.col("segment_id") < last)).select("seq")
    return part(0).unionByName(part(1))


def rotation(log: DataFrame, max_bytes: int = 4096, chunk_rows: int = 1_000_000) -> DataFrame:
    """The segment of each record if a new one is begun before a write once the last holds ``max_bytes`` or more.

    The rule is sequential, yet what a chunk of the log does depends only on the record at which it first rotates. Each chunk is summed up by the outcome
    for each such record (those within ``max_bytes`` of its start); the chunks are then linked on the driver, which reads these sums a partition at a time
    and keeps two numbers a chunk of ``chunk_rows`` records. These are joined to the chunks, and each assigns its own records.
    """
    rows = log.select("seq", "record_size", F.floor(F.col("seq") / chunk_rows).cast("long").alias("chunk"))

    def followers(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes before each record, and the record that rotates next if a segment begins at it."""
        before = np.concatenate([[0], np.cumsum(sizes)])
        return before, np.maximum(np.searchsorted(before[:-1], before[:-1] + max_bytes, "left"), np.arange(1, len(before)))

    def summed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """For each record that can be the first to rotate: how many segments begin from there on, and the bytes in the last of them."""
        before, follower = followers(pdf.sort_values("seq")["record_size"].to_numpy())
        n = len(follower)
        near = min(n, int(np.searchsorted(before[:-1], max_bytes, "right")) + 1)
        opened, last = [0] * (n + 1), [0] * (n + 1)
        for i, j in zip(range(n - 1, -1, -1), follower[::-1].tolist(), strict=True):
            opened[i], last[i] = opened[j] + 1, last[j] if j < n else i
        fill = before[-1] - before[np.array(last[:near], np.int64)]
        packed = (np.asarray(x[:near], np.int64).tobytes() for x in (before, opened, fill))
        return pd.DataFrame({"chunk": [key[0]], **{c: [x] for c, x in zip(("before", "opened", "fill"), packed, strict=True)}, "total": [int(before[-1])]})

    sums = rows.groupBy("chunk").applyInPandas(summed, "chunk long, before binary, opened binary, fill binary, total long").orderBy("chunk")
    state, segment, fill = [], 1, 0
    for r in sums.toLocalIterator():
        state.append((r.chunk, segment, fill))
        before, opened, fills = (np.frombuffer(x, np.int64) for x in (r.before, r.opened, r.fill))
        first = int(np.searchsorted(before, max_bytes - fill, "left"))
        if first == len(before):
            fill += r.total
        else:
            segment, fill = segment + int(opened[first]), int(fills[first])
    begun = log.sparkSession.createDataFrame(state, "chunk long, opened long, fill long")

    def assigned(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        sizes = pdf["record_size"].to_numpy()
        segment, fill = int(pdf["opened"].iat[0]), int(pdf["fill"].iat[0])
        before, follower = followers(sizes)
        begins, i = np.zeros(len(sizes), np.int64), int(np.searchsorted(before[:-1] + fill, max_bytes, "left"))
        while i < len(sizes):
            begins[i] = 1
            i = int(follower[i])
        return pd.DataFrame({"seq": pdf["seq"], "record_size": sizes, "segment": segment + np.cumsum(begins)})

    return rows.join(begun, "chunk").groupBy("chunk").applyInPandas(assigned, "seq long, record_size long, segment long")


