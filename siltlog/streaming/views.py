"""The log as a stream: a continuously kept view, micro-batch appends, entries that expire."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltlog.operators.views import keydir
from siltlog.plans.oplog import from_events
from siltlog.sources.tables import shared_dir


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of event files, or one file, as a stream. Event time is cast to TIMESTAMP, as watermarks need it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    raw = reader.parquet(path)
    return from_events(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key directory by a stream: arrival order (seq) decides, so late rows are never dropped. The state is a row a key; a micro-batch
    writes the keys it has changed, in a folder of its own, and a read keeps the last row of each."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = f"{shared_dir(spark)}/siltlog-stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/view/epoch={epoch}")

    view = keydir(event_stream(spark, path, schema).select("key", "seq", "segment_id", "is_tombstone", "value"))
    query = view.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return keydir(spark.read.parquet(f"{out}/view").select("key", "seq", "segment_id", "is_tombstone", "value"))


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """A micro-batch sink to the log: each epoch has a folder of its own, so one that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expiring(stream: DataFrame, seconds: int = 300) -> DataFrame:
    """Accesses of a stream (key, ts) with whether the key's last one is at most so old; a key's state goes when it has expired."""

    def step(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in pdfs:
            times = sorted(int(t.value // 1000) for t in pdf["ts"])
            hits = 0
            for t in times:
                hits += last is not None and 0 <= t - last <= seconds * 1_000_000
                last = t if last is None else max(last, t)
            yield pd.DataFrame({"key": [key[0]], "accesses": [len(times)], "hits": [hits]})
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    timed = stream.withWatermark("ts", "1 hour")
    return timed.groupBy("key").applyInPandasWithState(step, "key string, accesses long, hits long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
