"""A store on disk with the usual verbs; every read is a query over its log.

The log is a folder of immutable Parquet parts. What a reader sees is named by a manifest, a small file written last and by rename, so a write or a compaction
is seen whole or not at all. One writer at a time, as sequence numbers go on from the manifest's.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions.codec import record_size
from siltlog.operators import views
from siltlog.operators.maintenance import stale_ratio
from siltlog.plans.oplog import OPLOG


class Store:
    def __init__(self, spark: SparkSession, path: str, segment_max_bytes: int = 104_857_600):
        self.spark, self.path, self.max_bytes = spark, path.rstrip("/"), segment_max_bytes
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    # the manifest

    def _names(self) -> list[int]:
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[9:]) for n in found if n.startswith("manifest-") and n[9:].isdigit())

    def manifest(self) -> dict:
        """The newest manifest; a new store has an empty one."""
        names = self._names()
        if not names:
            return {"version": 0, "parts": [], "seq": 0, "transaction": 0, "segment": 1, "fill": 0}
        raw = self.spark.read.text(f"{self.path}/manifest-{names[-1]}", wholetext=True).first()[0]
        return json.loads(raw)

    def _commit(self, m: dict) -> None:
        m["version"] += 1
        to, tmp = self._path(f"{self.path}/manifest-{m['version']}"), self._path(f"{self.path}/.tmp-{uuid.uuid4().hex}")
        out = self._fs.create(tmp)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(tmp, to):
            self._fs.delete(tmp, False)
            raise RuntimeError("another writer has committed; try again")

    def log(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        paths = [f"{self.path}/{p}" for p in m["parts"]]
        return self.spark.read.schema(OPLOG).parquet(*paths) if paths else self.spark.createDataFrame([], OPLOG)

    # writes

    def atomic_batch(self, operations: Iterable[tuple]) -> int | None:
        """Applies ("put", key, value) and ("delete", key) in order, all or none; the first sequence number, or None for no operations."""
        ops = list(operations)
        for op in ops:
            if not (op[0] == "put" and len(op) == 3 or op[0] == "delete" and len(op) == 2):
                raise ValueError(f"invalid operation: {op!r}")
        if not ops:
            return None
        rows = [(i, op[1], op[2] if op[0] == "put" else None, op[0] == "delete") for i, op in enumerate(ops)]
        return self.append(self.spark.createDataFrame(rows, "n long, key string, value string, is_tombstone boolean"))

    def append(self, operations: DataFrame) -> int | None:
        """A batch as a table (n, key, value, is_tombstone), n from 0 without gaps; it goes into one segment, which may overshoot its limit."""
        m = self.manifest()
        if m["fill"] >= self.max_bytes:
            m["segment"], m["fill"] = m["segment"] + 1, 0
        m["transaction"] += 1
        sized = operations.withColumn("record_size", record_size("key", "value"))
        part = f"log/segment={m['segment']:08d}-{uuid.uuid4().hex}"
        rows = sized.select(
            (F.col("n") + m["seq"]).cast("long").alias("seq"),
            F.lit(m["transaction"]).cast("long").alias("transaction_id"),
            F.lit(m["segment"]).cast("int").alias("segment_id"),
            "key",
            F.when(~F.col("is_tombstone"), F.col("value")).alias("value"),
            F.lit(time.time()).cast("timestamp").alias("ts"),
            "is_tombstone",
            "record_size",
        )
        rows.write.parquet(f"{self.path}/{part}")
        n, size = self.spark.read.schema(OPLOG).parquet(f"{self.path}/{part}").agg(F.count("*"), F.sum("record_size")).first()
        first = m["seq"]
        m["parts"].append(part)
        m["seq"], m["fill"] = m["seq"] + n, m["fill"] + (size or 0)
        self._commit(m)
        return first if n else None

    def put(self, key: str, value: str) -> int:
        return self.atomic_batch([("put", key, value)])

    def delete(self, key: str) -> int:
        """A blind delete: it succeeds for keys that were never put."""
        return self.atomic_batch([("delete", key)])

    def batch_put(self, pairs: Iterable[tuple[str, str]]) -> int | None:
        return self.atomic_batch([("put", k, v) for k, v in pairs])

    # reads

    def get(self, key: str) -> str | None:
        """None for a key that is absent or deleted."""
        row = views.get(self.log(), key).first()
        return row["value"] if row else None

    def range(self, start: str, end: str) -> DataFrame:
        return views.range_scan(self.log(), start, end)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return views.multi_get(self.log(), keys)

    def as_of(self, seq: int) -> DataFrame:
        return views.as_of(self.log(), seq)

    def status(self) -> dict:
        m = self.manifest()
        r = views.status(self.log(m)).first()
        return {"data_dir": self.path, "segment_max_bytes": self.max_bytes, "active_segment_id": m["segment"], "active_offset": m["fill"], "keydir_size": r["keydir_size"], "key_set_size": r["key_set_size"], "last_seq": m["seq"] - 1}

    # maintenance

    def compact(self, least_segments: int = 3, least_ratio: float = 0.3) -> dict:
        """Replaces all closed segments by one of their live last versions, if there are enough and enough of them is stale.

        Versions keep their seq, so no order changes; the parts are written first and then named by one manifest. Old parts stay for
        readers of older manifests until ``vacuum``.
        """
        m = self.manifest()
        log = self.log(m)
        old = [p for p in m["parts"] if int(p.split("=")[1].split("-")[0]) < m["segment"]]
        segments = {p.split("=")[1].split("-")[0] for p in old}
        if len(segments) < least_segments or stale_ratio(log).first()[0] < least_ratio:
            return {"segments_merged": 0, "tombstones_removed": 0, "entries": 0}
        last = views.keydir(log).where(F.col("segment_id") < m["segment"])
        target = int(max(segments))  # the id of a segment that goes, so no later one can have it
        part = f"log/segment={target:08d}-{uuid.uuid4().hex}"
        kept = last.where(~F.col("is_tombstone")).withColumn("segment_id", F.lit(target).cast("int"))
        kept.select(OPLOG.names).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.path}/{part}")
        stats = {"segments_merged": len(segments), "tombstones_removed": last.where("is_tombstone").count(), "entries": self.spark.read.parquet(f"{self.path}/{part}").count()}
        m["parts"] = [part] + [p for p in m["parts"] if p not in old]
        self._commit(m)
        return stats

    def vacuum(self) -> int:
        """Deletes parts the newest manifest doesn't name."""
        named = {p.split("/")[1] for p in self.manifest()["parts"]}
        gone = 0
        if self._fs.exists(self._path(f"{self.path}/log")):
            for f in self._fs.listStatus(self._path(f"{self.path}/log")):
                if f.getPath().getName() not in named:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        return gone
