"""Vectors in blocks: shards of a table, tiles of queries, and top lists merged as a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = "g long, kind int, block long, d int, ids binary, data binary"


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and double matrix of each length of vector; null and empty vectors and those with null or non-finite components are left out."""
    offsets = np.asarray(column.offsets)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths, valid = np.diff(offsets), column.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[valid & (lengths > 0)]):
        rows = np.flatnonzero(valid & (lengths == d))
        m = values[offsets[:-1][rows][:, None] + np.arange(d)]
        ok = np.isfinite(m).all(axis=1)
        yield rows[ok], m[ok]


def blocks(df: DataFrame, prepare: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, groups: int | None) -> DataFrame:
    """Packs (id, vector) rows into blocks of at most ``size`` vectors of one length.

    ``prepare`` maps a matrix to the rows that take part and their prepared matrix. With ``groups`` the blocks are shards, dealt in turn to
    that many groups (kind 0); without, they are query tiles (kind 1) still to be sent to each group.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made = 0

        def block(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            g = (part + made) % groups if groups else 0
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([0 if groups else 1], pa.int32()), pa.array([part << 24 | made], pa.int64()), pa.array([m.shape[1]], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(m, np.float64).tobytes()], pa.binary())], ["g", "kind", "block", "d", "ids", "data"])

        def cut(d: int, all_of: bool) -> Iterator[pa.RecordBatch]:
            ids, m = (np.concatenate(x) for x in zip(*held[d], strict=True))
            a = 0
            while len(ids) - a >= size or (all_of and a < len(ids)):
                yield block(ids[a : a + size], m[a : a + size])
                a += size
            held[d] = [(ids[a:], m[a:])] if a < len(ids) else []

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for rows, m in matrices(b.column(1)):
                ok, m = prepare(m)
                d = m.shape[1]
                held.setdefault(d, []).append((ids[rows][ok], m))
                if sum(len(x) for x, _ in held[d]) >= size:
                    yield from cut(d, False)
        for d in list(held):
            if held[d]:
                yield from cut(d, True)

    return df.mapInArrow(run, BLOCK)


def against_all(shards: DataFrame, tiles: DataFrame, groups: int, search: Callable) -> DataFrame:
    """Sends each query tile to each group of shards. ``search(shards, query ids, queries)`` gives (query row, vec_id, score) arrays.

    A group is a task; its shards stay in the task's memory, the tiles stream past them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["g"] != now:
                    now, held = r["g"], []
                ids = np.frombuffer(r["ids"], np.int64)
                m = np.frombuffer(r["data"], np.float64).reshape(len(ids), r["d"])
                if r["kind"] == 0:
                    held.append(search.prepare(ids, m))
                    continue
                same = [x for x in held if x.dim == r["d"]]
                if same:
                    row, vec, score = search(same, ids, m)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), now), pa.int64()), pa.array(r["block"] * (1 << 16) + row, pa.int64()), pa.array(ids[row], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, search.arrow)], ["g", "query_row", "query_id", "vec_id", "score"])

    sent = tiles.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    dealt = shards.unionByName(sent).repartitionById(groups, F.col("g").cast("int")).sortWithinPartitions("g", "kind", "block")
    return dealt.mapInArrow(run, f"g long, query_row long, query_id long, vec_id long, score {search.kind}")


def merged(parts: DataFrame, k: int, groups: int, fan: int = 16) -> DataFrame:
    """Top lists of the groups merged ``fan`` at a time, then all; ties go to the smaller vec_id."""
    best = [F.desc("score"), F.col("vec_id")]
    while groups > fan:
        parts = parts.withColumn("g", F.floor(F.col("g") / fan).cast("long"))
        groups = -(-groups // fan)
        parts = parts.withColumn("r", F.row_number().over(W.partitionBy("query_row", "g").orderBy(*best))).where(F.col("r") <= k).drop("r")
    top = parts.withColumn("rank", F.row_number().over(W.partitionBy("query_row").orderBy(*best))).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].alias("v")).where("vec_id is not null and v is not null")
