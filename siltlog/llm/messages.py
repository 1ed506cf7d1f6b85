"""Blocks that exchange packed messages: (key, kind, sub, body) rows, gathered by key in the order of kind and sub."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import lean

MESSAGE = "key long, kind int, sub long, body binary"


def packed(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, 5))


def unpacked(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    key, kind, sub, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(sub, pa.int64()), pa.array(body, pa.binary())], ["key", "kind", "sub", "body"])


def sent(messages: Iterator[tuple[int, int, int, object]], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for key, kind, sub, x in messages:
        body = packed(x)
        rows.append((int(key), kind, int(sub), body))
        size += len(body)
        if size > most or len(rows) >= 4096:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def each(df: DataFrame, step: Callable, schema: str = MESSAGE, out: Callable = sent) -> DataFrame:
    """``step(key, sub, body)`` for each message by itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for b in batches:
                for k, s, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                    yield from step(k, s, unpacked(x.as_py()))

        yield from out(made())

    return df.mapInArrow(lean(run), schema)


def gathered(frames: list[DataFrame], parts: int, step: Callable, schema: str = MESSAGE, out: Callable = sent) -> DataFrame:
    """``step(key, {kind: [(sub, body), ...]})`` for each key, with all of its messages; what one key gets must fit a task's memory."""
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    df = df.repartition(parts, "key").sortWithinPartitions("key", "kind", "sub")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            now, held = None, {}
            for b in batches:
                for k, kind, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                    if k != now:
                        if now is not None:
                            yield from step(now, held)
                        now, held = k, {}
                    held.setdefault(kind, []).append((s, unpacked(x.as_py())))
            if now is not None:
                yield from step(now, held)

        yield from out(made())

    return df.mapInArrow(lean(run), schema)
