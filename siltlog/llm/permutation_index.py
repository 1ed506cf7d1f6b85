"""Approximate nearest neighbours with a permutation index.

Each vector is represented by the order of its nearest pivots. A shard posts its vectors in an inverted file a pivot: the pivot's place in the
order of each vector, L where it isn't among the first L. (More than a third of the vectors are in each file, so a place a vector takes less room than pairs of vector and place, and
files are added up without an index.) A query adds up, over the files of its own pivots, what their places share: with prefixes of length L, the footrule distance
is L(L+1) - 2 * sum(L - max(place in query, place in vector)) over the common pivots. The vectors of least distance are reranked by cosine in double precision.

The pivots are a bounded sample (``pivots`` vectors, the smallest id hashes); every vector is indexed. All vectors tied at the
rerank depth are reranked; where a shard's files hold fewer than k + 1 vectors for a query, the whole shard is ranked.

Of equal vectors only the k + 1 smallest ids can be among k nearest, so only these are posted. Vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id. Vectors of different lengths don't meet. A query leaves out rows with its own id;
repeated query rows each get a list. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import rows_for, table
from .dense import against_all, blocks, merged, usable


def nonzero(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = (np.abs(m) > 0).any(axis=1)
    return ok, m[ok]


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component: cosines stay as they are to the last bit, and no square over- or underflows."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def prefixes(m: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each row, nearest first, ties to the smaller pivot number."""
    near = -(unit(m) @ pivots.T)
    order = np.argsort(near, axis=1)
    got = np.take_along_axis(near, order, axis=1)
    tied = (got[:, 1:] == got[:, :-1]).any(axis=1)
    order[tied] = np.argsort(near[tied], axis=1, kind="stable")
    return order[:, :length]


@dataclass
class Posted:
    ids: np.ndarray
    data: np.ndarray
    norms: np.ndarray
    files: np.ndarray  # pivot by vector: the pivot's place, or the prefix length

    @property
    def dim(self) -> int:
        return self.data.shape[1]


class PermutationSearch:
    arrow, kind = pa.float64(), "double"

    def __init__(self, pivots: dict[int, np.ndarray], k: int, length: int, depth: float):
        if length > 181:
            raise ValueError("sums of places of a prefix of over 181 pivots do not fit 16 bits")
        self.pivots, self.k, self.length, self.depth = pivots, k, length, depth

    def of(self, d: int) -> np.ndarray:
        return self.pivots.get(d, np.eye(1, d))  # no pivot of this length: one that all share, so all are ranked

    def prepare(self, ids: np.ndarray, m: np.ndarray) -> Posted:
        pivots, m = self.of(m.shape[1]), scaled(m)
        p = prefixes(m, pivots, self.length)
        files = np.full((len(pivots), len(m)), p.shape[1], np.int16)
        files[p, np.arange(len(m))[:, None]] = np.arange(p.shape[1], dtype=np.int16)
        return Posted(ids, m, np.sqrt((m * m).sum(axis=1)), files)

    def __call__(self, shards: list[Posted], ids: np.ndarray, queries: np.ndarray):
        pivots, queries = self.of(queries.shape[1]), scaled(queries)
        orders = prefixes(queries, pivots, self.length)
        length, norms = orders.shape[1], np.sqrt((queries * queries).sum(axis=1))
        rows, vecs, scores = [], [], []
        for s in shards:
            n = len(s.ids)
            depth = max(self.k + 1, 200, int(np.ceil(self.depth * n)))
            apart, later = np.empty(n, np.int16), np.empty(n, np.int16)
            places = np.repeat(np.arange(length, dtype=np.int16)[:, None], n, axis=1)  # whole rows: a scalar takes four times as long
            for i, order in enumerate(orders):
                apart[:] = 0
                for place, j in zip(places, order, strict=True):
                    np.maximum(s.files[j], place, out=later)
                    np.add(apart, later, out=apart)
                shared = length * length - apart
                least = 1 if depth >= n else max(1, int(np.partition(shared, n - depth)[n - depth]))
                found = np.flatnonzero(shared >= least)
                if len(found) <= self.k:
                    found = np.arange(n)
                found = found[s.ids[found] != ids[i]]
                cosine = (s.data[found] * queries[i]).sum(axis=1) / (s.norms[found] * norms[i])
                best = np.lexsort((s.ids[found], -cosine))[: self.k]
                rows.append(np.full(len(best), i))
                vecs.append(s.ids[found[best]])
                scores.append(cosine[best])
        return tuple(map(np.concatenate, (rows, vecs, scores)))


def choose_pivots(vectors: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """At most 4 * ``pivots`` vectors come to the driver; the first distinct ones in the order of the id's hash are the pivots."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()
    out: dict[int, list] = {}
    for r in got:
        v = np.array([np.nan if x is None else x for x in r.v], np.float64)
        if len(v) and np.isfinite(v).all() and np.abs(v).max() > 0:
            u = unit(v[None])[0]
            own = out.setdefault(len(v), [])
            if len(own) < pivots and not any(np.array_equal(u, w) for w in own):
                own.append(u)
    return {d: np.array(v) for d, v in out.items()}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 256, length: int = 96, depth: float = 0.08, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = 4096, tile: int = 256, group_rows: int = 16_384) -> DataFrame:
    """``depth``: the share of a shard (200 vectors at least) that is reranked for a query, besides ties. ``queries`` has the columns of ``vectors``."""
    own = usable(vectors, id_col, vec_col)
    groups = rows_for(vectors.count(), group_rows, 12)
    first = own.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("vec_id", "v")
    search = PermutationSearch(choose_pivots(own, pivots), k, length, depth)
    parts = against_all(blocks(first, nonzero, shard, groups), blocks(usable(queries, id_col, vec_col), nonzero, tile, None), groups, search)
    return merged(parts, k, groups)


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return nearest(v, v.where(F.col("vec_id") % 50 == 0))
