"""Exact top-k inner products: query tiles times shards, a partial selection per tile, top lists merged as a tree.

Components x become floor(64 x). Scores are exact integers: one product in double precision where the bound of a tile stays under
2**53, else products of digits, summed as Python integers and kept within a long.

Nulls: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id. Vectors of
different lengths don't meet. A query leaves out every row with its own id; repeated query rows each get a list. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_for, table
from .dense import against_all, blocks, merged, usable


def whole(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ones(len(m), bool), np.floor(64 * m)


@dataclass
class Shard:
    ids: np.ndarray
    data: np.ndarray
    most: float

    @property
    def dim(self) -> int:
        return self.data.shape[1]


#: Scores beyond a long are kept at its ends.
MOST = 2**63 - 1


def limbs(m: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole numbers in double precision as digits of ``bits`` bits, the lowest first; splitting by powers of two is exact."""
    out = []
    while np.abs(m).max(initial=0) > 0:
        high = np.floor(np.abs(m) / 2.0**bits) * np.sign(m)
        out.append(m - high * 2.0**bits)
        m = high
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows as long numbers. Products of digits stay under 2**52 in double precision, their sums are Python integers."""
    bits = max(1, (50 - int(a.shape[1]).bit_length()) // 2)
    total = np.zeros((len(a), len(b)), object)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            total = total + (x @ y.T).astype(np.int64).astype(object) * (1 << bits * (i + j))
    return np.clip(total, -MOST, MOST).astype(np.int64)


class InnerProducts:
    arrow, kind = pa.int64(), "long"

    def __init__(self, k: int):
        self.k = k

    def prepare(self, ids: np.ndarray, m: np.ndarray) -> Shard:
        order = np.argsort(ids, kind="stable")
        return Shard(ids[order], m[order], float(np.abs(m).max(initial=0)))

    def __call__(self, shards: list[Shard], ids: np.ndarray, queries: np.ndarray):
        most = float(np.abs(queries).max(initial=0))
        rows, vecs, scores = [], [], []
        for s in shards:
            n = len(s.ids)
            bound = most * s.most * s.dim
            p = (queries @ s.data.T).astype(np.int64) if bound < 2.0**53 else exact_products(queries, s.data)
            a, b = np.searchsorted(s.ids, ids, "left"), np.searchsorted(s.ids, ids, "right")
            k = min(self.k + int((b - a).max(initial=0)), n)  # a query's own rows are left out afterwards
            # of equal scores the smaller id first: a shard is in the order of its ids
            if bound * n < 2.0**62:
                best = np.argpartition(np.arange(n) - p * n, k - 1, axis=1)[:, :k]
            else:
                best = np.argsort(-p, axis=1, kind="stable")[:, :k]
            q, j = np.repeat(np.arange(len(ids)), k), best.ravel()
            keep = s.ids[j] != ids[q]
            rows.append(q[keep])
            vecs.append(s.ids[j[keep]])
            scores.append(p[q[keep], j[keep]])
        row, vec, score = map(np.concatenate, (rows, vecs, scores))
        order = np.lexsort((vec, -score, row))  # one list a query
        row, vec, score = row[order], vec[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(ids)))[row] < self.k
        return row[keep], vec[keep], score[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = 4096, tile: int = 512, group_rows: int = 16_384) -> DataFrame:
    """``queries`` has the columns of ``vectors``. A group holds about ``group_rows`` vectors, which is what one task keeps in memory."""
    groups = rows_for(vectors.count(), group_rows, 12)
    parts = against_all(blocks(usable(vectors, id_col, vec_col), whole, shard, groups), blocks(usable(queries, id_col, vec_col), whole, tile, None), groups, InnerProducts(k))
    return merged(parts, k, groups)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return top_k(v, v.where(F.col("vec_id") % 20 == 0))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 20
"""
