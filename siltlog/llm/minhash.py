"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``m`` sub-keys are made from ``t`` minhashes each; a table's key is a pair, one of either collection, so 2 m t minhashes
serve m * m tables of 2 t rows. At the threshold s a linked pair shares no key with a probability of 1 - (1 - (1 - s^t)^m)^2 (2e-5 for s = 0.85, t = 3, m = 12).

Documents with the same shingle set are one node. A node whose sub-keys of either collection nobody shares is in no common table and is
done. In the tables, nodes are first compared with one hub a bucket, for two rounds with other hubs. Buckets that then still hold more than one
component are resolved as a whole by ``all_links``: so no link that the tables show is left out, and copies are never expanded into pairs.
Every link is confirmed on the full shingle sets.

Nulls: a null or blank text has an empty set and is linked with nothing; a row with a null id is linked with nothing, its component_id is null and it is
kept. Rows that repeat an id count as one document. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, lean, table, utf8_views
from .components import components

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
BASE, BASE_INV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 17, min(2 * self.n, self.n + (1 << 18)))
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(self.n - 1, b, np.uint64)]))
            self.up, self.down = grow(BASE), grow(BASE_INV)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text's bytes, in order."""
    if not len(raw):
        return np.zeros(0, np.uint64)
    b = LOWER[raw]
    edge = np.diff(np.concatenate([[False], ~BLANK[b], [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.upto(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(b.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_set(raw: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words, where there are fewer."""
    w = word_hashes(raw)
    if not len(w):
        return w
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def sub_keys(s: np.ndarray, t: int, m: int) -> np.ndarray:
    """2 m sub-keys of t minhashes each; the first m belong to one collection, the rest to the other."""
    k = 2 * m * t
    a = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    c = mix(a)
    least = np.full(k, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 2048):
        least = np.minimum(least, (s[None, at : at + 2048] * a[:, None] + c[:, None]).min(axis=1))
    rows, key = least.reshape(2 * m, t), np.arange(2 * m, dtype=np.uint64)
    for i in range(t):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, i])
    return key


def sketches(docs: DataFrame, width: int, t: int, m: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8_views(b.column(1))
            sets = [shingle_set(raw[off[i] : off[i + 1]], width) for i in range(b.num_rows)]
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            subs = [sub_keys(s, t, m).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(subs, pa.list_(pa.int64()))], ["doc_id", "n", "sig", "subs"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, sig binary, subs array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8_views(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(raw[off[i] : off[i + 1]], width).tobytes() for i in range(b.num_rows)], pa.binary())], ["node", "items"])

    return docs.mapInArrow(lean(run), "node long, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) with 100 * intersection >= percent * union."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a, b = sets.select(F.col("node").alias("u"), F.col("items").alias("x")), sets.select(F.col("node").alias("v"), F.col("items").alias("y"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(lean(run), "u long, v long")


def mixed_only(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the keys that more than one label has."""
    some = rows.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(*key)
    return rows.join(some, key, "left_semi")


def relabelled(stage: Stage, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining those of each link's ends."""
    a, b = labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    roots = components(stage, links.join(a, "u").join(b, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    step = roots.select(F.col("node").alias("label"), F.col("root"))
    return stage.put(labels.join(step, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def all_links(stage: Stage, groups: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Labels after every link within the groups (node, g), without comparing all pairs.

    c is the set of the shingles that most of a group have; a node lacks a of them and has b others. Of two nodes u, v the intersection is
    |c| - a_u - a_v + k, k the number of differences from c that both have. So with w = 100 a + percent b, nodes with w_u + w_v <= (100 - percent) |c| are
    linked, whatever k is; as the sum is additive, each that has such a partner is so linked with the node of least w, and a star says all of it. Any other
    link needs a shared difference. In the same way a star for each difference says all links that need one; pairs that may share as many more as they need come from
    ``possible_pairs`` and are confirmed on the full sets.
    """
    member = stage.put(groups.join(labels, "node").join(sets, "node").select("g", "node", "label", "items"), "member")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            g = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(np.concatenate(own), pa.int64())], ["g", "item"])

    size = member.groupBy("g").agg(F.count("*").alias("size"))
    often = member.select("g", "items").mapInArrow(lean(count), "g long, item long").groupBy("g", "item").agg(F.count("*").alias("c"))
    # tables of their own, so that Spark can split a large group in the joins with them
    size = stage.put(size, "size")
    common = stage.put(often.join(size, "g").where("2 * c > size").groupBy("g").agg(F.collect_list("item").alias("common")), "common")

    def differences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for x, c in zip(b.column(2), b.column(3), strict=True):
                x, c = np.frombuffer(x.as_buffer(), np.int64), np.array(c.as_py() or [], np.int64)
                d = np.setxor1d(x, c)
                extra = (len(x) + len(d) - len(c)) // 2  # |x - c|
                lacks = len(d) - extra
                for o, v in zip(out, (len(x), len(c), len(c) - lacks, 100 * lacks + percent * extra, d), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(o, pa.int64()) for o in out[:4]], pa.array(out[4], pa.list_(pa.int64()))], ["g", "node", "n", "c", "both", "w", "d"])

    diff = stage.put(member.join(common, "g", "left").select("g", "node", "items", "common").mapInArrow(lean(differences), "g long, node long, n long, c long, both long, w long, d array<long>"), "differences")
    best = stage.put(diff.groupBy("g").agg(F.min(F.struct("w", "node")).alias("m")), "best")
    star = diff.join(best, "g").where(f"node <> m.node and w + m.w <= {100 - percent} * c").select(F.col("node").alias("u"), F.col("m.node").alias("v"))
    labels = relabelled(stage, labels, star)
    # one shared difference: w_u + w_v <= (100 - percent) |c| + 100 + percent is enough, and a star for each difference says all of these
    item = lambda labels_: mixed_only(mixed_only(diff.join(labels_, "node"), ["g"]).select("g", "node", "label", "n", "c", "both", "w", F.explode("d").alias("item")), ["g", "item"])
    shared = stage.put(item(labels), "shared1")
    near = shared.groupBy("g", "item").agg(F.min(F.struct("w", "node", "label")).alias("m"))
    one = shared.join(near, ["g", "item"]).where(f"label <> m.label and w + m.w <= {100 - percent} * c + {100 + percent}")
    labels = relabelled(stage, labels, one.select(F.col("node").alias("u"), F.col("m.node").alias("v")).distinct())
    stage.drop(shared)
    # what is left needs two or more
    rows = stage.put(item(labels), "shared2")
    pairs = stage.put(possible_pairs(stage, rows, percent), "possible")
    out = relabelled(stage, labels, stage.put(confirmed(pairs, sets, percent), "links"))
    stage.drop(member, diff, rows, pairs)
    return out


def possible_pairs(stage: Stage, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with other labels that share as many differences as their link needs, by an exact prefix filter.

    A link needs K = ceil((w_u + w_v - (100 - percent) |c|) / (100 + percent)) shared differences. Only those that nodes of two labels have count; each node's are put in order, rarest
    first. The first one that a linked pair shares leaves K - 1 others behind it in both orders. Nodes of a group are dealt to classes of similar w, so that for each class of
    partners a lower bound of K is known; a node posts its differences up to the place where that many are left, and none where it or the whole class has too few.
    """
    own = ["g", "node", "label", "n", "c", "w"]
    often = rows.groupBy("g", "item").agg(F.count("*").alias("f"))
    nodes = rows.join(often, ["g", "item"]).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("d"))
    nodes = stage.put(nodes.select(*own, F.size("d").alias("size"), F.floor(4 * F.log2(1 + F.col("w") / (100 + percent))).cast("int").alias("class"), F.col("d.item").alias("d")), "ordered")
    classes = stage.put(nodes.groupBy("g", "class").agg(F.min("w").alias("least"), F.max("size").alias("most")).withColumnRenamed("class", "partner"), "classes")
    needed = lambda w: F.greatest(F.lit(2), F.ceil((w - (100 - percent) * F.col("c")) / (100 + percent)))
    posted = nodes.join(classes, "g").withColumn("k", needed(F.col("w") + F.col("least"))).where("k <= size and k <= most")
    posted = posted.select(*own, "size", "class", "partner", F.posexplode(F.expr("slice(d, 1, int(size - k + 1))")).alias("place", "item"))
    side = lambda x: [F.col(k).alias(f"{k}_{x}") for k in ("node", "label", "n", "w")] + [(F.col("size") - F.col("place")).alias(f"left_{x}")]
    u = posted.where("class <= partner").select("g", "item", F.col("class").alias("lo"), F.col("partner").alias("hi"), "c", *side("u"))
    v = posted.where("class >= partner").select("g", "item", F.col("partner").alias("lo"), F.col("class").alias("hi"), *side("v"))
    fits = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    met = u.join(v, ["g", "item", "lo", "hi"]).where("label_u <> label_v and (lo < hi or node_u < node_v)").where(fits).where(F.least("left_u", "left_v") >= needed(F.col("w_u") + F.col("w_v")))
    return met.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, t: int = 3, m: int | None = None, hub_rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept. ``m`` is by default the least that misses under 3 of 100,000 linked pairs."""
    if m is None:
        one = lambda m: (1 - (percent / 100) ** t) ** m
        m = next(m for m in range(1, 200) if 1 - (1 - one(m)) ** 2 < 3e-5)
    stage = Stage(docs.sparkSession, "minhash")
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sketch = stage.put(sketches(own, width, t, m), "sketch")
    nodes = stage.put(sketch.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "n", "subs")).alias("x")).select("sig", F.col("x.doc_id").alias("node"), F.col("x.n").alias("n"), F.col("x.subs").alias("subs")), "nodes")

    subs = nodes.select("node", "n", F.posexplode("subs").alias("place", "sub"))
    shared = subs.groupBy("sub").agg(F.count("*").alias("c")).where("c > 1").select("sub")
    lists = subs.join(shared, "sub", "left_semi").groupBy("node", "n").agg(F.collect_list(F.struct("place", "sub")).alias("s"))
    side = lambda cond: F.filter("s", cond)
    lists = lists.select("node", "n", side(lambda x: x.place < m).alias("a"), side(lambda x: x.place >= m).alias("b")).where("size(a) > 0 and size(b) > 0")
    keys = lists.select("node", "n", F.explode("a").alias("a"), "b").select("node", "n", "a", F.explode("b").alias("b")).select(F.xxhash64("a.place", "a.sub", "b.place", "b.sub").alias("key"), "node", "n")
    keys = stage.put(keys, "keys")
    buckets = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    rows = stage.put(keys.join(buckets, "key", "left_semi"), "buckets")
    stage.drop(keys)
    candidates = rows.select("node").distinct()
    sets = stage.put(full_sets(own.join(candidates.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), width), "sets")

    labels = stage.put(candidates.select("node", F.col("node").alias("label")), "labels")
    fits = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    tried = None
    for turn in range(hub_rounds + 1):
        rows = stage.put(mixed_only(rows.join(labels, "node"), ["key"]).select("key", "node", "n", "label"), f"rows{turn}")
        if rows.isEmpty():
            break
        if turn < hub_rounds:
            order = F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "node")
            hub = rows.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("v"), F.col("n").alias("nv"), F.col("label").alias("lv"))).alias("h")).select("key", "h.*")
            pairs = rows.select("key", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("label").alias("lu")).join(hub, "key").where(F.col("lu") != F.col("lv")).where(fits)
            pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["u", "v"], "left_anti")
            pairs = stage.put(pairs, f"pairs{turn}")
            tried = pairs if tried is None else tried.unionByName(pairs)
            labels = relabelled(stage, labels, stage.put(confirmed(pairs, sets, percent), f"links{turn}"))
        else:
            hub = rows.groupBy("key").agg(F.min("node").alias("u"))
            groups = components(stage, rows.select("key", F.col("node").alias("v")).join(hub, "key").select("u", "v")).withColumnRenamed("root", "g")
            labels = all_links(stage, groups, sets, labels, percent)
        rows = rows.select("key", "node", "n")

    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    of_node = labels.join(least, "label").select("node", "component")
    member = nodes.select("sig", "node").join(of_node, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    out = sketch.select("doc_id", "n", "sig").join(member, "sig", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
