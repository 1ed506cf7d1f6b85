"""Toxicity by compression distance.

Two zstandard dictionaries are made, one trained on ordinary text, the other (raw content) of the word starts that recur in toxic documents
far more often than in ordinary ones. The ordinary one also has the ends of these, so that only whole ones save bytes. Each window of a text is compressed with the ordinary dictionary alone and with the toxic one added; the bytes saved are the window's distance.
The weights of how many windows save so many bytes are calibrated on labelled documents that no dictionary saw.

Fitting takes at most ``sample`` labelled documents of each class of at most ``sample_bytes`` bytes each (the
smallest hashes of the id); scoring reads every window of every text.

Nulls: null and empty texts have one empty window. Null ids, null labels and unlabelled rows aren't learnt from; a null id
is kept with ``held_out`` false. Without labels of both classes every score is 0. Repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, texts_of

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: The longest match is taken as it stands: the cost estimates of the optimal parsers leave out most toxic strings of a short window.
PARAMS = zstandard.ZstdCompressionParameters.from_level(3, window_log=17, hash_log=16, chain_log=17, search_log=8, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
WORD, SHORT, LONG = re.compile(r"[^\W\d_]+"), 4, 12
#: Where a word begins behind neither a blank nor a letter.
BEGIN = re.compile(r"(?<=[^\s\w]|[\d_])(?=[^\W\d_])")
#: Bytes a window saves, at least, to count.
STEPS = range(1, 6)


@dataclass
class CompressionModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    window_words: int
    window_step: int

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def distances(self, text: str) -> np.ndarray:
        if self._pair is None:
            self._pair = tuple(zstandard.ZstdCompressor(compression_params=PARAMS, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress for d in (self.ordinary, self.toxic + self.ordinary))
        a, b = self._pair
        n, step = self.window_words, self.window_step
        words = BEGIN.sub(" ", text.lower()).split()
        windows = [(" " + " ".join(words[i : i + n])).encode() for i in range(0, len(words), step)] or [b""]
        return np.fromiter((len(a(w)) - len(b(w)) for w in windows), np.int64, len(windows))

    def features(self, text: str) -> np.ndarray:
        d = self.distances(text)
        hits = [(d >= t).sum() for t in STEPS]
        return np.array([1.0, *[3 * h / len(d) for h in hits], *np.log1p(hits), 3 * np.clip(d, 0, None).mean()])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=3, k=48, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


def starts_of(text: str) -> Counter:
    """The first SHORT to LONG letters of a text's words, behind a blank, and how often each occurs."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall(text)).items():
        if len(w) <= 40:
            for j in range(SHORT, min(len(w), LONG) + 1):
                out[" " + w[:j]] += n
    return out


def toxic_content(toxic: list[str], plain: list[str], times: float = 8.0, docs: float = 4.0, share: float = 0.02) -> bytes:
    """Word starts by which toxic documents stand out; the most telling last. What is asked of them doesn't grow with the number of documents, and none is cut off.

    These occur ``times`` as often, for the length of the text, and in ``docs`` times as many documents as among ordinary ones, and ``share`` of either half of the toxic
    documents has them. Of a start and a longer one that is nearly as common, the longer one stays; rarer ones that begin like it add nothing.
    """
    halves, count = [Counter(), Counter()], Counter()
    for i, t in enumerate(toxic):
        own = starts_of(t)
        count.update(own)
        halves[i % 2].update(own.keys())
    least = max(2, share * len(toxic) / 2)
    can = {x for x, n in halves[0].items() if n >= least and halves[1][x] >= least}
    other, seen = Counter(), Counter()
    for t in plain:
        own = {x: n for x, n in starts_of(t).items() if x in can}
        other.update(own)
        seen.update(own.keys())
    scale, each = sum(map(len, toxic)) / max(1, sum(map(len, plain))), len(toxic) / max(1, len(plain))
    few = max(1.0, len(plain) / 1000)  # added to what ordinary documents have, so that a rare start needs a few more
    above = {x: count[x] / ((other[x] + few) * scale) for x in can}
    marks = {x for x in can if above[x] >= times and halves[0][x] + halves[1][x] >= docs * (seen[x] + few) * each}
    shorter = {(x, x[:k]) for x in marks for k in range(SHORT + 1, len(x)) if x[:k] in marks}
    out = {y for x, y in shorter if count[x] >= 0.7 * count[y]} | {x for x, y in shorter if count[x] < 0.7 * count[y]}
    return "|".join(sorted(marks - out, key=lambda x: (above[x], x))).encode()


def logistic(x: np.ndarray, y: np.ndarray, of: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (of * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (of * (y - p)) - ridge * w)
    return w


def fit(rows: list[tuple[str, int]], stands_for: tuple[float, float] = (1.0, 1.0), window_words: int = 12, window_step: int = 4) -> CompressionModel | None:
    """rows: texts and labels, in an order that has nothing to do with them; every third one calibrates. ``stands_for``: of how many labels each row of class 0 and 1 was drawn."""
    learn, check = [x for i, x in enumerate(rows) if i % 3], rows[::3]
    if len({y for _, y in learn}) < 2 or len({y for _, y in check}) < 2:
        return None
    plain = [t.lower() for t, y in learn if not y]
    toxic = toxic_content([t.lower() for t, y in learn if y], plain)
    parts = [" ".join(["", *w[i : i + 64]]).encode() for t in plain for w in [t.split()] for i in range(0, len(w), 64)]
    pieces = "|".join(y for x in toxic.decode().split("|") for y in (x[:-2], x[2:])).encode()  # so that a part of a string saves nothing
    model = CompressionModel(pieces + b"|" + dictionary(parts[:20_000], 2048), b"|" + toxic + b"|", np.zeros(0), window_words, window_step)
    of = np.array([stands_for[y] for _, y in check], float)
    model.weights = logistic(np.array([model.features(t) for t, _ in check]), np.array([float(y) for _, y in check]), of / of.mean())
    return model


def labelled(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> tuple[list[tuple[str, int]], tuple[float, float]]:
    """A bounded sample in the order of the id's hash, and how many labels of its class each row stands for; the bound is ``sample`` a class, so at most ``2 * sample`` texts come to the driver."""
    order = F.xxhash64("doc_id")
    can = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(crc_mod("doc_id", 5) != 0)
    ids = None
    for y in (0, 1):
        some = can.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text").between(1, sample_bytes))
    got = texts.join(F.broadcast(ids), "doc_id").select(order.alias("h"), "doc_id", "toxic", "text").collect()
    n = {r.toxic: r["count"] for r in can.groupBy("toxic").count().collect()}
    return [(r.text, r.toxic) for r in sorted(got, key=lambda r: (r.h, r.doc_id, r.toxic, r.text))], tuple(max(1.0, n.get(y, 0) / max(1, sample)) for y in (0, 1))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 2000, sample_bytes: int = 32_768, window_words: int = 12, window_step: int = 4) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled(docs, labels, sample, sample_bytes), window_words, window_step))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            s = [m.score(t) if m else 0.0 for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
