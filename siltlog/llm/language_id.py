"""Language of whole texts with string kernels.

The kernel of two texts is the number of byte n-grams (one to four bytes) present in both, over the root of their own
numbers. Landmarks (Nyström) are labelled texts; a one-versus-rest kernel ridge regression on the landmark features gives a score a language.
A batch of texts becomes a presence matrix over the landmarks' n-grams, whose product with the landmark matrix is
the kernel; a second product gives the scores.

Learning takes at most ``sample`` texts a language (smallest id hashes) and reads at most about ``sample_bytes`` bytes of each; every text is
classified whole.

Nulls: a null text, or one with no letter, is ``und`` with score 0; a null id is kept with ``held_out`` false and not learnt from.
Without labels every text is ``und``. Of equal scores the language first by name wins. Repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_mod, lean, table, texts_of

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: Letters, and numbers that aren't digits.
LETTER = re.compile(r"[^\W\d_]")
BITS = 20


def has_letter(text: str) -> bool:
    """Whether a character of a letter category is in it; signs like ½, ² or Ⅷ are none."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


class Grams:
    """Distinct n-grams of a text as numbers under 2**BITS; two n-grams rarely share one."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        parts, code = [], b
        for n in range(1, 5):
            if n > len(b):
                break
            code = b if n == 1 else code[: len(b) - n + 1] << np.uint32(8) | b[n - 1 :]
            parts.append(((code + np.uint32(n * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
        slots = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        at = np.arange(len(slots), dtype=np.int32)
        self.seen[slots] = at  # of equal ones the last stays
        return slots[self.seen[slots] == at]


@dataclass
class KernelModel:
    langs: list[str]
    place: np.ndarray  # of an n-gram among the landmarks' own, 0 if none of them has it
    landmarks: np.ndarray  # n-gram by landmark, each column over the root of its sum
    weights: np.ndarray  # landmark by language

    def kernel(self, grams: Grams, texts: list[str]) -> np.ndarray:
        p = np.zeros((len(texts), len(self.landmarks)), np.float32)
        own = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            g = grams(t)
            p[i, self.place[g]] = 1
            own[i] = max(1, len(g))
        p[:, 0] = 0
        return (p @ self.landmarks) / np.sqrt(own)[:, None]

    def scores(self, grams: Grams, texts: list[str]) -> np.ndarray:
        f = self.kernel(grams, texts).astype(np.float64) @ self.weights
        e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], landmarks: int = 24, ridge: float = 1e-3) -> KernelModel | None:
    """rows: texts and languages in an order that has nothing to do with them; the first ``landmarks`` of each language are landmarks."""
    langs = sorted({x for _, x in rows})
    if not langs:
        return None
    grams = Grams()
    chosen = [t for lang in langs for t in [t for t, x in rows if x == lang][:landmarks]]
    sets = [grams(t) for t in chosen]
    vocab = np.unique(np.concatenate([*sets, np.zeros(1, np.uint32)]))
    place = np.zeros(1 << BITS, np.int32)
    place[vocab] = np.arange(1, len(vocab) + 1)
    matrix = np.zeros((len(vocab) + 1, len(sets)), np.float32)
    for j, g in enumerate(sets):
        matrix[place[g], j] = 1 / np.sqrt(max(1, len(g)))
    model = KernelModel(langs, place, matrix, np.zeros((len(sets), len(langs))))
    value, vector = np.linalg.eigh(model.kernel(grams, chosen).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = np.concatenate([model.kernel(grams, [t for t, _ in rows[a : a + 64]]) for a in range(0, len(rows), 64)]).astype(np.float64) @ root
    y = np.array([[1.0 if x == lang else -1.0 for lang in langs] for _, x in rows])
    each = np.array([1 / max(1, sum(x == k for _, k in rows)) for _, x in rows])[:, None]  # languages weigh the same
    model.weights = root @ np.linalg.solve(z.T @ (z * each) + ridge * np.eye(z.shape[1]), z.T @ (y * each))
    return model


def labelled(docs: DataFrame, sample: int, sample_bytes: int) -> list[tuple[str, str]]:
    """At most ``sample`` texts a language, in the order of the id's hash; of a longer text a piece from its first letter on."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    can = own.where("lang is not null and doc_id is not null").where("text <> ''").where(crc_mod("doc_id", 3) != 1).where(F.col("text").rlike(r"\p{L}"))
    can = can.withColumn("text", F.when(F.octet_length("text") <= sample_bytes, F.col("text")).otherwise(F.substring(F.regexp_extract("text", r"(?s)\p{L}.*", 0), 1, max(1, sample_bytes // 4))))
    first = can.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("r") <= sample)
    got = first.select("h", "doc_id", "text", "lang").collect()
    return [(r.text, r.lang) for r in sorted(got, key=lambda r: (r.h, r.doc_id, r.text, r.lang)) if has_letter(r.text)]


def identify(docs: DataFrame, sample: int = 250, sample_bytes: int = 8192, landmarks: int = 24, carry: tuple[str, ...] = (), lettered: bool = False) -> DataFrame:
    """One row a document. ``carry``: names of columns to take along behind ``score``, as they are (string or long); ``lettered``: rows without a letter in their text go."""
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled(docs, sample, sample_bytes), landmarks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, grams = model.value, Grams()
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                b = whole.slice(a, 64)
                texts = texts_of(b.column(2))
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                some = list(map(has_letter, texts))
                can = [i for i, letter in enumerate(some) if m and letter]
                if can:
                    s = m.scores(grams, [texts[i] for i in can])
                    for i, row in zip(can, s, strict=True):
                        lang[i], score[i] = m.langs[int(row.argmax())], float(row.max())
                out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(score), *b.columns[3:]], ["doc_id", "held_out", "lang_pred", "score", *b.schema.names[3:]])
                yield out.filter(pa.array(some)) if lettered else out

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    kinds = dict(docs.dtypes)
    return own.mapInArrow(lean(run), SCHEMA + "".join(f", _{c} {kinds[c]}" for c in carry))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
