"""A corpus from raw documents to packed sequences: language, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltlog.llm.common import Stage, table
from siltlog.llm.language_id import identify
from siltlog.llm.minhash import near_duplicates
from siltlog.llm.packing import pack_documents
from siltlog.llm.pii import redact
from siltlog.llm.suffix_array import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a repeated passage; 51 words are 101 bytes at least.
PASSAGE_BYTES = 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text, or without a letter in it, go; an unknown ``lang`` is filled in, with 'und' where no row has one to learn from.

    Of equal scores the language first by name wins; repeated rows and null ids stay, an empty table stays empty."""
    got = identify(docs, carry=("text", "lang", "source", "n_chars"), lettered=True)
    return got.select("doc_id", F.col("_text").alias("text"), F.coalesce("_lang", "lang_pred").alias("lang"), F.col("_source").alias("source"), F.col("_n_chars").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, a similarity of 0.8 or more); of rows that repeat an id, one."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.select(COLUMNS).join(kept, "doc_id", "left_semi")
    one = stay.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).where("r = 1")
    return one.select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out of the text. Rows with a null id stay as they are; a null text is empty, an empty table stays empty."""
    known = docs.where("doc_id is not null").select(COLUMNS)
    left = remove_repeats(known, PASSAGE_BYTES, with_text=True).select("doc_id", F.col("kept_text").alias("text"))
    out = known.select("doc_id", "lang", "source").join(left, "doc_id")
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars")).unionByName(docs.where("doc_id is null").select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets. Every row stays, repeated ones and those with a null id too."""
    out = redact(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens, a row a piece with its ids. A null or empty text has its end token only; repeated rows each get pieces, an empty table gives none."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", passages), ("PII", personal_data), ("packing", packing)]
#: No stage can be stated in SQL; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage.put(docs, f"stage{i + 1}")
    return docs
