"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline as C
import pytest
from siltlog.llm import queries
from siltlog.llm.language_id import has_letter

from .helpers import ODD, frame, prose


def test_each_operator_has_one_query():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_on_a_small_corpus(spark, tmp_path):
    passage = prose(7, 60)
    base = prose(1, 120)
    texts = ODD + [base, base, base.replace(" ", "  ", 1), prose(2, 40) + " " + passage + " " + prose(3, 40), prose(4, 40) + " " + passage + " " + prose(5, 40), prose(6, 30) + " me@mail.com"]
    docs = frame(spark, texts, langs=["en"] * len(texts))
    docs = docs.unionByName(frame(spark, ["x y"], ids=[None]))
    sizes = []
    for name, step in C.STAGES:
        out = step(spark, docs, None)
        if name != "packing":
            assert out.columns == C.COLUMNS
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        sizes.append(docs.count())
        rows = {r.doc_id: r for r in docs.collect()}
        first = len(ODD)
        if name == "language ID":
            assert set(rows) == {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")} | {None}
        if name == "MinHash near-dedup":
            assert first in rows and first + 1 not in rows and first + 2 not in rows and None in rows
        if name == "suffix-array dedup":
            assert passage in rows[first + 3].text and passage[40:-40] not in rows[first + 4].text and rows[first + 4].text.startswith(prose(4, 40))
        if name == "PII":
            assert rows[first + 5].text.endswith("<EMAIL>")
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3]


def test_texts_stay_without_a_language_to_learn(spark):
    """No row has a lang, or all that have one are long."""
    texts = [prose(i, 20) for i in range(6)] + ["12 34", None]
    rows = C.language(spark, frame(spark, texts), None).collect()
    assert {(r.doc_id, r.lang) for r in rows} == {(i, "und") for i in range(6)}
    long = [f"{w} " * 4000 for w in ("the house and the cat", "le chat de la maison")] * 4 + ["le chat est de la maison"]
    rows = C.language(spark, frame(spark, long, langs=["en", "fr"] * 4 + [None]), None).collect()
    assert {r.doc_id: r.lang for r in rows} == dict(enumerate(["en", "fr"] * 4 + ["fr"]))


def test_letters_are_those_of_language_id(spark):
    """One rule decides which texts have a letter: also for letters that the JVM's older Unicode tables lack."""
    texts = ["\U0001df00\U0001df01", "\U00031350", "12 \U00011f04", "½ ² Ⅷ", "12 34", "é"]
    rows = C.language(spark, frame(spark, texts, langs=["en"] * len(texts)), None).collect()
    assert {r.doc_id for r in rows} == {i for i, t in enumerate(texts) if has_letter(t)} == {0, 1, 2, 5}


def test_run_on_a_table(spark, tmp_path):
    frame(spark, [prose(i, 60) for i in range(8)], langs=["en"] * 8).write.parquet(str(tmp_path / "documents.parquet"))
    rows = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(range(8))


def test_an_empty_table(spark):
    docs = frame(spark, ["x"]).where("false")
    for _, step in C.STAGES:
        assert step(spark, docs, None).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
