import zlib

from pyspark.sql import functions as F

from siltlog.llm import language_id, toxicity

from ..conftest import DATA
from .helpers import ODD, frame, prose

SF = str(DATA / "sf0.01")


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)


def test_language_edge_cases(spark):
    texts = ODD + ["the cat of the house and", "le chat de la maison et", "THE CAT"] * 3
    langs = [None] * len(ODD) + ["en", "fr", None] * 3
    got = {r.doc_id: r for r in language_id.identify(frame(spark, texts, langs=langs)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i, t in enumerate(texts) if not any(c.isalpha() for c in t or ""))
    assert {got[i].lang_pred for i in range(len(ODD), len(texts))} <= {"en", "fr"}
    null = language_id.identify(frame(spark, ["abc"], ids=[None])).collect()
    assert [(r.doc_id, r.held_out, r.lang_pred) for r in null] == [(None, False, "und")]
    assert language_id.identify(frame(spark, ["x"]).where("false")).count() == 0


def test_kernel_is_the_set_kernel():
    g = language_id.Grams()
    x = g("abcab")
    assert len(x) == len({"a", "b", "c", "ab", "bc", "ca", "abc", "bca", "cab", "abca", "bcab"}) == len(set(x.tolist()))


def test_toxic_words_are_found_and_clean_documents_left(spark):
    sf = str(DATA / "sf0.1")
    words = "trash|pathetic|worthless|idiot|loser|disgusting|scum|moron|clown|stupid"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lower("text").rlike(rf"\b({words})\b").alias("hit"))
    n = {(r.hit, r.predicted): r["count"] for r in toxicity.op10_toxicity(spark, sf).join(docs, "doc_id").groupBy("hit", "predicted").count().collect()}
    assert n[True, 1] > 0.7 * (n[True, 1] + n[True, 0])
    assert n.get((False, 1), 0) < 0.05 * n[False, 0]


def test_toxic_documents_of_every_language_are_found(spark):
    """All held-out labelled documents count, by label alone."""
    sf = str(DATA / "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet").dropDuplicates(["doc_id"]) for x in ("documents", "labels"))
    rows = toxicity.op10_toxicity(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").select("lang", "toxic", "predicted").collect()

    def share(y, *langs):
        own = [r.predicted for r in rows if r.toxic == y and (not langs or r.lang in langs)]
        return sum(own) / len(own)

    assert share(1) > 0.8 and share(1, "de", "es", "fr") > 0.7
    assert share(0) < 0.03


def test_toxic_strings_and_weights_do_not_depend_on_the_number_of_documents(spark):
    plain = [prose(i, 30) for i in range(60)]
    toxic = [f"{prose(100 + i, 30)} vorkzam{i % 4} vorkzam" for i in range(20)]
    marks = {n: set(toxicity.toxic_content(toxic * n, plain * n).decode().split("|")) for n in (20, 40, 100)}
    assert marks[20] == marks[40] == marks[100] and " vorkzam" in marks[20]
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) * 4 for i in range(400)]
    many = toxicity.toxic_content([" ".join(words)] * 20, plain * 20).decode().split("|")
    assert {" " + w for w in words} <= set(many)
    docs = frame(spark, [prose(i, 5) for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, toxic int")
    can = [sum(zlib.crc32(str(i).encode()) % 5 != 0 and (i % 10 == 0) == y for i in range(200)) for y in (False, True)]
    rows, of = toxicity.labelled(docs, labels, 10, 1000)
    assert [sum(y == k for _, y in rows) for k in (0, 1)] == [10, 10] and of == (can[0] / 10, can[1] / 10)
    x, y = toxicity.np.ones((20, 1)), toxicity.np.array([z for _, z in rows], float)
    w = toxicity.logistic(x, y, toxicity.np.array([of[z] for _, z in rows]), ridge=0.0)
    assert abs(1 / (1 + toxicity.np.exp(-w[0])) - can[1] / sum(can)) < 1e-6


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(frame(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score_toxicity(frame(spark, ["x"]).where("false"), labels).count() == 0


def test_signs_that_are_no_letters_have_no_language(spark):
    from siltlog.llm.language_id import has_letter, identify

    from .helpers import frame

    assert [has_letter(x) for x in ("²", "½ ①", "Ⅷ", "_1", "é", "1ª", "語")] == [False, False, False, False, True, True, True]
    df = frame(spark, ["² ½ ① Ⅷ", "the cat and the dog", "der Hund und die Katze"] * 2, langs=[None, "en", "de"] * 2)
    assert [x.lang_pred for x in identify(df).orderBy("doc_id").collect()][::3] == ["und", "und"]


def test_kernel_is_shared_grams_over_the_roots():
    """The kernel of the model against sets of byte n-grams."""
    from siltlog.llm.language_id import Grams, fit

    def grams(t):
        b = t.lower().encode()
        return {b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)}

    rows = [("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("and then the dog", "en"), ("ich bin ein berliner", "de")]
    model, texts = fit(rows, landmarks=2), ["the dog and der hund", "zzz qqq", "katze"]
    chosen = [t for lang in ("de", "en") for t, x in rows if x == lang]
    k = model.kernel(Grams(), texts)
    want = [[len(grams(t) & grams(c)) / (len(grams(t)) * len(grams(c))) ** 0.5 for c in chosen] for t in texts]
    assert abs(k - want).max() < 0.02
    s = k.astype(float) @ model.weights
    assert (model.scores(Grams(), texts).argmax(axis=1) == s.argmax(axis=1)).all()


def test_held_out_labels_of_toxicity(spark):
    """By the labels themselves, of documents that nothing was learnt from."""
    from siltlog.llm.toxicity import op10_toxicity

    sf = str(DATA / "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    n = {(r.toxic, r.predicted): r["count"] for r in op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.02 * (n[0, 0] + n.get((0, 1), 0))
