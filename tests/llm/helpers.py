import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the and of hain tion ered onth lyat stin wher ously benk dorf quel mente".split()


def frame(spark, texts, ids=None, langs=None):
    """Documents with the ids 0, 1, ... and columns whose names clash with those that operators use."""
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, lang, "src", None) for i, t, lang in zip(ids, texts, langs, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "sig", "node", "key", "label", "score", "votes", "start", "block", "word", "_text", "held_out"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def sha(x):
    return hashlib.sha256(x).hexdigest()


ODD = [None, "", " ", "\n\t ", "a", "é🔑", "\x00", "▁▁ x", "<s> </s> <|endoftext|>x", "A" * 4000, "no letters 12!"[:0] + "123 456!!"]
