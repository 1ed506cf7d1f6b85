"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans; labelers vote on each: its strict shape, its check digits or ranges, a gazetteer (top-level domains, card issuers,
calling codes, address blocks), words before it, and what stands next to it. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, without any labels; a logistic span classifier is then trained on the posteriors. Spans of the
base patterns always stay; spans that only the further patterns propose (those swallowed by a longer run of digits, or written out)
are added where they are valid and the classifier accepts them.

What reaches the driver is the count of each vote pattern: at most 4 * 2**5 rows. Positions are prefix sums of the lengths between matches, in blocks.

Nulls: a null text is empty and has no spans; a null id is kept. Repeated rows each get a row, an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, with possessive runs (nothing after a run could match what it gives back) and starts only where a run begins or the
#: last match ended, so that long runs are read once. The card pattern matches the runs of 13 to 19 digits alone, as others are dropped.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": ("@",), "phone": ("+",), "more_email": ("[", "("), "more_phone": ("(",)}
SHAPES = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$|[\[(]",
    "ip": r"^([1-9][0-9]{0,2}|0)(\.([1-9][0-9]{0,2}|0)){3}$",
    "card": r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([\x20-]?)[0-9]{6}\2[0-9]{5}$",
    "phone": r"^(\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}$",
}
GAZETTEERS = {
    "email": r"(?i)[.\x20)\]](com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|nl|pl|se|ch|at|be|uk|us|ca|au|in|jp|cn|br|mx)$",
    "ip": r"^([1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|30[0-5]|36|38|35|6011|64[4-9]|65)",
    "phone": r"^\(|^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
WORDS_BEFORE = {
    "email": r"(?i)(e-?mail|mail|contact|write|reply|from|to)\W{0,4}$",
    "ip": r"(?i)(ip|address|host|server|addr|from)\W{0,4}$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|debit|payment|number)\W{0,4}$",
    "phone": r"(?i)(phone|tel|telephone|call|mobile|cell|fax|dial|number)\W{0,4}$",
}
VOTES = 5
BLOCK = 256


def prefix_sums(x: Column) -> Column:
    """Inclusive prefix sums of an array of numbers; blocks keep the work near linear."""
    n = F.size(x)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<bigint>>"))
    sums = F.transform(blocks, total)
    inner = F.transform(F.sequence(F.lit(1), F.size(blocks)), lambda b: F.transform(F.element_at(blocks, b), lambda v, i: total(F.slice(sums, 1, b - 1)) + total(F.slice(F.element_at(blocks, b), 1, i + 1))))
    return F.when(n > 0, F.flatten(inner)).otherwise(F.array().cast("array<bigint>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 1, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The conditions of the base patterns that a pattern can't state."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        return n.between(13, 19) & luhn(digits)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(small(p)) <= 3) & (small(p).substr(1, 3).cast("int") <= 255))
    return F.lit(True)


def votes(kind: str, match: Column, before: Column, after: Column) -> Column:
    """Bits of the labelers: shape, check, gazetteer, words before, neighbours."""
    apart = before.rlike(r"(^|[\s\"'(<\[:;,=|])$") & after.rlike(r"^($|[\s\"')>\]:;,.!?|*#%&$])")
    said = [match.rlike(SHAPES[kind]), valid(kind, match), match.rlike(GAZETTEERS[kind]), F.right(before, F.lit(40)).rlike(WORDS_BEFORE[kind]), apart]
    out = F.lit(0)
    for i, v in enumerate(said):
        out = out + F.when(v, 1 << i).otherwise(0)
    return out.cast("int")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for each kind, ``<kind>`` (base spans) and ``more_<kind>`` (other proposed spans): arrays of (start, end, votes, ok)."""
    df = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    patterns = {k: (k, p) for k, p in BASE.items()} | {f"more_{k}": (k, p) for k, p in MORE.items()}
    df = df.withColumns({f"m_{name}": matches(name, p, "text") for name, (_, p) in patterns.items()})
    df = df.withColumns({f"g_{name}": gaps(f"m_{name}", p, "text") for name, (_, p) in patterns.items()}).drop("text")
    df = df.withColumns({f"s_{name}": starts(name) for name in patterns})
    df = df.select("doc_id", *[spans(name, kind).alias(name) for name, (kind, _) in patterns.items()])
    return df.withColumns({f"more_{kind}": apart(kind) for kind in MORE})


def matches(name: str, pattern: str, text: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if name in NEEDS:
        some = F.lit(False)
        for x in NEEDS[name]:
            some = some | F.contains(text, F.lit(x))
        found = F.when(some, found).otherwise(F.array().cast("array<string>"))
    return found


def gaps(matches_: str, pattern: str, text: str) -> Column:
    """What lies before, between and behind the matches."""
    return F.when(F.size(matches_) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def starts(name: str) -> Column:
    m, g = F.col(f"m_{name}"), F.col(f"g_{name}")
    return prefix_sums(F.transform(m, lambda x, i: (F.char_length(g[i]) + F.when(i > 0, F.char_length(m[F.greatest(i - 1, F.lit(0))])).otherwise(0)).cast("long")))


def spans(name: str, kind: str) -> Column:
    m, g, s = F.col(f"m_{name}"), F.col(f"g_{name}"), F.col(f"s_{name}")
    found = F.transform(m, lambda x, i: F.struct(s[i].alias("start"), (s[i] + F.char_length(x)).alias("end"), votes(kind, x, g[i], g[i + 1]).alias("votes"), valid(kind, x).alias("ok")))
    return F.filter(found, lambda x: x.ok) if name in BASE else found


def apart(kind: str) -> Column:
    """Spans of the further pattern that touch no base span of the kind."""
    base = F.col(kind)
    return F.filter(f"more_{kind}", lambda x: ~F.exists(base, lambda b: (b.start < x.end) & (x.start < b.end)))


def reliabilities(counts: dict[int, float], rounds: int = 60) -> tuple[float, list[list[float]], dict[int, float]]:
    """Expectation-maximisation for two classes and independent labelers: share of real spans, chance of a vote in either class, posterior of each vote pattern."""
    bit = lambda p, j: p >> j & 1
    post = {p: 0.05 + 0.9 * sum(bit(p, j) for j in range(VOTES)) / VOTES for p in counts}
    share, chance = 0.5, [[0.5] * VOTES, [0.5] * VOTES]
    for _ in range(rounds):
        weight = [sum(c * (1 - post[p]) for p, c in counts.items()), sum(c * post[p] for p, c in counts.items())]
        share = (weight[1] + 1) / (weight[0] + weight[1] + 2)
        for k in (0, 1):
            # a labeler is taken to be somewhat better than chance until the counts say otherwise
            for j in range(VOTES):
                yes = sum(c * (post[p] if k else 1 - post[p]) * bit(p, j) for p, c in counts.items())
                chance[k][j] = (yes + (3 if k else 1)) / (weight[k] + 4)
        for p in counts:
            log = [math.log(1 - share), math.log(share)]
            for k in (0, 1):
                for j in range(VOTES):
                    log[k] += math.log(chance[k][j] if bit(p, j) else 1 - chance[k][j])
            post[p] = 1 / (1 + math.exp(max(-50, min(50, log[0] - log[1]))))
    return share, chance, post


def span_classifier(counts: dict[int, float], post: dict[int, float], steps: int = 400, rate: float = 0.5, ridge: float = 0.01) -> list[float]:
    """Logistic weights (intercept, then one a vote) trained on the posteriors; patterns weigh as the root of their counts."""
    w = [0.0] * (VOTES + 1)
    rows = [([1.0] + [float(p >> j & 1) for j in range(VOTES)], post[p], math.sqrt(c)) for p, c in counts.items()]
    total = sum(c for *_, c in rows) or 1.0
    for _ in range(steps):
        step = [ridge * x for x in w]
        for x, y, c in rows:
            e = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x, strict=True)))))) - y
            step = [s + c / total * e * a for s, a in zip(step, x, strict=True)]
        w = [a - rate * b for a, b in zip(w, step, strict=True)]
    return w


def learn(found: DataFrame) -> dict[str, list[float]]:
    """Weights of each kind's span classifier from the vote patterns of all candidates."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.transform(n, lambda x: x.votes).alias("votes")) for k, n in [(k, k) for k in BASE] + [(k, f"more_{k}") for k in MORE]])
    rows = found.select(F.explode(kinds).alias("x")).select("x.kind", F.explode("x.votes").alias("votes")).groupBy("kind", "votes").count().collect()
    out = {}
    for kind in KINDS:
        counts = {r.votes: float(r["count"]) for r in rows if r.kind == kind}
        out[kind] = span_classifier(counts, reliabilities(counts)[2]) if counts else [-9.0] + [0.0] * VOTES
    return out


def accepts(w: list[float]):
    def accepted(x: Column) -> Column:
        score = F.lit(w[0])
        for j in range(VOTES):
            score = score + F.when(x.votes.bitwiseAND(1 << j) > 0, w[j + 1]).otherwise(0.0)
        return x.ok & (score > 0)

    return accepted


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and for each kind ``<kind>`` (base spans) and ``all_<kind>`` (with what the method adds): arrays of (start, end), by start."""
    found = Stage(docs.sparkSession, "pii").put(candidates(docs, id_col, text_col), "candidates")
    weights = learn(found)
    span = lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))
    out = [F.col("doc_id")]
    for kind in KINDS:
        base = F.transform(kind, span)
        out.append(base.alias(kind))
        out.append((F.array_sort(F.concat(base, F.transform(F.filter(f"more_{kind}", accepts(weights[kind])), span))) if kind in MORE else base).alias(f"all_{kind}"))
    return found.select(*out)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with each span, base or accepted, replaced by its kind in angle brackets, kind after kind; null texts stay null.

    A text is put together again from what lies between the matches, so the work is linear in its length.
    """
    weights = learn(candidates(docs, id_col, text_col))
    order = [(k, k, p) for k, p in BASE.items()] + [(f"more_{k}", k, p) for k, p in MORE.items()]
    for name, kind, pattern in order:
        docs = docs.withColumn("_m", matches(name, pattern, text_col))
        docs = docs.withColumn("_g", gaps("_m", pattern, text_col))
        docs = docs.withColumn(text_col, F.when(F.size("_m") > 0, refilled(name, kind, weights)).otherwise(F.col(text_col))).drop("_m", "_g")
    return docs


def refilled(name: str, kind: str, weights: dict[str, list[float]]) -> Column:
    m, g, more = F.col("_m"), F.col("_g"), accepts(weights[kind])

    def piece(x: Column, i: Column) -> Column:
        goes = valid(kind, x) if name in BASE else more(F.struct(votes(kind, x, g[i], g[i + 1]).alias("votes"), valid(kind, x).alias("ok")))
        return F.concat(g[i], F.when(goes, f"<{kind.upper()}>").otherwise(x))

    return F.concat(F.array_join(F.transform(m, piece), ""), F.element_at(g, -1))


def shown(spans: dict[str, Column]) -> Column:
    """kind:start:end of all spans, joined by commas."""
    one = lambda k: lambda x: F.concat(F.lit(f"{k}:"), x.start, F.lit(":"), x.end)
    return F.array_join(F.concat(*[F.transform(c, one(k)) for k, c in spans.items()]), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown({k: F.col(k) for k in KINDS}).cast("binary"), 256).alias("base_sha256"), shown({k: F.col(f"all_{k}") for k in KINDS}).alias("spans"))
