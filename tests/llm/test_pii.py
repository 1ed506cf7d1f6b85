import re

from siltlog.llm.pii import KINDS, find_personal_data, op8_pii, redact

from ..conftest import DATA
from .helpers import ODD, frame, sha

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = ODD + [
    "🔑 mail a.b@c.d_e@f.g and .x@y.z, no@dot, a@b..c a@1.2.3.4 x@y.z@w.v",
    "ips 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3 9999999999999.1.1.1 255.255.255.255",
    "cards 4111 1111 1111 1111 and 4111-1111-1111-1112; 4111111111111111 4111111111111111 4111  1111 5500-0000 0000 0004x",
    "phones +1 (743) 555-3824, +1 (743) 555-3824 10.0.0.1 +12 +1+2345678901 (555) 123-4567",
    "1" * 3000 + " " + "1-" * 3000,
    "a" * 20000 + "@" + "b" * 5000,
    "x@y.zz " * 700,
]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_those_of_the_patterns(spark):
    rows = {r.doc_id: r for r in find_personal_data(frame(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        got = [f"{k}:{s.start}:{s.end}" for k in KINDS for s in rows[i][k]]
        assert got == base(t), t[:80]
        assert all(s in rows[i][f"all_{k}"] for k in KINDS for s in rows[i][k])


def test_swallowed_spans_are_added(spark):
    texts = [f"some words then +1 (743) 555-3{i % 10}24 more" for i in range(60)] + ["call +1 (743) 555-3824 190.137.223.204 now", "4111111111111111 4111111111111111 twice"] + ["plain words"] * 20
    rows = {r.doc_id: r for r in find_personal_data(frame(spark, texts)).collect()}
    assert [(s.start, s.end) for s in rows[60].all_phone] == [(5, 22)]
    assert all(not rows[i][f"all_{k}"] for i in range(62, 82) for k in KINDS)


def test_query_on_the_table(spark):
    sf = str(DATA / "sf0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(b).encode()) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in b) for k in KINDS)
        assert set(b) <= set(r.spans.split(",")) | {""}


def test_redaction_leaves_the_rest(spark):
    texts = ["é a@b.cd, 1.2.3.4; 4111 1111 1111 1111 +1 (743) 555-3824.", "nothing here", None, ""]
    rows = {r.doc_id: r.text for r in redact(frame(spark, texts)).collect()}
    assert rows == {0: "é <EMAIL>, <IP>; <CARD> <PHONE>.", 1: "nothing here", 2: None, 3: ""}


def test_no_python_on_the_executors_and_no_rows(spark):
    assert find_personal_data(frame(spark, ["x"]).where("false")).count() == 0
    plan = redact(frame(spark, ["x@y.zz"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
