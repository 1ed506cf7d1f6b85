import random

import numpy as np
import pytest

from siltlog.llm.common import Stage
from siltlog.llm import suffix_array as S
from siltlog.llm.components import components
from siltlog.llm.minhash import near_duplicates, shingle_set, word_hashes
from siltlog.llm.suffix_array import remove_repeats

from .helpers import ODD, frame, prose, sha

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, width):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def expected(ids, texts, width, percent):
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t, width) for t in texts]
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and ids[a] is not None and ids[b] is not None and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}, [len(s) for s in sets]


def corpus():
    r = random.Random(3)
    texts = list(ODD)
    for seed in range(12):
        base = prose(seed, r.choice([5, 60, 200]))
        texts.append(base)
        for _ in range(r.choice([0, 1, 6])):
            w = base.split(" ")
            for _ in range(r.choice([0, 1, 3])):
                w[r.randrange(len(w))] = prose(r.random(), 1)
            texts.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    return texts


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_the_brute_force_classes(spark, width, percent):
    texts = corpus()
    ids = [7 * i % 1009 for i in range(len(texts))]
    rows = {r.doc_id: r for r in near_duplicates(frame(spark, texts, ids), width, percent).collect()}
    want, sizes = expected(ids, texts, width, percent)
    assert {i: rows[i].component_id for i in ids} == want
    assert [rows[i].n_shingles for i in ids] == sizes
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows.values())


@pytest.mark.parametrize("rounds", [0, 2])
def test_a_large_group_of_mutual_near_copies(spark, rounds):
    """Copies around one text, many of them linked with few others or none."""
    r = random.Random(5)
    base, texts = prose(50, 150).split(" "), []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([2, 4, 6, 9])):
            w[r.randrange(len(w))] = prose(1000 + i, 1)
        texts.append(" ".join(w))
        if i % 5 == 0:
            texts.append(" ".join([*w[:-1], "tail"]))
    ids = list(range(len(texts)))
    rows = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, texts, ids), 3, 85, hub_rounds=rounds).collect()}
    want, _ = expected(ids, texts, 3, 85)
    assert rows == want and 1 < len(set(want.values())) < len(ids)


def test_near_duplicate_edge_cases(spark):
    rows = near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], ids=[None, 5, 5, None])).collect()
    assert len(rows) == 4 and all(r.kept for r in rows)
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, None), (5, 5)}
    assert near_duplicates(frame(spark, ["x"]).where("false")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(Stage(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(60)}) == 1
    assert len({got[0], got[1000], got[2000]}) == 3


def test_hashes_depend_on_words_alone():
    a = np.frombuffer(b"the cat\n sat the", np.uint8)
    h = word_hashes(a)
    assert len(h) == 4 and h[0] == h[3] and len(set(h.tolist())) == 3
    assert len(shingle_set(np.zeros(0, np.uint8), 3)) == 0 and len(shingle_set(a, 9)) == 1


NEAR = 0


def brute(ids, texts, length):
    first, out = {}, []
    data = [(t or "").encode() for t in texts]
    for i, x in sorted((i, x) for i, x in zip(ids, data, strict=True) if i is not None):
        for p in range(len(x) - length + 1):
            first.setdefault(x[p : p + length], i)
    for i, x in zip(ids, data, strict=True):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if i is not None and first[x[p : p + length]] < i:
                gone[p : p + length] = True
        left = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((i, len(x), int(gone.sum()), int(gone[:1].sum() + (~gone[:-1] & gone[1:]).sum()), sha(left)))
    return out


@pytest.mark.parametrize(("length", "piece"), [(50, 1 << 21), (100, 1 << 21), (50, 300), (230, 1 << 21)])
def test_repeats_are_the_brute_force_ones(spark, length, piece):
    r = random.Random(1)
    passage = prose(99, 30)
    texts = corpus() + ["A" * 4000, "AB" * 300 + "A" * 100, "\x00" * 200, "\x00" * 150 + "x"]
    texts += [prose(200 + i, r.randrange(1, 40)) + passage[r.randrange(40) : r.randrange(60, 300)] + prose(300 + i, 10) for i in range(25)]
    ids = random.Random(2).sample(range(10_000), len(texts))
    ids[3], ids[-1], ids[-2] = None, ids[-3], None  # one repeated id, two without
    got = remove_repeats(frame(spark, texts, ids).repartition(3), length, block_bytes=2000, piece_bytes=piece).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(brute(ids, texts, length), key=key)


def test_repeats_over_two_letters(spark):
    """Strings that share long prefixes, in runs that end everywhere."""
    r = random.Random(8)
    motifs = ["".join(r.choice("ab") for _ in range(r.randrange(20, 90))) for _ in range(6)]
    texts = ["".join(r.choice(motifs) if r.random() < 0.9 else r.choice(["c", "a"]) for _ in range(r.randrange(1, 9))) for _ in range(120)]
    ids = r.sample(range(1000), len(texts))
    assert sorted(map(tuple, remove_repeats(frame(spark, texts, ids), 50, block_bytes=3000).collect())) == sorted(brute(ids, texts, 50))


def test_repeats_in_very_long_documents(spark):
    """Pieces of 2 MB: a passage over a cut and one shared by both documents go, the rest of 20 MB stays."""
    r = np.random.default_rng(1)
    a, b = (r.integers(97, 123, n, dtype=np.uint8).tobytes().decode() for n in (20_000_000, 5_000_000))
    cut = 2 << 20
    b = b[: cut - 300] + a[7_000_000:7_000_600] + b[cut + 300 :]
    b = b[:4_000_000] + a[100 : 100 + 51] + b[4_000_051:]
    rows = {x.doc_id: x for x in remove_repeats(frame(spark, [a, b])).collect()}
    assert (rows[0].n_bytes, rows[0].n_removed, rows[0].kept_sha256) == (20_000_000, 0, sha(a.encode()))
    left = b[: cut - 300] + b[cut + 300 : 4_000_000] + b[4_000_051:]
    assert (rows[1].n_bytes, rows[1].n_removed, rows[1].n_spans, rows[1].kept_sha256) == (5_000_000, 651, 2, sha(left.encode()))


def test_repeat_edge_cases(spark):
    assert remove_repeats(frame(spark, ["x"]).where("false")).count() == 0
    assert [tuple(r) for r in remove_repeats(frame(spark, [None])).collect()] == [(0, 0, 0, 0, sha(b""))]
    two = remove_repeats(frame(spark, ["é" * 60, "é" * 60]), with_text=True).collect()
    assert {r.doc_id: r.kept_text for r in two} == {0: "é" * 60, 1: ""}


def exchange(rows, step):
    """One round of messages, in order, without Spark."""
    held = {}
    for key, kind, sub, body in sorted(rows, key=lambda r: r[:3]):
        held.setdefault(key, {}).setdefault(kind, []).append((sub, body))
    return [r for key in held for r in step(key, held[key])]


@pytest.mark.parametrize("length", [27, 50, 100])
def test_each_level_of_a_bucket_is_sorted_once(monkeypatch, length):
    r = random.Random(length)
    calls = {"triples": 0, "items": 0}
    for name in calls:

        def counted(self, *args, f=getattr(S.Runs, name), name=name):
            calls[name] += 1
            return f(self, *args)

        monkeypatch.setattr(S.Runs, name, counted)
    shared = [bytes(r.choice(b"ab") for _ in range(length + 30)) for _ in range(6)]
    texts = [[r.choice([x, x[:-7], x[5:], x[3:9] * 40]) for x in r.choices(shared, k=8)] for _ in range(3)]
    runs, ids = [], []
    for key, some in enumerate(texts):
        ids.append(np.array(r.sample(range(1000), len(some))))
        runs.append((key, 5, 0, (ids[-1], np.array([len(x) - length + 1 for x in some]), b"".join(some))))
    every = sorted({x[i : i + length] for some in texts for x in some for i in range(len(x) - length + 1)})
    least = {w: min(int(ids[k][j]) for k, some in enumerate(texts) for j, x in enumerate(some) if w in x) for w in every}
    split = type("Split", (), {"value": [every[len(every) // 3], every[2 * len(every) // 3]]})
    top, names = S.Runs(runs[0][3], length).top, []
    for level in range(top + 1):
        names.append(exchange(exchange([*runs, *(names[-1] if names else [])], S.triples_out(length, level, split)), S.named(level)))
    above = names.pop()
    for level in range(top, 0, -1):
        above = exchange(exchange([*runs, *names.pop(), *above], S.items_out(length, level, split)), S.ranked(level))
    found = exchange(exchange([*runs, *above], S.items_out(length, 0, split)), S.compared)
    got = {key: body.tolist() for key, _, _, body in exchange(found, S.open_answers)}
    assert got == {k: [least[x[i : i + length]] for x in some for i in range(len(x) - length + 1)] for k, some in enumerate(texts)}
    assert calls == {"triples": 3 * (top + 1), "items": 3 * (top + 1)}


def test_order_of_rows_by_several_keys():
    r = np.random.default_rng(1)
    for n, high in ((0, 9), (1, 9), (2000, 5), (2000, 2**47), (2000, 2**64 - 1), (500, 0)):
        for k in (1, 2, 3, 4):
            keys = [r.choice(r.integers(0, high, 40, np.uint64, endpoint=True), n) for _ in range(k)]
            order, new = S.order_of(keys)
            rows = list(zip(*(x.tolist() for x in keys), strict=True))
            got = [rows[i] for i in order]
            assert got == sorted(rows) and new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(n)]


def test_windows_are_hashed_strip_by_strip():
    """Hashes are equal where windows are, across strips and strings, and take a few numbers a window."""
    import tracemalloc

    length, r = 100, np.random.default_rng(1)
    count = np.array([40, 1, 3000, 3 * S.STRIP, 40])
    parts = [r.integers(0, 3, n + length - 1, np.uint8).tobytes() for n in count]
    parts[4], parts[2] = parts[0], parts[2][:500] + parts[0] + parts[2][500 + len(parts[0]) :]
    h, of = S.window_hashes((None, count, b"".join(parts), None), length)
    windows = [(k, x[i : i + length]) for k, x in enumerate(parts) for i in range(count[k])]
    assert of.tolist() == [k for k, _ in windows]
    assert len(set(h.tolist())) == len({x for _, x in windows}) == len({(a, x) for a, (_, x) in zip(h.tolist(), windows, strict=True)})
    t = S.Runs((np.zeros(5, np.int64), count, b"".join(parts)), length)
    at = r.permutation(t.places[t.room > 0])
    p = t.prints(at)
    assert len(set(p.tolist())) == len({t.buf[a : a + length].tobytes() for a in at.tolist()}) == len({(b, t.buf[a : a + length].tobytes()) for a, b in zip(at.tolist(), p.tolist(), strict=True)})
    body = (None, np.full(20_000, 45), bytes(20_000 * (45 + length - 1)), None)
    tracemalloc.start()
    list(S.hashes_out(length, 12)(0, 0, body))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * body[1].sum()  # bytes a window; 126 with sums of the whole bucket, 32 so


def test_workers_give_freed_memory_back():
    from siltlog.llm.common import lean
    from siltlog.llm.minhash import Powers

    def rss():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def run(batches):
        held = [np.ones(12_000) for _ in range(2000)]  # 96 KB each, below what the C library maps by itself
        last.append(held[-1])  # keeps the end of the heap in use
        yield from batches

    last = []
    before = rss()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert rss() - before < 100_000_000
    powers = Powers()
    for n in (2_000_000, 2_000_001):
        up, _ = powers.upto(n)
    assert len(up) == n and powers.n < 2_400_000
