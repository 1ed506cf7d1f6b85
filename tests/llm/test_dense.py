import numpy as np
import pytest

from siltlog.llm.permutation_index import PermutationSearch, nearest, prefixes, unit
from siltlog.llm.topk import OP6_SQL, op6_topk, top_k

from ..conftest import DATA

SCHEMA = "vec_id long, embedding array<double>, label int, d int, g string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def odd_rows(n=400, d=6, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, np.round(r.normal(size=d), 1).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, []), (2002, [0.0] * d), (2003, [1.0, None] + [1.0] * (d - 2)), (2004, [float("nan")] * d), (2005, [float("inf")] + [1.0] * (d - 1)), (None, [1.0] * d), (2006, [1.0, 2.0])]
    return rows


def good(rows, zero):
    return [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (not zero or any(v))]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e8])
def test_top_k_is_exact_with_ties(spark, scale):
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v]) for i, v in odd_rows()]
    df = vectors(spark, rows)
    got = {}
    for r in top_k(df, df.where("vec_id % 20 = 0"), k=7, shard=64, tile=5, group_rows=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    have = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in good(rows, False)]
    for q, v in have:
        if q % 20 == 0:
            # scores beyond a long are kept at its ends, as documented
            s = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), j) for j, w in have if j != q and len(w) == len(v))[:7]
            assert sorted(got.get(q, [])) == [(n + 1, j, -x) for n, (x, j) in enumerate(s)]
    assert top_k(df.where("false"), df.where("false")).count() == 0


def test_top_k_sql(spark):
    import duckdb

    sf = str(DATA / "sf0.001")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, op6_topk(spark, sf).collect())) == sorted(c.sql(OP6_SQL).fetchall())


def test_index_edge_cases(spark):
    rows = odd_rows()
    df = vectors(spark, rows)
    got = {}
    for r in nearest(df, df.where("vec_id % 10 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    have = good(rows, True)
    hit = total = 0
    for q, v in have:
        if q % 10:
            continue
        cos = sorted((-(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), j) for j, w in have if j != q and len(w) == len(v))[:5]
        found = sorted(got.get(q, []))
        assert [n for n, *_ in found] == list(range(1, len(cos) + 1))
        by_id = dict((i, w) for i, w in have)
        assert all(abs(s - v @ by_id[j] / np.linalg.norm(v) / np.linalg.norm(by_id[j])) < 1e-9 for _, j, s in found)
        hit, total = hit + len({j for _, j, _ in found} & {j for _, j in cos}), total + len(cos)
    assert hit >= 0.9 * total
    same = sorted(got[1000])
    assert [j for _, j, _ in same] == [3, 1001, 1002, 1003, 1004]
    assert nearest(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "check_s"])
def test_recall(spark, sf):
    path = DATA / sf
    if not path.exists():
        pytest.skip("no such data")
    df = spark.read.parquet(f"{path}/embeddings.parquet")
    queries = df.where("vec_id % 50 = 0")
    rows = df.collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    hit = total = 0
    got = {}
    for r in nearest(df, queries).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in np.flatnonzero(ids % 50 == 0):
        c = m @ m[q]
        c[q] = -9
        best = ids[np.lexsort((ids, -c))[:5]]
        hit, total = hit + len(set(best.tolist()) & got[ids[q]]), total + len(best)
    assert hit >= 0.9 * total


@pytest.mark.parametrize("size", [2.0**28, 2.0**24, 2.0**50])
def test_top_k_of_odd_components_beyond_doubles(spark, size):
    """Products that no double holds, against Python integers."""
    r = np.random.default_rng(7)
    rows = [(i, ((np.floor(r.normal(size=9) * size) * 2 + 1) / 64).tolist()) for i in range(60)]
    df = vectors(spark, rows)
    got = {}
    for x in top_k(df, df.where("vec_id % 20 = 0"), k=4, shard=16, tile=2, group_rows=16).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    have = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    most = 2**63 - 1
    for q, v in have[::20]:
        s = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -most), most), j) for j, w in have if j != q)[:4]
        assert sorted(got[q]) == [(n + 1, j, -x) for n, (x, j) in enumerate(s)]


def test_cosines_of_huge_and_tiny_components(spark):
    """Scaling by powers of two changes no cosine."""
    r = np.random.default_rng(8)
    plain = [(i, r.normal(size=5).tolist()) for i in range(80)]
    size = lambda i: 2.0 ** (660 if i % 3 == 0 else -660 if i % 3 == 1 else 0)
    odd = [(i, [x * size(i) for x in v]) for i, v in plain]
    found = [[tuple(x) for x in nearest(df, df.where("vec_id % 10 = 0"), k=5).orderBy("query_id", "rank").collect()] for df in (vectors(spark, plain), vectors(spark, odd))]
    assert found[0] == found[1] and len(found[0]) == 40


def test_repeated_query_rows_each_get_a_list(spark):
    df = vectors(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])])
    for f in (top_k, nearest):
        got = sorted((x.query_id, x["rank"], x.vec_id) for x in f(df, df.where("vec_id = 0"), k=1).collect())
        assert got == [(0, 1, 1), (0, 1, 2)]


def test_recall_of_a_full_shard_and_its_footrule():
    """One shard of 4,096 vectors, where the index has to choose; its sums of places against the definition of the footrule."""
    r = np.random.default_rng(11)
    m, pivots, length = r.normal(size=(4096, 64)), unit(r.normal(size=(256, 64))), 96
    search = PermutationSearch({64: pivots}, 5, length, 0.08)
    shard = search.prepare(np.arange(4096), m)
    ids = np.arange(0, 4096, 50)
    row, vec, _ = search([shard], ids, m[ids])
    u = unit(m)
    hit = 0
    for i, q in enumerate(ids):
        cosine = u @ u[q]
        cosine[q] = -9
        hit += len(set(vec[row == i].tolist()) & set(np.argsort(-cosine)[:5].tolist()))
    assert hit >= 0.9 * 5 * len(ids) and len(row) == 5 * len(ids)

    a, b = (prefixes(m[:20], pivots, length), prefixes(m[20:40], pivots, length))
    for x, y in zip(a, b, strict=True):
        at = [dict(zip(z.tolist(), range(length), strict=True)) for z in (x, y)]
        footrule = sum(abs(at[0].get(p, length) - at[1].get(p, length)) for p in set(at[0]) | set(at[1]))
        shared = sum(length - max(i, at[1][p]) for p, i in at[0].items() if p in at[1])
        assert footrule == length * (length + 1) - 2 * shared
    own = np.array([dict(zip(a[0].tolist(), range(length), strict=True)).get(p, length) for p in range(256)])
    assert (shard.files[:, 0] == own).all()


def test_pivots_tied_for_a_vector_come_by_number():
    pivots = unit(np.array([[0.0, 1.0], [1.0, 0.0], [0.0, -1.0], [-1.0, 0.0]]))
    assert prefixes(np.array([[1.0, 1.0], [1.0, 0.0]]), pivots, 4).tolist() == [[0, 1, 2, 3], [1, 0, 2, 3]]
