import numpy as np

from cairnlight.llm import topk


def brute(ids, v, k):
    s = np.round(v.astype(float) @ v.astype(float).T, 9)
    out = []
    for i, q in enumerate(ids):
        order = sorted((-s[i, j], n) for j, n in enumerate(ids) if n != q)[:k]
        out += [(q, r + 1, n, -x) for r, (x, n) in enumerate(order)]
    return out


def run(df, **kw):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"], r["score"]) for r in topk.top_k(df, **kw).collect())


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 12)).astype(np.float32)
    v[10:14] = v[9]
    v[20] = 0
    ids = [int(i) for i in rng.permutation(1000)[:300]]
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in zip(ids, v)], "vec_id long, embedding array<float>, label int")
    want = sorted(brute(ids, v, 5))
    for options in ({}, {"block_rows": 64, "query_rows": 50}):
        got = run(df, k=5, **options)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-8)


def test_shared_bound_keeps_all_results(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(900, 16)) + rng.normal(size=16) * 3).astype(np.float32)
    v[100:140] = v[99]
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    asked = df.where("vec_id % 10 = 0")
    want = [w for w in sorted(brute(list(range(900)), v, 7)) if w[0] % 10 == 0]
    for size in (3, 40, 500, 5000):
        monkeypatch.setattr(topk, "SAMPLE_ROWS", size)
        got = run(df, k=7, queries=asked, block_rows=128)
        assert [g[:3] for g in got] == [w[:3] for w in want]


def test_slices_add_and_select():
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 64, (130, 9)).astype(np.uint16)
    slices = topk.sliced(levels, 6)
    weights = rng.integers(0, 16, 9)
    columns = [[] for _ in range(9)]
    for j in range(4):
        for i in range(6):
            at = np.flatnonzero(weights >> j & 1)
            if len(at):
                columns[i + j].append(slices[at, i])
    total = topk.add_slices(columns)
    want = levels.astype(int) @ weights
    bits = np.stack([np.unpackbits(s.view(np.uint8), bitorder="little")[:130] for s in total])
    assert ((bits.T.astype(int) << np.arange(len(total))).sum(axis=1) == want).all()
    valid = np.packbits(np.r_[np.ones(130, np.uint8), np.zeros(62, np.uint8)], bitorder="little").view(np.uint64)
    for k in (1, 7, 130):
        assert topk.kth_sum(total, valid, k) == sorted(want)[-k]
    for bound in (-1, 0, int(np.median(want)), int(want.max()), int(want.max()) + 1, 1 << 20):
        rows = np.flatnonzero(np.unpackbits(topk.at_least(total, valid, bound).view(np.uint8), bitorder="little"))
        assert rows.tolist() == np.flatnonzero(want >= bound).tolist()


def test_odd_rows_and_given_queries(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, None), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [0.5, 0.5]), (2, [0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "'y' AS v", "1 AS score")
    assert run(df, k=5) == [(1, 1, 2, 0.5), (1, 2, 3, 0.5), (2, 1, 1, 0.5), (2, 2, 3, 0.5), (3, 1, 1, 0.5), (3, 2, 2, 0.5)]
    assert run(df, k=1, queries=df.where("vec_id = 3")) == [(3, 1, 1, 0.5)]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 1")).count() == 0
