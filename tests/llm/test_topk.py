import math
from fractions import Fraction

import numpy as np

from docloom.llm.topk import Shard, top_k


def brute(rows, queries, k):
    ok = [(i, [math.floor(256 * Fraction(float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in ok if i in queries}.items():
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_equals_brute_force(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 450)]  # ties
    rows += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (None, [0.0] * 8), (504, [0.0] * 8)]
    docs = spark.createDataFrame([(v, i, 1, 2.0) for i, v in rows], "embedding array<float>, vec_id long, rank int, score double").repartition(3)
    for block in (16384, 7):
        got = top_k(docs, docs.where("vec_id % 20 = 0"), k=5, shard_rows=64, query_block=block)
        assert sorted(map(tuple, got.collect())) == brute(rows, set(range(0, 600, 20)), 5)


def test_large_components_and_few_rows(spark):
    rows = [(0, [3e12, -1.0]), (1, [1e12, 1.0]), (2, [-1.0, 2.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(docs, docs.where("vec_id = 2"), k=5).collect()))
    assert got == brute(rows, {2}, 5)


def test_components_of_any_size(spark):
    big = [1e18, -1e18, 3e17, 1e300, -1e300, 1.7e308, 5e-324, -5e-324, 0.0, 2.0**60]
    rnd = np.random.default_rng(8)
    rows = [(i, [float(rnd.choice(big)) if rnd.random() < 0.5 else float(rnd.normal()) for _ in range(3)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = top_k(docs, docs.where("vec_id % 5 = 0"), k=4, shard_rows=16)
    held = [(q, r, i, min(max(s, -(2**63)), 2**63 - 1)) for q, r, i, s in brute(rows, set(range(0, 60, 5)), 4)]
    # scores beyond 64 bits are equal where they were not: the smaller id is then first
    want = {}
    for q, _, i, s in held:
        want.setdefault(q, []).append(s)
    have = {}
    for q, r, i, s in sorted(map(tuple, got.collect())):
        have.setdefault(q, []).append(s)
    assert have == want


def test_generated_shards_equal_brute_force():
    for seed in range(1500):
        rnd = np.random.default_rng(seed)
        n, d, k = int(rnd.integers(1, 40)), int(rnd.integers(1, 6)), int(rnd.integers(1, 6))
        columns = rnd.integers(-6, 7, (n, d)) * (rnd.random((n, d)) < 0.8)
        one = rnd.integers(-1, 2, d)  # columns of one sign
        columns = np.where(one > 0, np.abs(columns), np.where(one < 0, -np.abs(columns), columns)).astype(float)
        query = (rnd.integers(-6, 7, d) * (rnd.random(d) < 0.6)).astype(float)
        own = int(rnd.integers(0, n + 5))
        want = sorted((-s, i) for i, s in enumerate((columns @ query).tolist()) if i != own)[:k]
        for kind in (float, object):
            ids, scores = Shard(np.arange(n), np.array(columns.astype(int).tolist(), kind)).search(np.array(query.astype(int).tolist(), kind), own, k)
            assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == want, (seed, kind)


def test_zero_weights_and_columns_of_one_sign():
    query = np.array([0.0, 256.0, 256.0])
    for seed in range(30):
        rnd = np.random.default_rng(seed)
        columns = np.stack([rnd.integers(-9, 9, 200), rnd.integers(1, 9, 200), rnd.integers(-9, 0, 200)], 1).astype(float)
        ids, scores = Shard(np.arange(200), columns).search(query, -1, 5)
        expected = sorted((-s, i) for i, s in enumerate(columns @ query))[:5]
        assert list(zip(-scores, ids, strict=True)) == expected


def test_small_shards_with_zero_components(spark):
    rnd = np.random.default_rng(6)
    sign = np.where(rnd.random((20, 8)) < 0.5, -1, 1)
    rows = [(i, (sign[i // 10] * np.abs(rnd.normal(0, 0.3, 8)) * (rnd.random(8) < 0.7)).tolist()) for i in range(200)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = top_k(docs, docs.where("vec_id % 5 = 0"), k=2, shard_rows=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, set(range(0, 200, 5)), 2)


def test_empty(spark):
    docs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(docs, docs).collect() == []
