import math

import numpy as np

from gridloom.llm import topk as T


def truth(rows, every, k, scale=256):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(len(v) for _, v in good)
    good = [(i, v + [0] * (dims - len(v))) for i, v in good]
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        best = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_results_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((5, 16)) / 4
    rows = [(i, [float(x) for x in np.float32(base[i % 5] + rng.standard_normal(16) * (0.02 if i % 3 else 0.5))]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(30)] + [(600, None), (650, [1.0, None]), (700, [float("nan")] * 16), (750, [float("inf")] * 16), (800, []), (850, [0.5, 0.25]), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    for config in (T.TopKConfig(), T.TopKConfig(block=8, queries=3, seeds=4)):
        got = sorted(map(tuple, T.top_k(df, 50, config).select("query_id", "rank", "vec_id", "score").collect()))
        assert got == truth(rows, 50, 5)


def test_large_components_stay_exact(spark):
    rows = [(50, [1.0e7, 1.0]), (1, [1.0e7, -1.0]), (2, [1.0e7, 2.0])]
    got = sorted(map(tuple, T.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 50).select("query_id", "rank", "vec_id", "score").collect()))
    v = lambda x: math.floor(256 * x)
    assert got == [(50, 1, 2, v(1e7) ** 2 + 256 * 512), (50, 2, 1, v(1e7) ** 2 - 256 * 256)]


def test_pruning_skips_blocks():
    ids = np.arange(1000)
    rows = np.zeros((1000, 4), np.int64)
    rows[:, 0] = ids
    index = T.BlockIndex(ids, rows, 10)
    seen = []
    exact = index._exact
    index._exact = lambda q: seen.append(1) or exact(q)
    p, i, s = index.search(np.array([-1]), np.array([[1, 0, 0, 0]]), np.array([-1e18]), 5)
    assert sorted(i.tolist()) == [995, 996, 997, 998, 999] and max(s) == 999


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert T.top_k(empty).count() == 0 and T.top_k(empty).columns == ["query_id", "rank", "vec_id", "score"]
