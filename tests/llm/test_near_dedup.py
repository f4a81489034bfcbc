import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import near_dedup as N
from gridloom.llm.components import components
from tests.llm.helpers import awkward, shingles


def truth(rows, percent=85):
    """Smallest id reachable by brute force."""
    sets = [(i, set(shingles(t))) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def corpus(seed=5, groups=25, chain=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(groups):
        w = [word() for _ in range(rng.choice([3, 4, 7, 12, 40, 120, 400]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(chain):
            rows.append((len(rows), " ".join(w) if rng.random() < 0.7 else "  ".join(x.upper() for x in w)))
            if rng.random() < 0.7:  # a chain: each is near the one before
                w = list(w)
                w[rng.randrange(len(w))] = word()
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,part,block,block_shingles", [(85, 1000, 2000, 2_000_000), (80, 2, 3, 2_000_000), (85, 1000, 2000, 300)])
def test_components_are_those_of_brute_force(spark, percent, part, block, block_shingles):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = N.near_duplicates(docs, N.NearDedupConfig(percent=percent, part=part, block=block, block_shingles=block_shingles)).collect()
    wanted = truth(rows, percent)
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == wanted[r.doc_id] and r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(set(shingles(text[r.doc_id])))


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (6, long), (7, long + " end"), (None, "one two"), (8, "x y z a b c"), (8, "x y z a b c"), (9, "p q r s t u"), (9, "x y z a b c")]
    docs = awkward(spark, rows)
    got = {}
    for r in N.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [len(v) for k, v in sorted(got.items(), key=lambda e: e[0] or 0)] == [1, 1, 1, 1, 1, 1, 1, 1, 2, 2]
    assert all(got[i][0].kept and got[i][0].n_shingles == 0 for i in (1, 2, 3))
    assert got[5][0].component_id == 4 and got[7][0].component_id == 6 and got[None][0].component_id is None and got[None][0].kept
    assert {r.component_id for r in got[8] + got[9]} == {8}
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8]  # rows of one id are one document
    other = N.deduplicated(spark.createDataFrame([(8, "x y z a b c"), (8, "x y z a b c"), (8, "p q r s t u")], "doc_id bigint, text string")).collect()
    assert len(other) == 1
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_hot_group_isn_t_expanded(spark):
    """A hundred near copies of one text: linear candidate pairs, one component."""
    rng = random.Random(7)
    base = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(100):
        w = list(base)
        w[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for n, share in ((2000, 0.9), (300, 0.85), (40, 0.8)):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        k = int(n * share)
        r = N.registers([x, np.concatenate([x[:k], rng.integers(0, 1 << 63, n - k, dtype=np.uint64)])])
        e = N.estimate(r[:1], r[1], np.array([n]), np.array([n]))[0]
        assert abs(e - k / (2 * n - k)) < 5 * (0.25 / min(n, 256)) ** 0.5
        assert e >= N.least_estimate(np.array([n]), np.array([n]), k / (2 * n - k))[0]
    assert (N.registers([np.zeros(0, np.uint64)]) == 0).all()


def test_components_of_a_long_chain(spark, tmp_path):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components(edges, f"file://{tmp_path}/c").collect()
    assert sorted(r.node for r in got) == list(range(201)) and {r.component for r in got} == {0}
    assert components(edges.limit(0), f"file://{tmp_path}/d").count() == 0
