import random

import numpy as np

from gridloom.llm import decontaminate as D
from tests.llm.helpers import awkward, low, shingles, weighted_jaccard, words


def truth(docs, items, t=0.8):
    out = {}
    for i, text in docs:
        w = words(low(text or ""))
        for j, item in items:
            v = words(low(item or ""))
            if not w or not v:
                continue
            size = min(len(v), len(w))
            best = max(weighted_jaccard(shingles(" ".join(w[s : s + size])), shingles(" ".join(v))) for s in range(len(w) - size + 1))
            if best >= t - 1e-12:
                out[i, j] = best
    return out


def test_matches_are_those_of_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [(j, " ".join(word() for _ in range(rng.choice([1, 3, 5, 12, 30, 55])))) for j in range(25)] + [(90, "to be to be to be to be to be or"), (91, ""), (92, None)]
    docs = []
    for i in range(80):
        x = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            p = words(rng.choice(items[:26])[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = word()
            x += p[rng.choice([0, 0, 1, 3]) :]
        x += [word() for _ in range(rng.randint(0, 30))]
        docs.append((i, (" " if rng.random() < 0.5 else "\n").join(v.upper() if rng.random() < 0.2 else v for v in x)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = truth(docs, items)
    assert len(wanted) > 30
    for config in (D.DecontaminateConfig(), D.DecontaminateConfig(block_words=40)):
        got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(df, bench, config).collect()}
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
    left = {r.doc_id for r in D.decontaminated(df, bench).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in wanted}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    draw = lambda *n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    stored = draw(3000, D.WORDS)
    queried = stored[rng.integers(0, 3000, 200)].copy()
    for q, flips in zip(queried, rng.integers(100, 135, 200), strict=True):
        bits = np.zeros(512, np.uint8)
        bits[rng.choice(512, flips, replace=False)] = 1
        q ^= np.packbits(bits).view(np.uint64)
    index = D.HammingIndex(stored, 119)
    q, s = index.find(queried)
    brute = np.argwhere(np.bitwise_count(queried[:, None] ^ stored[None, :]).sum(2) <= 119)
    assert 50 < len(brute) < 200 and sorted(zip(q.tolist(), s.tolist(), strict=True)) == sorted(map(tuple, brute.tolist()))
    assert len(index.candidates(draw(200, D.WORDS))[0]) < 0.006 * 200 * 3000  # few unrelated ones are looked at


def test_pairs_at_the_threshold_lie_within_the_radius():
    rng = np.random.default_rng(3)
    beyond = 0
    for n, other, both in ((14, 13, 12), (23, 22, 20), (46, 46, 41), (50, 49, 44)):
        h = rng.integers(0, 1 << 64, (2000, n + other - both), dtype=np.uint64)
        beyond += (np.bitwise_count(D.fingerprints(h[:, :n]) ^ D.fingerprints(h[:, n - both :])).sum(1) > 119).sum()
    assert beyond <= 2


def test_windows_have_the_prints_of_their_shingles():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    h[rng.integers(0, 400, 60)] = h[7]
    starts = np.concatenate([np.arange(0, 90), np.arange(300, 380, 3)])
    assert (D.window_fingerprints(h, starts, 20) == D.fingerprints(h[starts[:, None] + np.arange(20)])).all()
    once, twice = D.numbered(np.array([[5, 9, 5, 5]], np.uint64)), D.numbered(np.array([[9, 5, 5]], np.uint64))
    assert len(set(once[0].tolist())) == 4 and set(twice[0].tolist()) < set(once[0].tolist())


def test_few_shingles_and_heavy_ones(spark):
    item = " ".join(f"k{i}" for i in range(9))
    heavy = "go " * 30 + " ".join(f"v{i}" for i in range(100))
    docs = [(1, " ".join(f"k{i}" for i in range(8))), (2, " ".join(f"k{i}" for i in range(1, 9))), (3, "k0 k1 k2"), (4, "x " * 50 + " ".join(f"v{i}" for i in range(100)) + " y" * 50), (5, "go " * 17 + " ".join(f"v{i}" for i in range(100)))]
    bench = [(1, item), (2, heavy), (3, "k1 k2"), (4, "k7 k8")]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert got == truth(docs, bench).keys() >= {(1, 1), (2, 1), (3, 3)}


def test_awkward_rows(spark):
    item = " ".join(f"k{i}" for i in range(20))
    docs = awkward(spark, [(1, None), (2, ""), (3, "a " * 100_000 + item), (None, item), (4, item), (4, item), (5, "clean words only")])
    bench = spark.createDataFrame([(7, item, "x"), (7, item, "y"), (None, item, "z"), (8, None, "z")], "item_id bigint, text string, doc_id string")
    got = D.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 7), (3, 7), (4, 7), (4, 7)] and next(r for r in got if r.doc_id == 3).start == 100_000
    clean = D.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 5]
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.decontaminated(docs, bench.limit(0)).count() == 7
