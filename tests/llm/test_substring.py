import hashlib
import random

import pytest

from gridloom.llm import substring_dedup as S
from tests.llm.helpers import awkward, words


def truth(rows, w=20):
    seen, gone = set(), {i: set() for i, _ in rows}
    for i, t in sorted(rows):
        x = words(t)
        for s in range(len(x) - w + 1):
            k = tuple(x[s : s + w])
            if k in seen:
                gone[i].update(range(s, s + w))
            seen.add(k)
    out = {}
    for i, t in rows:
        x = words(t)
        kept = " ".join(v for j, v in enumerate(x) if j not in gone[i])
        out[i] = (len(x), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "the", "of"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(rng.choice([19, 20, 21, 25, 60, 150]))] for _ in range(6)] + [["der"] * 70, ["x", "y", "z"] * 20]
    rows = []
    for i in range(60):
        x = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p)) if rng.random() < 0.3 else 0
            x += [word() for _ in range(rng.randint(0, 40))] + p[a:]
        rows.append((i * 3 % 61, rng.choice([" ", "\n", "  "]).join(x)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_words_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == truth(rows)


def test_paths_are_repeated_spans_of_their_source(spark):
    a = [f"a{i}" for i in range(100)]
    rows = [(1, " ".join(["p"] * 3 + a + ["q"])), (2, " ".join(["r"] + a[10:80] + ["s"])), (3, " ".join(a)), (4, "none of it")]
    paths, spans = S.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    # Windows of a that stand in documents 1 and 3, in all three, and in 1 and 3 again: the graph's three nonbranching paths.
    assert sorted(map(tuple, paths.collect())) == [(1, 0, 3, 10, 2), (1, 0, 13, 51, 3), (1, 0, 64, 20, 2)]
    covered = {}
    for r in spans.collect():
        covered.setdefault(r.doc, set()).update(range(r.start, r.start + r.n + 19))
    assert covered == {2: set(range(1, 71)), 3: set(range(100))}


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, "\t "), (4, long), (5, "x " + long), (None, long), (6, " ".join("short text of few words".split() * 3))]
    docs = awkward(spark, rows)
    got = {r.doc_id: r for r in S.deduplicated(docs, texts=True).collect()}
    assert (got[1].n_words, got[1].n_removed, got[1].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert got[4].n_removed == 0 and got[5].n_removed == 50_000 and got[5].kept_text == "x" and got[None].n_removed == 0
    assert S.deduplicated(docs.limit(0)).count() == 0
    other = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(60))), (2, "pre " * 40 + " ".join(f"a{i}" for i in range(60))), (2, "short text"), (2, " ".join(f"a{i}" for i in range(10, 50)))], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in S.deduplicated(other).collect()) == [(1, 60, 0), (2, 2, 0), (2, 40, 40), (2, 100, 99)]
    twice = docs.where("doc_id = 4").union(docs.where("doc_id = 4"))
    assert [r.n_removed for r in S.deduplicated(twice).collect()] == [0, 0]


def test_edges_of_long_paths_are_not_joined_in_every_round(spark, monkeypatch):
    rows = {}

    def counted(df, path, stored=S.stored):
        out = stored(df, path)
        rows[path.rsplit("/", 1)[-1]] = out.count()
        return out

    monkeypatch.setattr(S, "stored", counted)
    a, b = [f"a{i}" for i in range(9_000)], [f"b{i}" for i in range(700)]
    docs = spark.createDataFrame([(1, " ".join(["p"] * 1500 + a)), (2, " ".join(a)), (3, " ".join(b)), (4, " ".join(["q", *b]))], "doc_id bigint, text string")
    paths, spans = S.repeated_spans(docs)
    assert sorted(map(tuple, paths.collect())) == [(1, 0, 0, 1, 1481), (1, 0, 1500, 8981, 2), (3, 0, 0, 681, 2)]
    covered = {}
    for r in spans.collect():
        covered.setdefault(r.doc, set()).update(range(r.start, r.start + r.n + 19))
    assert covered == {1: set(range(1, 1500)), 2: set(range(9_000)), 4: set(range(1, 701))}
    rounds = {k: n for k, n in rows.items() if k.startswith("heads-")}
    assert rounds and sum(rounds.values()) < rows["graph"] / 10
