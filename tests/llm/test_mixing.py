import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing as M
from tests.llm.helpers import awkward, words


def corpus(n=400):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        kind = "toxic" if i % 10 == 0 else "junk" if i % 10 < 3 else "clean"
        if kind == "toxic":
            w[::6] = [rng.choice(["nasty", "vile"]) for _ in w[::6]]
        if kind == "junk":
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), kind))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(k != "junk"), int(k == "toxic")) for i, _, k in rows if i % 3], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_expected_totals_match_the_targets(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    config = M.MixConfig(keep_anchor=False)
    got = M.with_rates(docs, labels, config).toPandas().sort_values("doc_id")
    assert (got.tokens.to_numpy() == [len(words(t)) for _, t, _ in rows]).all() and (got.rate >= 0).all()
    p = np.stack(got.p.to_numpy())
    assert (np.abs(p.sum(1) - 1) < 0.02).all()
    assert np.mean([list(config.domains)[k] for k in p.argmax(1)] == np.array([r[2] for r in rows])) > 0.95
    held = (got.rate.to_numpy() * got.tokens.to_numpy()) @ p
    assert np.allclose(held / held.sum(), [0.92, 0.04, 0.04], atol=0.002)
    # The fitted rates leave no projected gradient behind.
    own = got.tokens.to_numpy() @ p
    budget = config.margin * own[0] / 0.92
    g = p @ ((held - np.array([0.92, 0.04, 0.04]) * budget) / own)
    assert (np.abs(g[got.rate > 1e-6]) < 5e-3).all()


def test_a_domain_without_target_keeps_its_rates(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    got = M.with_rates(docs, labels, M.MixConfig(targets={"clean": 0.98, "toxic": 0.02}, margin=1.0)).toPandas()
    kind = dict((i, k) for i, _, k in rows)
    p = np.stack(got.p.to_numpy())
    junk = got[[kind[i] == "junk" for i in got.doc_id]]
    assert np.abs(junk.rate - 1).max() < 0.1
    held = (got.rate.to_numpy() * got.tokens.to_numpy()) @ p
    assert abs(held[2] / (held[0] + held[2]) - 0.02) < 0.002


def test_anchor_documents_stay(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    out = M.mixed(docs, labels)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert {i for i, _, k in rows if k == "clean"} <= kept
    gone = [i for i, _, k in rows if k != "clean" and i not in kept]
    assert len(gone) > 30
    assert sorted(r.doc_id for r in M.mixed(docs.repartition(7), labels).collect()) == sorted(r.doc_id for r in out.collect())


def test_copies_follow_rates(spark):
    got = spark.range(4000).select(M.copies(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(got[0] - 1.3) < 0.03 and (got[1], got[2]) == (1, 2)


def test_awkward_rows(spark):
    docs = awkward(spark, [(1, None), (2, ""), (3, " "), (4, "a " * 100_000), (None, "some words here"), (5, "same text"), (5, "same text")])
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, None, 1), (None, 1, 0), (99, 0, None)], "doc_id bigint, quality int, toxic int")
    got = M.with_rates(docs, labels).collect()
    assert len(got) == 7 and {r.doc_id: r.tokens for r in got} == {1: 0, 2: 0, 3: 0, 4: 100_000, None: 3, 5: 2}
    assert set(M.mixed(docs, labels).columns) == set(docs.columns)
    assert M.with_rates(docs.limit(0), labels).count() == 0 and M.mixed(docs.limit(0), labels).count() == 0
    flat = M.with_rates(docs, labels.limit(0)).collect()
    assert len(flat) == 7 and len({tuple(r.p) for r in flat}) == 1


def test_a_rare_domain_meets_its_target(spark):
    """A thousandth of the tokens to a fiftieth: twenty times each, and no rate is cut."""
    rows = [([1.0, 0.0, 0.0], 90_000.0), ([0.9, 0.1, 0.0], 9_000.0), ([0.0, 1.0, 0.0], 900.0), ([0.02, 0.0, 0.98], 100.0)]
    cells = spark.createDataFrame(rows, "p array<double>, tokens double")
    config = M.MixConfig()
    got = cells.withColumn("rate", M.fit_rates(cells, config)).collect()
    held = sum(r.rate * r.tokens * np.array(r.p) for r in got)
    budget = config.margin * sum(t * p[0] for p, t in rows) / 0.92
    assert np.allclose(held, np.array([0.92, 0.04, 0.04]) * budget, rtol=1e-3)
    assert max(r.rate for r in got) > 40 and all(r.rate >= 1 for r in got if r.p[0] >= 0.9)


@pytest.mark.parametrize("spread", [(0.1, 0.03, 0.02), (1.0, 0.3, 0.1)])
def test_totals_of_plain_projected_gradient(spark, spread):
    """The same expected tokens as thousands of plain steps over documents with unrounded posteriors, but for what rounding them changes."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(spread, 300)
    t = rng.integers(1, 2000, 300).astype(float)
    config = M.MixConfig()
    goal = np.array([0.92, 0.04, 0.04]) * config.margin * (t @ p)[0] / 0.92
    least = (p[:, 0] >= p.max(1)).astype(float)
    own = t @ p
    r = np.ones(300)
    for _ in range(20_000):
        r = np.maximum(least, r - p @ (((r * t) @ p - goal) / own))
    cells = spark.createDataFrame([(list(map(float, np.round(x, 2))), float(n)) for x, n in zip(p, t, strict=True)], "p array<double>, tokens double").coalesce(1)
    got = cells.withColumn("rate", M.fit_rates(cells, config)).collect()
    held = sum(x.rate * x.tokens * np.array(x.p) for x in got)
    assert np.abs(held - (r * t) @ p).max() < 0.005 * t.sum() and all(x.rate >= 0 for x in got)


def test_what_cannot_be_met_for_one_domain_changes_no_other(spark):
    """Likely clean documents stay though they bring too much of the toxic domain; no clean ones are repeated to make up for it."""
    cells = spark.createDataFrame([([0.6, 0.0, 0.4], 1000.0), ([1.0, 0.0, 0.0], 5000.0)], "p array<double>, tokens double")
    with pytest.warns(UserWarning, match="toxic"):
        rate = M.fit_rates(cells, M.MixConfig(targets={"clean": 0.98, "toxic": 0.02}, margin=1.0))
    assert [round(r.rate, 3) for r in cells.withColumn("rate", rate).collect()] == [1.0, 1.0]


def test_rates_that_do_not_converge_are_an_error_and_missed_targets_a_warning(spark):
    cells = spark.createDataFrame([([0.7, 0.2, 0.1], 1000.0), ([0.1, 0.8, 0.1], 10.0), ([0.3, 0.1, 0.6], 5.0)], "p array<double>, tokens double")
    with pytest.raises(RuntimeError, match="converged"):
        M.fit_rates(cells, M.MixConfig(steps=0))
    with pytest.warns(UserWarning, match="junk"):
        M.fit_rates(cells, M.MixConfig())
