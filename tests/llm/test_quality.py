import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import quality
from gridloom.llm._words import Words, chunks
from tests.llm.helpers import WORD, awkward, words


def corpus(n=160):
    rng = random.Random(1)
    good = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(good) for _ in range(rng.randint(5, 60))]
        out.append((i, " ".join(w) if i % 2 else " ".join(x + rng.choice(["###", "$$$"]) for x in w), i % 2))
    return out


def test_words_are_those_of_the_pattern():
    texts = ["a  b\tc\x0bd\x1ce  f", "", None, " x ", "é" * 5, "one", "\n\n", "z" * 200_000 + " q"]
    got = []
    for a, b in chunks(pa.array(texts)):
        w = Words(pa.array(texts)[a:b])
        for i in range(b - a):
            at = range(w.first[i], w.first[i + 1])
            got.append([w.data[w.start[j] : w.end[j]].tobytes().decode() for j in at])
    assert got == [WORD.findall(t or "") for t in texts]


def test_run_hashes_don_t_depend_on_place():
    w = Words(pa.array(["a b c d e f", "x a b c d e f y", "a b c d f e"]))
    at, h = w.grams(3)
    by = {}
    for p, v in zip(at, h, strict=True):
        by.setdefault(tuple(w.data[w.start[j] : w.end[j]].tobytes() for j in range(p, p + 3)), set()).add(int(v))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_held_out_rows_are_told_and_labelled_alike(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = quality.with_quality(docs, model)[0].withColumn("h", quality.held_out()).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.h]
    assert np.mean([(r.quality_score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    # Labels of held-out rows teach nothing.
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, turned).weights, model.weights)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 120_000), (4, "a " * 120_000), (None, "some words"), (5, "some words")]
    docs = awkward(spark, rows)
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    scored, name = quality.with_quality(docs, model)
    got = scored.collect()
    assert name == "quality_score_" and scored.columns[:-1] == docs.columns and all(r.score == "own" for r in got)
    assert len(got) == 7 and all(0 <= r[name] <= 1 for r in got)
    assert len({r[name] for r in got if not words(r.text)}) == 1
    empty = docs.limit(0)
    assert quality.with_quality(empty, quality.fit(empty, labels.limit(0)))[0].count() == 0
    assert {r[0] for r in quality.with_quality(docs, quality.fit(docs, labels.limit(0)))[0].select(name).collect()} == {0.5}
    assert set(quality.accepted(docs, model, 0.0).columns) == set(docs.columns) and quality.accepted(docs, model, 0.0).count() == 7
