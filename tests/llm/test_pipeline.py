"""The pipeline over the smallest tables, stage by stage against what each promises, and the queries' contracts."""

import os
import zlib

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from gridloom.llm import queries  # noqa: E402
from tests.llm.helpers import shingles  # noqa: E402
from tests.llm.test_decontaminate import truth as contaminated  # noqa: E402
from tests.llm.test_near_dedup import truth as component  # noqa: E402
from tests.test_queries import FOLDER, TABLES, rows  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], FOLDER)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if i < 4:
            assert seen[-1].columns == columns
    texts = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in seen[:5]]
    ids = [{i for i, _ in t} for t in texts]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    labelled = [i for i in ids[0] if i in quality]
    assert sum((i in ids[1]) == (quality[i] == 1) for i in labelled) / len(labelled) > 0.97
    first = component(texts[1], 80)
    assert ids[2] == {i for i in ids[1] if first[i] == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hot = {g for _, t in bench for g in shingles(t)}
    suspects = [(i, t) for i, t in texts[2] if hot & set(shingles(t))]
    assert ids[2] - ids[3] == {i for i, _ in contaminated(suspects, bench)}
    assert ids[4] <= ids[3] and len(ids[4]) > 0.8 * len(ids[3])
    last = seen[5].collect()
    assert sorted(r.doc_id for r in last) == sorted(i for i, _ in texts[4])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(r.doc_id for r in last)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        wanted = con.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns) and rows(got) == rows(wanted)
    if name == "op1_quality":
        assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.5)).all()
