import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import warc


def test_round_trip(spark, tmp_path):
    big, other = "<p>é" + "x" * 200, "y" * 100
    rows = [(3, "http://a/1", big), (1, "http://a/2\r\nX: y", big), (2, "u", "short"), (5, "u", "short"), (4, None, None), (6, "u", ""), (7, "u", other), (7, "u", other), (8, "u", other), (9, "u", "z" * 99), (10, "u", "z" * 99), (None, "u", big), (11, "u", "\r\n\r\nWARC-Type: revisit\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"digest": F.lit("own"), "payload": F.lit(1), "n": F.lit(1)}).repartition(3)
    folder = f"file://{tmp_path}/w"
    warc.write_archive(pages, folder)
    records = warc.read_archive(spark, folder)
    got = warc.parsed(records).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    by_id = {}
    for i, u, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and i is not None and first[h] != i
        by_id.setdefault(i, []).append((len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    for r in got:
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == by_id[r.page_id][0]
    one = records.where(F.decode("header", "UTF-8").contains("page:2:")).first()
    assert bytes(one.record).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and bytes(one.record).endswith(b"\r\n\r\nshort\r\n\r\n")
    length = int(bytes(one.record).split(b"Content-Length: ")[1].split(b"\r\n")[0])
    assert len(bytes(one.record)) == bytes(one.record).index(b"\r\n\r\n") + 4 + length + 4
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in rows})


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), f"file://{tmp_path}/e")
    assert warc.parsed(warc.read_archive(spark, f"file://{tmp_path}/e")).count() == 0


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string"), folder)
    records = warc.read_archive(spark, folder).withColumn("record", F.concat(F.substring(F.col("record"), 1, F.octet_length("record") - 5), F.lit(b"?\r\n\r\n")))
    with pytest.raises(Exception, match="digest"):
        warc.parsed(records).collect()
