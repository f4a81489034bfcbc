"""Foreign formats, made here byte by byte and read back."""

import io
import json
import sqlite3
import struct

import numpy as np

from gridloom.sources import formats, tables


def test_npz(spark, tmp_path):
    b = io.BytesIO()
    np.savez_compressed(b, ndvi=np.arange(6).reshape(2, 3), rgb=np.zeros((1, 2)))
    (tmp_path / "a.npz").write_bytes(b.getvalue())
    (tmp_path / "bad.npz").write_bytes(b"no archive")
    got = {r.band: (r.height, r.width, list(r.data) if r.data else None) for r in formats.npz_bands(spark, str(tmp_path)).collect()}
    assert got["ndvi"] == (2, 3, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]) and None in got


def _polygon(points):
    return struct.pack("<BII", 1, 3, 1) + struct.pack("<I", len(points)) + b"".join(struct.pack("<2d", *p) for p in points)


SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(str(tmp_path / "g.gpkg"))
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('cells', 'geom')")
    db.execute("create table cells (id integer, geom blob, wealth real)")
    multi = struct.pack("<BII", 1, 6, 2) + _polygon(SQUARE) + _polygon(SQUARE[:3] + SQUARE[:1])
    db.execute("insert into cells values (7, ?, 0.5)", (b"GP\0\x01" + struct.pack("<i", 4326) + multi,))
    db.execute("insert into cells values (8, null, 0.1)")
    db.commit()
    db.close()
    got = formats.geopackage_rings(spark, str(tmp_path)).orderBy("part").collect()
    assert len(got) == 2 and got[0].layer == "cells" and json.loads(got[0].attributes) == {"id": 7, "wealth": 0.5}
    assert [(p.x, p.y) for p in got[0].ring] == SQUARE


def test_shapefile(spark, tmp_path):
    body = struct.pack("<i", 5) + struct.pack("<4d", 0, 0, 2, 2) + struct.pack("<2i", 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in SQUARE)
    point = struct.pack("<i2d", 1, 3.0, 4.0)
    records = b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate((body, point)))
    (tmp_path / "s.shp").write_bytes(struct.pack(">i", 9994) + b"\0" * 96 + records)
    got = {(r.shape, r.part): [(p.x, p.y) for p in r.ring] for r in formats.shapefile_rings(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): SQUARE, (1, 0): [(3.0, 4.0)]}
    field = b"NAME\0\0\0\0\0\0\0C\0\0\0\0\x05\0" + b"\0" * 14
    header = struct.pack("<4BIHH20x", 3, 24, 1, 1, 2, 32 + 32 + 1, 6)
    (tmp_path / "s.dbf").write_bytes(header + field + b"\r" + b" Dakar" + b"*Accra")
    assert [(r.shape, r.name, r.value) for r in formats.dbf_records(spark, str(tmp_path)).collect()] == [(0, "NAME", "Dakar")]


def test_stata(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"hv001": [1, 2], "hv206": pd.Categorical(["yes", "no"])}).to_stata(tmp_path / "s.dta", write_index=False)
    formats.stata_to_parquet(spark, str(tmp_path / "s.dta"), str(tmp_path / "out"), ["hv001", "hv206"], 2019)
    assert sorted((r.hv001, r.hv206, r.hv007) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "yes", 2019), (2, "no", 2019)]


def test_threshold_results(spark, tmp_path):
    text = "threshold,percent_cells_labelled,num_cells_labelled,spatial_autocorr,confidence_interval,year\n" + "30.0,6.76,536,\"{'I': np.float64(0.856), 'p_value': np.float64(0.001)}\",\"{'lower': np.float64(0.39), 'upper': np.float64(0.41), 'width': np.float64(1.5e-02)}\",2015\n31.0,6.6,500,,,2015\n"
    (tmp_path / "t.csv").write_text(text)
    got = tables.threshold_results(spark, str(tmp_path / "t.csv")).orderBy("threshold").collect()
    assert (got[0].moran_i, got[0].moran_p, got[0].interval_width) == (0.856, 0.001, 0.015) and got[1].moran_i is None


def test_failure_log_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"cell_id": 17, "error_type": "x", "details": {"a": "b"}}\nnot json\n')
    assert tables.failure_log(spark, str(tmp_path)).count() == 1
    assert sorted(r._corrupt or "" for r in tables.failure_log(spark, str(tmp_path), keep_bad=True).collect()) == ["", "not json"]


def test_run_log(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,train_losses,bands\na,\"[0.5, 0.25]\",\"['ndvi', 'rgb']\"\nb,[],[]\n")
    got = {r.name: r for r in tables.run_log(spark, str(tmp_path)).collect()}
    assert got["a"].train_losses == [0.5, 0.25] and got["a"].bands == ["ndvi", "rgb"] and got["b"].train_losses == []
