"""Foreign formats, parsed from file contents that Spark's binaryFile reader delivers, so they may lie in any store: NPZ, GeoPackage, shapefile; and a converter from Stata."""

from __future__ import annotations

import io
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RING = "array<struct<x:double,y:double>>"
SHAPES = f"path string, shape bigint, part int, ring {RING}"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def npz_bands(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of the arrays in NPZ files: path, band, height, width, data. Files that can't be read give a row with null band."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        for name in z.files:
                            a = np.atleast_2d(z[name])
                            out.append((p, name, a.shape[0], a.shape[1], a.astype(float).ravel()))
                except (ValueError, OSError, KeyError, EOFError):
                    out.append((p, None, None, None, None))
            yield pd.DataFrame(out, columns=["path", "band", "height", "width", "data"])

    return _files(spark, path, "*.npz").mapInPandas(rows, "path string, band string, height int, width int, data array<double>")


def wkb_rings(b: bytes) -> list[list[tuple[float, float]]]:
    """Rings of polygons and points of the other simple kinds in well-known binary; two dimensions are kept."""
    out: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        order = "<" if b[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", b, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[(code & 0xFFFF) // 1000]
        kind = (code & 0xFFFF) % 1000

        def points(at: int, n: int) -> tuple[list[tuple[float, float]], int]:
            v = struct.unpack_from(f"{order}{n * dims}d", b, at)
            return [(v[i * dims], v[i * dims + 1]) for i in range(n)], at + 8 * n * dims

        if kind == 1:
            p, at = points(at, 1)
            out.append(p)
            return at
        (n,) = struct.unpack_from(order + "I", b, at)
        at += 4
        if kind == 2:
            p, at = points(at, n)
            out.append(p)
        elif kind == 3:
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", b, at)
                p, at = points(at + 4, m)
                out.append(p)
        else:
            for _ in range(n):
                at = read(at)
        return at

    read(0)
    return out


def geopackage_rings(spark: SparkSession, path: str, attributes: str = "") -> DataFrame:
    """Rings of all features of GeoPackage files: path, layer, shape, part, ring, and attributes as JSON text."""
    import json

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                if not bytes(content[:15]) == b"SQLite format 3":
                    continue
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                for layer, column in db.execute("select table_name, column_name from gpkg_geometry_columns").fetchall():
                    quoted = layer.replace('"', '""')
                    cursor = db.execute(f'select * from "{quoted}"')
                    names = [d[0] for d in cursor.description]
                    at = names.index(column)
                    for i, r in enumerate(cursor):
                        if r[at] is None:
                            continue
                        flags = r[at][3]
                        start = 8 + (0, 32, 48, 48, 64)[flags >> 1 & 7]
                        rest = json.dumps({n: v for n, v in zip(names, r, strict=True) if n != column and not isinstance(v, bytes)})
                        for k, ring in enumerate([] if flags >> 4 & 1 else wkb_rings(r[at][start:])):
                            out.append((p, layer, i, k, [{"x": x, "y": y} for x, y in ring], rest))
                db.close()
            yield pd.DataFrame(out, columns=["path", "layer", "shape", "part", "ring", "attributes"])

    return _files(spark, path, "*.gpkg").mapInPandas(rows, f"path string, layer string, shape bigint, part int, ring {RING}, attributes string")


def shapefile_rings(spark: SparkSession, path: str) -> DataFrame:
    """Rings, lines or points of .shp files: path, shape (record number from 0), part, ring."""

    def shapes(b: bytes) -> Iterator[tuple[int, int, list[dict]]]:
        at, n = 100, 0
        while at + 12 <= len(b):
            (length,) = struct.unpack_from(">i", b, at + 4)
            (kind,) = struct.unpack_from("<i", b, at + 8)
            if kind in (1, 11, 21):
                x, y = struct.unpack_from("<2d", b, at + 12)
                yield n, 0, [{"x": x, "y": y}]
            elif kind in (3, 5, 13, 15, 23, 25):
                parts, points = struct.unpack_from("<2i", b, at + 44)
                first = [*struct.unpack_from(f"<{parts}i", b, at + 52), points]
                v = struct.unpack_from(f"<{2 * points}d", b, at + 52 + 4 * parts)
                for k in range(parts):
                    yield n, k, [{"x": v[2 * i], "y": v[2 * i + 1]} for i in range(first[k], first[k + 1])]
            at += 8 + 2 * length
            n += 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *s) for p, c in zip(pdf["path"], pdf["content"], strict=True) for s in shapes(bytes(c))], columns=["path", "shape", "part", "ring"])

    return _files(spark, path, "*.shp").mapInPandas(rows, SHAPES)


def dbf_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of .dbf files: path, shape (record number from 0), name, value as text. Deleted records keep their number and are left out."""

    def records(b: bytes) -> Iterator[tuple[int, str, str | None]]:
        count, header, size = struct.unpack_from("<IHH", b, 4)
        fields, at = [], 32
        while at < header - 1 and b[at] != 0x0D:
            fields.append((b[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), b[at + 16]))
            at += 32
        for i in range(count):
            p = header + i * size
            if b[p : p + 1] == b"*":
                continue
            p += 1
            for name, width in fields:
                yield i, name, b[p : p + width].decode("utf-8", "replace").strip() or None
                p += width

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in records(bytes(c))], columns=["path", "shape", "name", "value"])

    return _files(spark, path, "*.dbf").mapInPandas(rows, "path string, shape bigint, name string, value string")


def stata_to_parquet(spark: SparkSession, source: str, target: str, columns: list[str], year: int, chunk: int = 50_000) -> None:
    """One survey file to Parquet, in chunks; hv007 becomes the survey's year. Labels are kept as text. Runs once for each file, on the driver."""
    with pd.read_stata(source, columns=columns, convert_categoricals=True, chunksize=chunk) as reader:
        for i, pdf in enumerate(reader):
            text = pdf.astype(object).where(pdf.notna(), None)
            text["hv007"] = year
            for c in text.columns:
                if text[c].map(lambda v: isinstance(v, str)).any():
                    text[c] = text[c].map(lambda v: None if v is None else str(v))
            spark.createDataFrame(text).write.mode("overwrite" if i == 0 else "append").parquet(target)
