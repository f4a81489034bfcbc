"""Tables in and out: Parquet, CSV, JSON lines, GeoJSON, run logs. Everything goes through Spark's readers and writers, so any store they know will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import kind_in_name, listed_texts, unquoted_list, year_in_name

FAILURES = "timestamp string, country string, year int, cell_id string, error_type string, error_message string, details map<string,string>, traceback string, _corrupt string"


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def checked(df: DataFrame, required: list[str]) -> DataFrame:
    """Raises if a required column is missing."""
    if gone := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(gone)}")
    return df


def surveys(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All surveys of a folder partitioned by country and year; files that vanish meanwhile are left out."""
    reader = spark.read.option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.parquet")
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Training runs: losses as arrays of numbers, band lists as arrays of text."""
    raw = spark.read.option("header", "true").csv(path)
    kinds = {"train_losses": unquoted_list, "test_losses": unquoted_list, "bands": listed_texts}
    return raw.withColumns({c: f(F.col(c)) for c, f in kinds.items() if c in raw.columns})


def failure_log(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines; lines that aren't JSON are dropped, or kept as text in _corrupt."""
    rows = spark.read.schema(FAILURES).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).select("*")
    return rows if keep_bad else rows.where("timestamp is not null or cell_id is not null or error_type is not null").drop("_corrupt")


def threshold_results(spark: SparkSession, path: str) -> DataFrame:
    """Published threshold results: structures written as Python text, read by pattern."""
    raw = spark.read.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    number = r"(?:np\.float64\()?(-?[0-9.]+(?:e-?[0-9]+)?)"
    field = lambda c, k: F.expr(f"try_cast(nullif(regexp_extract({c}, '\\'{k}\\': {number.replace(chr(92), chr(92) * 2)}', 1), '') as double)")
    return raw.select(
        F.col("threshold").cast("double").alias("threshold"), F.col("percent_cells_labelled").cast("double").alias("percent_cells_labelled"), F.col("num_cells_labelled").cast("int").alias("num_cells_labelled"),
        field("spatial_autocorr", "I").alias("moran_i"), field("spatial_autocorr", "p_value").alias("moran_p"), field("confidence_interval", "width").alias("interval_width"),
    )


def geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON files, one collection a file or (lines) one a line: kind of geometry, coordinates as text, and properties by the given schema."""
    schema = f"features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<{properties}>>>"
    rows = spark.read.schema(schema).option("multiLine", "false" if lines else "true").json(path)
    return rows.select(F.explode("features").alias("f")).select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")


def geojson_text(ring: Column, *properties: str) -> Column:
    """A feature as JSON text: a polygon of the ring, closed."""
    line = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(line).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def write_geojson_lines(df: DataFrame, ring: str, path: str, *properties: str) -> None:
    """A feature a line; features without area are left out."""
    df.where(F.size(ring) >= 3).select(geojson_text(F.col(ring), *properties).alias("value")).write.mode("overwrite").text(path)


def write_collections(df: DataFrame, feature: str, key: Column, path: str, size: int = 1000) -> None:
    """Feature collections, one a line, of about so many features (JSON text) each: the key's hash deals them, so no task holds them all."""
    n = df.agg(F.count(feature).alias("_n"))
    dealt = df.crossJoin(F.broadcast(n)).select(F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(F.col("_n") / size))).alias("_part"), F.col(feature).alias("_f"))
    together = dealt.groupBy("_part").agg(F.concat_ws(",", F.collect_list("_f")).alias("_fs"))
    together.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "_fs", F.lit("]}")).alias("value")).write.mode("overwrite").text(path)


def file_catalog(names: DataFrame, name: str = "name") -> DataFrame:
    """Per year, the labelled and the inferred file of a list of names."""
    rows = names.select(name, year_in_name(F.col(name)).alias("year"), kind_in_name(F.col(name)).alias("kind")).where("year is not null and kind is not null")
    return rows.groupBy("year").pivot("kind", ["labelled", "inferred"]).agg(F.min(name))


def write_both(df: DataFrame, path: str) -> None:
    """Parquet and CSV side by side."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", "true").csv(f"{path}.csv")


def write_panel(df: DataFrame, path: str, by: tuple[str, ...] = ("country", "year")) -> None:
    """One folder for each country and year; rows of a folder are brought together first, so there are few files."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)


def write_flat_csv(df: DataFrame, path: str) -> None:
    """CSV with structures flattened to name_field."""
    flat = [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") if isinstance(f.dataType, T.StructType) else F.col(f.name) for f in df.schema for g in (f.dataType if isinstance(f.dataType, T.StructType) else [None])]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def append_failures(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_runs(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def metadata_text(*fields: str | Column) -> Column:
    """A row as JSON text, for a metadata file of one line."""
    return F.to_json(F.struct(*fields))
