"""Failure logs, integrity scans and repair rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import raster
from gridloom.functions.dates import elapsed_seconds


def failed_cells(log: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Distinct cells of a failure log: entries without a cell, of the whole run or of a batch are left out."""
    c = F.col(cell).cast("string")
    return log.where(c.isNotNull() & (c != "global") & ~c.startswith("batch")).select(c.try_cast("int").alias(cell)).where(F.col(cell).isNotNull()).distinct()


def failure_summary(log: DataFrame, kind: str = "error_type") -> DataFrame:
    return log.groupBy(F.coalesce(kind, F.lit("unknown")).alias(kind)).agg(F.count("*").alias("n"))


def repair_summary(log: DataFrame, kind: str = "original_error", success: str = "success") -> DataFrame:
    """Attempts, successes and the success rate as text for each kind of error."""
    got = log.groupBy(F.coalesce(kind, F.lit("unknown")).alias(kind)).agg(F.count(success).alias("attempts"), F.count_if(F.col(success)).alias("successes"))
    return got.withColumn("success_rate", F.when(F.col("attempts") > 0, F.format_string("%.1f%%", 100.0 * F.try_divide("successes", "attempts"))).otherwise("N/A"))


def status_counts(df: DataFrame, status: str, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """How many rows have each status, a column each, and the total."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])


def request_counts(log: DataFrame, cell: str) -> DataFrame:
    """Total requests, mean and most of a cell."""
    return log.groupBy(cell).agg(F.count("*").alias("_n")).agg(F.sum("_n").alias("total"), F.avg("_n").alias("mean_per_cell"), F.max("_n").alias("most_of_a_cell"))


def unfinished(todo: DataFrame, finished: DataFrame, key: list[str]) -> DataFrame:
    """What has still to be done."""
    return todo.join(finished.select(*key), key, "left_anti")


def array_facts(df: DataFrame, key: list[str], data: str, bytes_per_value: int = 4) -> DataFrame:
    """Smallest, largest, distinct, number and bytes of the values of an array."""
    a = F.col(data)
    return df.select(*key, F.array_min(a).alias("min"), F.array_max(a).alias("max"), raster.distinct_values(a).alias("distinct"), F.size(a).alias("size"), (F.size(a) * bytes_per_value).alias("bytes"))


def scan_problems(cells: DataFrame, key: list[str], expected: list[str], band: str = "band", data: str = "data") -> DataFrame:
    """Cells with missing, empty or blank bands: what is wrong, a row each."""
    got = cells.groupBy(*key).agg(F.collect_set(band).alias("_have"), F.sort_array(F.collect_set(F.when(raster.blank(F.col(data)), F.col(band)))).alias("blank"))
    missing = F.sort_array(raster.missing_bands(expected, F.col("_have")))
    return got.select(*key, missing.alias("missing"), "blank").where((F.size("missing") > 0) | (F.size("blank") > 0))


def column_timings(log: DataFrame, column: str, ts: str) -> DataFrame:
    """Seconds between the first and the last entry of each column, and its part of all."""
    return log.groupBy(column).agg(elapsed_seconds(F.min(ts), F.max(ts)).alias("seconds"), F.count("*").alias("entries"))


def repair_rounds(scan: Callable[[], DataFrame], repair: Callable[[DataFrame], None], most: int = 100) -> int:
    """Scans and repairs what the scan finds until it finds nothing; returns the number of rounds. Only whether there are problems reaches the driver."""
    for i in range(most):
        problems = scan()
        if problems.isEmpty():
            return i
        repair(problems)
    return most


def repaired(attempted: DataFrame, still_failing: DataFrame, key: list[str]) -> DataFrame:
    return attempted.select(*key).distinct().join(still_failing.select(*key), key, "left_anti")


def last_match(df: DataFrame, by: list[str], order: Column | str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")
