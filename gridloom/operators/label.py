"""Labelling of grid cells: locations, buffers, coverage, weighted labels, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import buffer_radius
from gridloom.functions.numbers import linspace
from gridloom.operators.grid import box_join


def located(clusters: DataFrame, places: DataFrame, on: Column, on_missing: str = "keep") -> DataFrame:
    """Clusters with their locations. A cluster without one is kept with nulls, dropped, or an error: keep, drop, error."""
    if on_missing == "drop":
        return places.join(clusters, on, "inner")
    joined = places.join(clusters, on, "right")
    if on_missing == "error":
        return joined.withColumn("urban_rura", F.coalesce("urban_rura", F.raise_error(F.lit("a cluster has no location")).cast("string")))
    return joined


def square_buffers(points: DataFrame, x: str = "x", y: str = "y", place: str = "urban_rura") -> DataFrame:
    """Boxes around points, half as wide as the radius of the place's class says on each side."""
    r = buffer_radius(F.col(place))
    return points.select("*", (F.col(x) - r).alias("x0"), (F.col(y) - r).alias("y0"), (F.col(x) + r).alias("x1"), (F.col(y) + r).alias("y1"))


def double_weighted_mean(value: Column, area: Column, weight: Column) -> Column:
    """Mean weighted by area and survey weight; a single match is taken as it is, whatever its area."""
    return F.when(F.count(value) == 1, F.max(value)).otherwise(F.try_divide(F.sum(area * weight * value), F.sum(area * weight)))


def coverage(cells: DataFrame, key: str, boxes: DataFrame, value: str, bin_size: float) -> DataFrame:
    """Per cell: its area, the area that boxes cover, in per cent too, and the mean of their values weighted by area.

    Cells without a match have 0, 0 and null. Boxes that overlap each other count each.
    """
    met = box_join(cells.select(key, "x0", "y0", "x1", "y1"), boxes.select("x0", "y0", "x1", "y1", value), bin_size)
    sums = met.groupBy(F.col(f"a_{key}").alias(key)).agg(F.sum("overlap").alias("_area"), F.sum(F.col("overlap") * F.col(f"b_{value}")).alias("_sum"))
    total = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    covered = F.coalesce("_area", F.lit(0.0))
    return cells.join(sums, key, "left").select(
        key, total.alias("total_area"), covered.alias("covered_area"), (100 * covered / total).alias("coverage_percent"), F.when(covered > 0, F.try_divide("_sum", "_area")).alias("weighted_wealth")
    )


def with_threshold(cells: DataFrame, percent: float | Column, label: str = "weighted_wealth") -> DataFrame:
    """Labels of cells that are covered less than the threshold become null; the cells stay."""
    return cells.withColumn(label, F.when(F.col("coverage_percent") >= percent, F.col(label)))


def sweep(cells: DataFrame, steps: int = 20, low: float = 30.0, high: float = 35.0, label: str = "weighted_wealth", by: tuple[str, ...] = ()) -> DataFrame:
    """For each of equally spaced thresholds: cells, labelled cells, their share, mean, deviation. The step's number is the key."""
    rows = cells.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("threshold", linspace(F.col("step"), steps, low, high))
    kept = F.when(F.col("coverage_percent") >= F.col("threshold"), F.col(label))
    return rows.groupBy(*by, "step").agg(
        F.min("threshold").alias("threshold"), F.count("*").alias("num_cells"), F.count(kept).alias("num_cells_labelled"),
        (100 * F.count(kept) / F.count("*")).alias("percent_cells_labelled"), F.avg(kept).alias("mean_label"), F.stddev_samp(kept).alias("std_label"),
    )


def with_predictions(cells: DataFrame, predictions: DataFrame, key: list[str], label: str = "weighted_wealth", predicted: str = "prediction") -> DataFrame:
    """Null labels filled from predictions where there are any; predicted_flag tells which."""
    joined = cells.join(predictions.select(*key, predicted), key, "left")
    flag = F.col(label).isNull() & F.col(predicted).isNotNull()
    return joined.select(*[F.coalesce(label, predicted).alias(label) if c == label else F.col(c) for c in cells.columns], flag.alias("predicted_flag"))


def cell_counts(cells: DataFrame, thresholds: list[float]) -> DataFrame:
    """All cells, covered cells, and cells covered at least as much as each threshold."""
    p = F.col("coverage_percent")
    return cells.agg(F.count("*").alias("cells"), F.count_if(p > 0).alias("covered_cells"), *[F.count_if(p >= t).alias(f"at_least_{t:g}".replace(".", "_")) for t in thresholds])
