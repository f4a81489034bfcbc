"""Arrow kernels for rasters too large for higher-order functions: resampling, gradients; and the band-statistics regressor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kernel(name: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if name == "cubic":
        a = -0.75
        return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a, 0.0))
    return np.where(x < 4, np.sinc(x) * np.sinc(x / 4), 0.0)


def _weights(n: int, m: int, name: str) -> np.ndarray:
    """Rows: the n inputs' weights for each of m outputs; half-pixel centres, edges repeated, weights of an output sum to 1."""
    reach = 2 if name == "cubic" else 4
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    out = np.zeros((m, n))
    for k in range(-reach + 1, reach + 1):
        at = np.floor(centre).astype(int) + k
        np.add.at(out, (np.arange(m), np.clip(at, 0, n - 1)), _kernel(name, centre - at))
    return out / out.sum(1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic when the raster is larger than the target, Lanczos over four pixels when it is smaller."""
    name = "cubic" if a.shape[0] * a.shape[1] >= height * width else "lanczos"
    return _weights(a.shape[0], height, name) @ a @ _weights(a.shape[1], width, name).T


def resampled(cells: DataFrame, size: int = 256, data: str = "data", height: str = "height", width: str = "width") -> DataFrame:
    """Every band at size x size; a band that isn't height x width long becomes null."""

    @F.pandas_udf("array<double>")
    def change(a: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or len(x) != p * q or not len(x) else resize(np.nan_to_num(np.asarray(x, float), posinf=0, neginf=0).reshape(p, q), size, size).ravel() for x, p, q in zip(a, h, w, strict=True)])

    return cells.withColumn(data, change(data, height, width)).withColumns({height: F.lit(size), width: F.lit(size)})


def gradient_kernel(a: np.ndarray) -> np.ndarray:
    """Smoothing and both derivatives over 3 x 3 with mirrored edges; length of the derivative."""
    padded = lambda x: np.pad(x, 1, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")

    def run(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        p = padded(x)
        return sum(k[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3))

    smooth = run(a, np.outer([1, 2, 1], [1, 2, 1]) / 16)
    dx = np.outer([1, 2, 1], [-1, 0, 1])
    return np.hypot(run(smooth, dx), run(smooth, dx.T))


def with_gradient(cells: DataFrame, data: str = "data", height: str = "height", width: str = "width") -> DataFrame:
    @F.pandas_udf("array<double>")
    def slope(a: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([gradient_kernel(np.nan_to_num(np.asarray(x, float), posinf=0, neginf=0).reshape(p, q)).ravel() for x, p, q in zip(a, h, w, strict=True)])

    return cells.withColumn("gradient", slope(data, height, width))


def band_statistics(cells: DataFrame, key: list[str], bands: list[str], band: str = "band", data: str = "data") -> DataFrame:
    """Mean, deviation, least and largest value of every band of a cell: the features of the regressor."""
    a = F.transform(data, lambda x: x.cast("double"))
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    rows = cells.select(*key, band, mean.alias("mean"), F.array_min(a).alias("least"), F.array_max(a).alias("most"), (F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a)).alias("_sq"))
    rows = rows.withColumn("deviation", F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("mean") * F.col("mean")))).drop("_sq")
    return rows.groupBy(*key).pivot(band, bands).agg(*[F.first(c).alias(c) for c in ("mean", "deviation", "least", "most")])


def fitted_labels(features: DataFrame, key: list[str], label: str, names: list[str]) -> DataFrame:
    """Predictions for all rows of a regression learned from those with a label, between 0 and 1 like the labels."""
    rows = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="skip").transform(features)
    model = LinearRegression(featuresCol="_x", labelCol=label, regParam=1e-3, solver="normal").fit(rows.where(F.col(label).isNotNull()))
    return model.transform(rows).select(*key, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("prediction"))
