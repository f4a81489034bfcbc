"""Scalar expressions on numbers: parsing, clipping, scaling, quantizing, scoring. Nulls stay null; NaN and infinities become null where said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reflectance ranges by kind of band; indices run from -1 to 1.
BAND_RANGES = {"visible": (0.0, 3600.0), "nir": (0.0, 6000.0), "swir": (0.0, 4800.0)}
LEVELS = {"uint8": 255, "uint16": 65535}


def safe_number(c: Column) -> Column:
    """A number, or null where the text is none."""
    return c.try_cast("double")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def unit_scale(c: Column, low: Column, high: Column) -> Column:
    """(c - low) / (high - low); null if the range is empty."""
    return F.try_divide(c - low, high - low)


def z_score(c: Column, mean: Column, deviation: Column) -> Column:
    return (c - mean) / F.when(deviation == 0, 1.0).otherwise(deviation)


def log_quantize(c: Column, low: float, high: float, dtype: str = "uint16") -> Column:
    """log1p of the positive part, scaled from [low, high] to the integers of the type; not finite counts as 0."""
    x = F.log1p(F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0)))
    return F.floor(clip((x - low) / (high - low), 0.0, 1.0) * LEVELS[dtype]).cast("int")


def quantize(c: Column, kind: str, dtype: str = "uint8", low: Column | None = None, high: Column | None = None) -> Column:
    """Scales a band's value to the integers of the type, by its kind; an unknown kind needs the data's own low and high."""
    x = F.coalesce(finite(c), F.lit(0.0))
    top = LEVELS[dtype]
    if kind == "index":
        return F.floor((clip(x, -1.0, 1.0) + 1) * (top / 2)).cast("int")
    if kind in BAND_RANGES:
        low, high = (F.lit(v) for v in BAND_RANGES[kind])
    return F.floor(F.coalesce(unit_scale(clip(x, low, high), low, high), F.lit(0.0)) * top).cast("int")


def channel_scale(c: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (c - low) / (high - low + 1e-8)


def linspace(i: Column, n: int, low: float, high: float) -> Column:
    """The i-th (from 0) of n equally spaced values, both ends among them."""
    return F.lit(low) + i * F.lit((high - low) / (n - 1) if n > 1 else 0.0)


def weighted_components(parts: Column, weights: Column) -> Column:
    """Sum of weight * part over the absolute sum of weights; a negative weight turns its part round."""
    dot = F.aggregate(F.zip_with(parts, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, F.aggregate(F.transform(weights, F.abs), F.lit(0.0), lambda s, x: s + x))


def asset_score(*flags: Column) -> Column:
    """How many of the columns say yes."""
    return reduce(lambda a, b: a + b, [F.coalesce((f == "yes").cast("int"), F.lit(0)) for f in flags])


def snap_down(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


def snap_up(c: Column, size: float) -> Column:
    return F.ceil(c / size).cast("bigint")


def image_rate(count: Column, seconds: Column) -> Column:
    """Events a minute."""
    return F.try_divide(count * 60.0, seconds)


def _choice(c: Column, values: dict, otherwise: float) -> Column:
    out = None
    for k, v in values.items():
        test = c.isNull() if k is None else c == k
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(otherwise)


def neighbour_complexity(k: Column, metric: Column, algorithm: Column, weights: Column, leaf: Column) -> Column:
    """How costly a nearest-neighbour setting is, from 0 (cheap) to 1. The numbers are fixed values."""
    size = F.when(k <= 5, 0.3).when(k <= 15, 0.1).otherwise(0.2 + (k - 15) / 50.0)
    kind = _choice(metric, {"euclidean": 0.1, "manhattan": 0.15, "minkowski": 0.3, "chebyshev": 0.25, "hamming": 0.1}, 0.3)
    search = _choice(algorithm, {"auto": 0.1, "kd_tree": 0.15, "ball_tree": 0.2, "brute": 0.4}, 0.3)
    return 0.35 * size + 0.25 * kind + 0.2 * search + 0.15 * F.when(weights == "distance", 0.2).otherwise(0.1) + 0.05 * F.when(F.coalesce(leaf, F.lit(30)) >= 30, 0.1).otherwise(0.2)


def chained_complexity(method: Column, iterations: Column, imputations: Column, extra: Column) -> Column:
    """The same for chained equations. extra: what the options of the method add. The numbers are fixed values."""
    return 0.4 * iterations / 20.0 + 0.3 * imputations / 11.0 + 0.2 * _choice(method, {"linear": 0.1, "bayesian_ridge": 0.2, "logistic": 0.3}, 0.4) + 0.1 * extra


def forest_complexity(trees: Column, rounds: Column, depth: Column, features: Column, split: Column) -> Column:
    """The same for forests; a null depth is unlimited, null features are all. The numbers are fixed values."""
    deep = F.when(depth.isNull(), 0.5).otherwise(F.least(depth / 50.0, F.lit(1.0)))
    return 0.4 * trees / 200.0 + 0.25 * rounds / 10.0 + 0.15 * deep + 0.15 * _choice(features, {None: 0.5, "sqrt": 0.2, "log2": 0.3}, 0.4) + 0.05 * 0.5 / F.greatest(split, F.lit(1))
