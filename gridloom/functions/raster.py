"""Expressions on rasters: a band is an array in row-major order, with its height and width beside it.

Higher-order functions do per pixel work inside the JVM and suit small rasters; ``gridloom.operators.rasters`` has Arrow kernels for large ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.numbers import channel_scale, clip, finite, log_quantize, quantize

#: Classes of the scene map that are cloud, shadow or saturated; bits of the mask for cloud and shadow.
CLOUDY_CLASSES = (3, 8, 9, 10)
CLOUD_BIT, SHADOW_BIT = 2, 8


def filled(a: Column) -> Column:
    """Not finite becomes 0."""
    return F.transform(a, lambda x: F.coalesce(finite(x), F.lit(0.0)))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) per pixel, 0 where the sum is 0, within -1 and 1."""
    return F.zip_with(a, b, lambda x, y: clip(F.when(x + y == 0, 0.0).otherwise(F.try_divide(x - y, x + y)), -1.0, 1.0))


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def built_up(swir: Column, nir: Column) -> Column:
    return normalized_difference(swir, nir)


def stacked(*bands: Column) -> Column:
    """Pixels as arrays of their bands' values (height * width * bands)."""
    return F.transform(F.arrays_zip(*[b.alias(f"b{i}") for i, b in enumerate(bands)]), lambda p: F.array(*[p[f"b{i}"] for i in range(len(bands))]))


def channels_first(*bands: Column) -> Column:
    return F.flatten(F.array(*bands))


def quantized(a: Column, kind: str, dtype: str = "uint8") -> Column:
    if kind in ("visible", "nir", "swir", "index"):
        return F.transform(a, lambda x: quantize(x, kind, dtype))
    clean = filled(a)
    return F.transform(clean, lambda x: quantize(x, "own", dtype, F.array_min(clean), F.array_max(clean)))


def log_quantized(a: Column, low: float = 0.0, high: float = 5.0, dtype: str = "uint16") -> Column:
    return F.transform(a, lambda x: log_quantize(x, low, high, dtype))


def channel_scaled(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: channel_scale(x, low, high))


def masked_by_class(a: Column, classes: Column, dropped: tuple[int, ...] = CLOUDY_CLASSES) -> Column:
    """Pixels of cloudy classes become null."""
    return F.zip_with(a, classes, lambda x, c: F.when(~c.isin(*dropped), x))


def clear_bits(mask: Column) -> Column:
    return (mask.bitwiseAND(CLOUD_BIT) == 0) & (mask.bitwiseAND(SHADOW_BIT) == 0)


def masked_by_bits(a: Column, masks: Column) -> Column:
    return F.zip_with(a, masks, lambda x, m: F.when(clear_bits(m), x))


def blank(a: Column) -> Column:
    """Empty, or 0 everywhere."""
    return (F.size(a) == 0) | F.forall(a, lambda x: x == 0)


def distinct_values(a: Column) -> Column:
    return F.size(F.array_distinct(a))


def missing_bands(expected: list[str], present: Column) -> Column:
    return F.array_except(F.array(*[F.lit(b) for b in expected]), present)


def _at(a: Column, h: Column, w: Column, y: Column, x: Column) -> Column:
    """The pixel at y, x; beyond an edge the raster is mirrored without repeating the edge."""
    mirror = lambda i, n: F.when(n == 1, 0).otherwise((n - 1) - F.abs((n - 1) - F.pmod(i, 2 * n - 2)))
    return F.get(a, (mirror(y, h) * w + mirror(x, w)).cast("int"))


def convolved(a: Column, h: Column, w: Column, kernel: tuple[tuple[float, ...], ...]) -> Column:
    """3 x 3 correlation with mirrored edges."""
    taps = [(dy, dx, k) for dy, row in enumerate(kernel, -1) for dx, k in enumerate(row, -1) if k]

    def pixel(i: Column) -> Column:
        y, x = F.floor(i / w), F.pmod(i, w)
        out = None
        for dy, dx, k in taps:
            term = F.lit(float(k)) * _at(a, h, w, y + dy, x + dx)
            out = term if out is None else out + term
        return out

    return F.transform(F.sequence(F.lit(0), (h * w - 1).cast("int")), pixel)


#: 3 x 3 smoothing and derivative kernels.
SMOOTH = ((1 / 16, 2 / 16, 1 / 16), (2 / 16, 4 / 16, 2 / 16), (1 / 16, 2 / 16, 1 / 16))
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))


def gradient(a: Column, h: Column, w: Column) -> Column:
    """Length of the derivative of the smoothed raster. a must be a plain column, as it is referred to many times; see with_gradient."""
    return F.zip_with(convolved(a, h, w, SOBEL_X), convolved(a, h, w, SOBEL_Y), lambda x, y: F.sqrt(x * x + y * y))


def flipped(a: Column, h: Column, w: Column, horizontal: bool) -> Column:
    at = (lambda y, x: y * w + (w - 1 - x)) if horizontal else (lambda y, x: (h - 1 - y) * w + x)
    return F.transform(F.sequence(F.lit(0), (h * w - 1).cast("int")), lambda i: F.get(a, at(F.floor(i / w), F.pmod(i, w)).cast("int")))


def quarter_turn(a: Column, h: Column, w: Column) -> Column:
    """Turned by 90 degrees against the clock; the result has height w and width h."""
    return F.transform(F.sequence(F.lit(0), (h * w - 1).cast("int")), lambda i: F.get(a, (F.pmod(i, h) * w + (w - 1 - F.floor(i / h))).cast("int")))


def pixel_size(low: Column, high: Column, n: Column) -> Column:
    return (high - low) / n


def loss_metrics(train: Column, test: Column) -> Column:
    """From two loss sequences: improvements, volatility of the test loss (population deviation), overfit gap, score; null with fewer than two epochs."""
    gain = lambda a: (F.get(a, F.lit(0)) - F.element_at(a, -1)) / (F.get(a, F.lit(0)) + 1e-8)
    mean = F.aggregate(test, F.lit(0.0), lambda s, x: s + x) / F.size(test)
    spread = F.sqrt(F.aggregate(test, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(test))
    gap = F.abs(F.element_at(train, -1) - F.element_at(test, -1))
    enough = F.least(F.size(train), F.size(test)) >= 2
    fields = F.struct(gain(train).alias("train_improvement"), gain(test).alias("test_improvement"), spread.alias("volatility"), gap.alias("overfit_gap"), (gain(test) - 2 * spread - gap).alias("score"))
    return F.when(enough, fields)


def best_epoch(losses: Column) -> Column:
    """The first epoch (from 1) with the smallest loss."""
    return F.array_position(losses, F.array_min(losses))
