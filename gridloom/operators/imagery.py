"""Image collections: filters, choice of images, composites, derived bands, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import raster
from gridloom.functions.dates import in_range

#: Bands of early images that are stored as reflectance and need scaling.
REFLECTANCE_BANDS = ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B11", "B12")


def usable_images(images: DataFrame, start: Column, until: Column, cloud: str = "cloud_pct", ts: str = "ts", most_cloud: float = 20.0) -> DataFrame:
    """Images of a half-open time range with less cloud than the limit; both conditions reach the scan."""
    return images.where(in_range(F.col(ts), start, until) & (F.col(cloud) < most_cloud))


def selected_images(images: DataFrame, cell: str, month: Column, cloud: str, image: str, per_month: int = 5, total: int = 60) -> DataFrame:
    """Per cell the least cloudy images of each month, and from the months with most left as many more as the total lacks."""
    ranked = images.withColumn("month", month).withColumn("rank", F.row_number().over(Window.partitionBy(cell, "month").orderBy(cloud, image)))
    months = ranked.groupBy(cell, "month").agg(F.count("*").alias("_n"))
    months = months.withColumn("_extra", F.greatest(F.col("_n") - per_month, F.lit(0))).withColumn("_chosen", F.least(F.col("_n"), F.lit(per_month)))
    need = F.greatest(F.lit(total) - F.sum("_chosen").over(Window.partitionBy(cell)), F.lit(0))
    before = F.coalesce(F.sum("_extra").over(Window.partitionBy(cell).orderBy(F.desc("_extra"), "month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    months = months.withColumn("_take", F.least("_extra", F.greatest(need - before, F.lit(0))))
    return ranked.join(months.select(cell, "month", "_take"), [cell, "month"]).where(F.col("rank") <= per_month + F.col("_take")).drop("_take")


def composite(images: DataFrame, by: tuple[str, ...], pixels: str, how: str = "median") -> DataFrame:
    """Pixel by pixel median or mean over images; pixels that are null or not finite don't count, and are 0 where no image has a value.

    Pixels are keyed by position, so a group of any number of images is combined in parallel.
    """
    one = F.when(~F.isnan("value"), F.col("value").cast("double"))
    fold = F.median(one) if how == "median" else F.avg(one)
    rows = images.select(*by, F.posexplode(pixels).alias("pos", "value")).groupBy(*by, "pos").agg(fold.alias("value"))
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_p")).select(*by, F.transform("_p", lambda p: F.coalesce(p["value"], F.lit(0.0))).alias("data"))


def rescaled(bands: DataFrame, early: Column, band: str = "band", value: str = "value", factor: float = 10000.0) -> DataFrame:
    """Reflectance bands of early images in the units of later ones."""
    return bands.withColumn(value, F.when(early & F.col(band).isin(*REFLECTANCE_BANDS), F.col(value) * factor).otherwise(F.col(value)))


def with_fallback(first: DataFrame, second: DataFrame, key: list[str], least: int = 10) -> DataFrame:
    """Rows of the first collection for keys with enough of them, of the second for all other keys that it has."""
    enough = first.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*key)
    return first.join(enough, key, "left_semi").withColumn("source", F.lit("first")).unionByName(second.join(enough, key, "left_anti").withColumn("source", F.lit("second")), allowMissingColumns=True)


def band_table(cells: DataFrame, key: list[str], band: str = "band", data: str = "data", bands: tuple[str, ...] = ("B2", "B3", "B4", "B8", "B11", "B12")) -> DataFrame:
    """Long rows (key, band, data) to one row a key with a column a band."""
    return cells.groupBy(*key).pivot(band, list(bands)).agg(F.first(data, ignorenulls=True))


def processed_bands(wide: DataFrame, key: list[str]) -> DataFrame:
    """Long rows of the products that a cell's bands allow: rgb, nir, swir1, swir2, ndvi, built_up; a product without its inputs is left out."""
    c = F.col
    products = {
        "rgb": raster.stacked(*[raster.quantized(c(b), "visible", "uint8") for b in ("B4", "B3", "B2")]),
        "nir": raster.quantized(c("B8"), "nir", "uint16"),
        "swir1": raster.quantized(c("B11"), "swir", "uint16"),
        "swir2": raster.quantized(c("B12"), "swir", "uint16"),
        "ndvi": raster.quantized(raster.ndvi(c("B8"), c("B4")), "index", "uint8"),
        "built_up": raster.quantized(raster.built_up(c("B11"), c("B8")), "index", "uint8"),
    }
    flat = {k: F.flatten(v) if k == "rgb" else v for k, v in products.items()}
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("band"), v.alias("data")) for k, v in flat.items()]), lambda r: r["data"].isNotNull())
    return wide.select(*key, F.inline(rows))


def night_lights(cells: DataFrame, key: list[str], data: str = "data", height: str = "height", width: str = "width") -> DataFrame:
    """Night light products: logarithm of the light in 16 bits, and the gradient scaled by 200 in 16 bits."""
    clean = cells.withColumn("_a", raster.filled(F.transform(data, lambda x: x.cast("double")))).withColumn("_s", raster.convolved(F.col("_a"), F.col(height), F.col(width), raster.SMOOTH))
    slope = raster.gradient(F.col("_s"), F.col(height), F.col(width))
    return clean.select(*key, raster.log_quantized(F.col(data)).alias("nightlights"), raster.log_quantized(slope, 0.0, 200.0).alias("gradient"))


def fused(first: DataFrame, second: DataFrame, key: list[str], prefixes: tuple[str, str] = ("sentinel_", "viirs_")) -> DataFrame:
    """Cells that both sources have, the columns of each with its prefix."""
    named = lambda df, p: df.select(*key, *[F.col(c).alias(p + c) for c in df.columns if c not in key])
    return named(first, prefixes[0]).join(named(second, prefixes[1]), key)


def image_counts(collections: DataFrame, key: list[str], nested: str) -> DataFrame:
    """Images of nested collections."""
    return collections.groupBy(*key).agg(F.sum(F.size(F.flatten(nested))).alias("images"))
