"""Statistics: summaries, intervals, regressions, errors, correlation in space, windows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.functions.dates import elapsed_seconds
from gridloom.functions.numbers import finite
from gridloom.operators.grid import queen_neighbours


def summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, smallest, largest, median and sample deviation of the values that are there."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def summary_sets(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Means and counts for all combinations of the keys and their totals."""
    return df.cube(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().cast("int").alias("level"))


def value_range(df: DataFrame, value: str) -> DataFrame:
    """Smallest and largest value over everything; 0 and 1 if there is none."""
    return df.agg(F.coalesce(F.min(value), F.lit(0.0)).alias("global_min"), F.coalesce(F.max(value), F.lit(1.0)).alias("global_max"))


def aggregated_sweeps(results: DataFrame) -> DataFrame:
    """Yearly threshold results to one row for each step: mean, smallest and largest of the share labelled, of Moran's I and of the interval's width.

    results: step, threshold, percent_cells_labelled, moran_i, moran_p, interval_width; null statistics are skipped.
    """
    three = lambda c, name: [F.avg(c).alias(name), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    return results.groupBy("step").agg(
        F.min("threshold").alias("threshold"), F.count("*").alias("num_years"), *three("percent_cells_labelled", "percent_cells"), *three("moran_i", "moran_i"), F.avg("moran_p").alias("moran_p"), *three("interval_width", "interval_width")
    )


def _beta_continued(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_continued(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    """Quantile (p above 0.5) of Student's distribution, by bisection of its distribution function."""
    low, high = 0.0, 1e6
    for _ in range(200):
        t = (low + high) / 2
        if 1 - 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t)) < p:
            low = t
        else:
            high = t
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    """One value for each distinct number of degrees of freedom of a batch."""
    known = {n: t_quantile(0.975, n) for n in df.dropna().unique() if n > 0}
    return df.map(known).astype(float)


def mean_interval(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and its 95 % interval by Student's distribution; no interval with fewer than two values or no spread."""
    got = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n"))
    half = F.when((F.col("n") > 1) & (F.col("_s") > 0), t_quantile_975(F.col("n") - 1) * F.col("_s") / F.sqrt("n"))
    return got.withColumn("_h", half).select(*by, "n", "mean", (F.col("mean") - F.col("_h")).alias("lower"), (F.col("mean") + F.col("_h")).alias("upper"), (2 * F.col("_h")).alias("width"))


def moran_i(cells: DataFrame, value: str, by: tuple[str, ...] = (), i: str = "i", j: str = "j") -> DataFrame:
    """Moran's I with row-standardized queen weights over the cells that have a value; null without spread or neighbours."""
    known = cells.where(F.col(value).isNotNull()).select(*by, i, j, F.col(value).cast("double").alias("_x"))
    centre = known.groupBy(*by).agg(F.avg("_x").alias("_m"), F.count("*").alias("n"))
    z = (known.join(centre, list(by)) if by else known.crossJoin(F.broadcast(centre))).withColumn("_z", F.col("_x") - F.col("_m")).withColumn("cell", F.struct(i, j))
    pairs = queen_neighbours(z.select(*by, "cell", i, j), "cell", by, i, j)
    other = pairs.join(z.select(*by, F.col("cell").alias("neighbour"), F.col("_z").alias("_zn")), [*by, "neighbour"])
    lag = other.groupBy(*by, "cell").agg(F.avg("_zn").alias("_lag"))
    joined = z.join(lag, [*by, "cell"], "left")
    sums = joined.groupBy(*by).agg(F.max("n").alias("n"), F.count("_lag").alias("_s0"), F.sum(F.col("_z") * F.coalesce("_lag", F.lit(0.0))).alias("_num"), F.sum(F.col("_z") * F.col("_z")).alias("_den"))
    return sums.select(*by, "n", F.when(F.col("_s0") > 0, F.try_divide(F.col("n") * F.col("_num"), F.col("_s0") * F.when(F.col("_den") > 1e-300, F.col("_den")))).alias("moran_i"))


def moran_permutation(cells: DataFrame, value: str, by: tuple[str, ...], permutations: int = 999, seed: int = 12345, i: str = "i", j: str = "j") -> DataFrame:
    """Moran's I of each group with a pseudo p-value: (as extreme or more among shuffled values + 1) / (permutations + 1)."""

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["_x"])
        out = pd.DataFrame([key], columns=list(by))
        at = {(a, b): n for n, (a, b) in enumerate(zip(pdf["_i"], pdf["_j"], strict=True))}
        rows, cols = [], []
        for (a, b), n in at.items():
            for c in ((a + da, b + db) for da in (-1, 0, 1) for db in (-1, 0, 1) if da or db):
                if c in at:
                    rows.append(n)
                    cols.append(at[c])
        z = pdf["_x"].to_numpy(float)
        z = z - z.mean() if len(z) else z
        if not rows or not (z @ z) > 0:
            return out.assign(n=len(z), moran_i=np.nan, p_value=np.nan)
        degree = np.bincount(rows, minlength=len(z))
        weight = 1.0 / degree[rows]
        factor = len(z) / np.count_nonzero(degree) / (z @ z)
        index = lambda v: factor * (weight * np.take(v, rows, 1) * np.take(v, cols, 1)).sum(1)
        rng, few = np.random.default_rng(seed), max(1, 1_000_000 // len(rows))
        seen = index(z[None, :])[0]
        drawn = np.concatenate([index(np.array([rng.permutation(z) for _ in range(min(few, permutations - k))])) for k in range(0, permutations, few)])
        larger = int((drawn >= seen).sum())
        return out.assign(n=len(z), moran_i=seen, p_value=(min(larger, permutations - larger) + 1) / (permutations + 1))

    kinds = ", ".join(f"{c} {dict(cells.dtypes)[c]}" for c in by)
    rows = cells.select(*by, F.col(i).cast("bigint").alias("_i"), F.col(j).cast("bigint").alias("_j"), F.col(value).cast("double").alias("_x"))
    return rows.groupBy(*by).applyInPandas(test, f"{kinds}, n bigint, moran_i double, p_value double")


def ols(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """Slope, intercept, R squared and number of points of each group with at least so many; built-in aggregates, combined before the shuffle."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    got = both.groupBy(*by).agg(F.regr_slope(fy, fx).alias("slope"), F.regr_intercept(fy, fx).alias("intercept"), F.regr_r2(fy, fx).alias("r2"), F.count("*").alias("n"))
    return got.where(F.col("n") >= least)


def predicted(models: DataFrame, x: float, name: str = "prediction") -> DataFrame:
    return models.withColumn(name, F.col("intercept") + F.col("slope") * F.lit(float(x)))


def group_forecast(panel: DataFrame, key: str, year: str, value: str, target: int, exclude_years: tuple[int, ...] | None = None) -> DataFrame:
    """Per key, the value a regression on the years predicts for the target year; by default without that year itself."""
    left_out = (target,) if exclude_years is None else exclude_years
    rows = panel.where(~F.col(year).isin(*left_out)) if left_out else panel
    return predicted(ols(rows, year, value, (key,)), target).select(key, "n", "slope", "intercept", "prediction")


def errors(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    """Mean absolute percentage error (actual 0 is left out) and R squared of forecasts."""
    a, p = F.col(actual), F.col(forecast)
    both = df.where(a.isNotNull() & p.isNotNull())
    return both.agg((100 * F.avg(F.try_divide(F.abs(a - p), F.abs(a)))).alias("mape"), (1 - F.try_divide(F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(a))).alias("r2"), F.count("*").alias("n"))


def imputation_error(df: DataFrame, actual: str, guess: str, kind: str = "numeric") -> DataFrame:
    """Root mean square error over the range of the true values, 1 at most (range 1 for a constant); for categories the share of wrong ones."""
    a, g = F.col(actual), F.col(guess)
    if kind == "numeric":
        spread = F.max(a) - F.min(a)
        return df.agg(F.least(F.sqrt(F.avg((a - g) * (a - g))) / F.when(spread == 0, 1.0).otherwise(spread), F.lit(1.0)).alias("error"))
    return df.agg(F.avg((~a.eqNullSafe(g)).cast("double")).alias("error"))


def weighted_score(df: DataFrame, score: str, missing: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of scores weighted by missing values; 0 where none is missing."""
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col(score) * F.col(missing)), F.sum(missing)), F.lit(0.0)).alias("score"), F.sum(missing).alias("missing"))


def exact_quantiles(df: DataFrame, value: str, quantiles: list[float], margin: float = 0.002) -> list[float | None]:
    """Exact quantiles with linear interpolation over all rows, without one task that holds all values.

    Approximate quantiles give a narrow band around each; the values below it are counted, and the exact aggregate sees the band only.
    """
    v = F.col(value).cast("double")
    known = df.select(v.alias("_v")).where("_v is not null")
    ends = [x for q in quantiles for x in (max(0.0, q - margin), min(1.0, q + margin))]
    n, cuts = known.agg(F.count("*"), F.percentile_approx("_v", ends, 20_000)).first()
    if not n:
        return [None] * len(quantiles)
    bands = [(cuts[2 * k] if q > margin else -math.inf, cuts[2 * k + 1] if q < 1 - margin else math.inf) for k, q in enumerate(quantiles)]
    inside = lambda lo, hi: (F.col("_v") >= lo) & (F.col("_v") <= hi)
    counts = known.agg(*[x for lo, hi in bands for x in (F.count_if(F.col("_v") < lo), F.count_if(inside(lo, hi)))]).first()
    wanted = []
    for k, (q, (lo, hi)) in enumerate(zip(quantiles, bands, strict=True)):
        below, m = counts[2 * k], counts[2 * k + 1]
        place = q * (n - 1) - below
        if 0 <= place <= m - 1:
            wanted.append(F.percentile(F.when(inside(lo, hi), F.col("_v")), F.lit(place / (m - 1) if m > 1 else 0.0)))
        else:
            wanted.append(F.percentile("_v", F.lit(q)))
    return list(known.agg(*wanted).first())


def quartile_fence(df: DataFrame, value: str, k: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Quartiles and the bounds k quartile distances beyond them."""
    if by:
        got = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    else:
        got = df.sparkSession.createDataFrame([(exact_quantiles(df, value, [0.25, 0.75]),)], "_q array<double>")
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return got.select(*by, q1.alias("q1"), q3.alias("q3"), (q1 - k * (q3 - q1)).alias("low"), (q3 + k * (q3 - q1)).alias("high"))


def fence_clipped(df: DataFrame, value: str, k: float = 2.0) -> DataFrame:
    """Values clipped to the fence; the one row of bounds is broadcast."""
    bounds = quartile_fence(df, value, k).select("low", "high")
    x = F.col(value)
    return df.crossJoin(F.broadcast(bounds)).withColumn(value, F.when(x.isNotNull(), F.least(F.greatest(x, "low"), "high"))).drop("low", "high")


def within_sigmas(df: DataFrame, value: str, sigmas: float = 3.0) -> DataFrame:
    """Rows whose value lies within so many sample deviations of the mean; the one row of moments is broadcast."""
    moments = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.crossJoin(F.broadcast(moments)).where(F.abs(F.col(value) - F.col("_m")) <= sigmas * F.col("_s")).drop("_m", "_s")


def correlations(df: DataFrame, columns: list[str], against: str) -> DataFrame:
    """Pearson correlation of each column with one, a row each."""
    got = df.agg(*[F.corr(F.col(c).cast("double"), F.col(against).cast("double")).alias(c) for c in columns])
    return got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in columns])).alias("_r")).select("_r.*")


def pivot_mean(df: DataFrame, rows: str, columns: str, value: str, values: list) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(value))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts of equal bins between the smallest and the largest value, which belongs to the last one."""
    known = df.where(F.col(value).isNotNull())
    ends = known.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0))).cast("int")
    return known.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def shares(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each row's part of the total; the one row of the total is broadcast."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def drawn_categories(frequency: DataFrame, value: str, share: str, points: DataFrame, u: str) -> DataFrame:
    """For each point u in [0, 1) the category in whose part of the cumulative shares it falls. frequency: one row a category, few."""
    upto = frequency.withColumn("_hi", F.sum(share).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    upto = upto.withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy(value)), F.lit(0.0)))
    last = F.row_number().over(Window.orderBy(F.desc(value))) == 1
    upto = upto.withColumn("_hi", F.when(last, float("inf")).otherwise(F.col("_hi"))).select(value, "_lo", "_hi")
    return points.join(F.broadcast(upto), (F.col(u) >= F.col("_lo")) & (F.col(u) < F.col("_hi"))).drop("_lo", "_hi")


def request_rates(samples: DataFrame, by: tuple[str, ...], ts: str, count: str, id_: str, last: int = 5) -> DataFrame:
    """Events a minute since the sample before, and their mean over the last samples."""
    order = Window.partitionBy(*by).orderBy(ts, id_)
    seconds = elapsed_seconds(F.lag(ts).over(order), F.col(ts))
    rate = F.try_divide((F.col(count) - F.lag(count).over(order)) * 60.0, seconds)
    got = samples.withColumn("rate", rate)
    return got.withColumn("mean_rate", F.avg("rate").over(order.rowsBetween(1 - last, 0)))


def running_tracker(df: DataFrame, values: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Smallest, largest, sum, count and mean over all finite values of arrays: folded per row first, then combined."""
    clean = F.filter(values, lambda x: finite(x).isNotNull())
    rows = df.withColumn("_v", clean).select(*by, F.array_min("_v").alias("_lo"), F.array_max("_v").alias("_hi"), F.aggregate("_v", F.lit(0.0), lambda s, x: s + x).alias("_s"), F.size("_v").alias("_n"))
    got = rows.groupBy(*by).agg(F.min("_lo").alias("min"), F.max("_hi").alias("max"), F.sum("_s").alias("sum"), F.sum("_n").alias("count"))
    return got.withColumn("mean", F.try_divide("sum", "count"))
