"""Survey tables: profiles, types, cleaning, fill values and weighted means.

Every statistic of a column comes from one table of value counts (column, value, n), which is combined before it is shuffled, so a
profile of any number of columns is one pass over the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numbers import finite, safe_number
from gridloom.functions.text import null_texts


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of w * x over sum of w; null if no weight is there."""
    return F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def cluster_means(households: DataFrame, cluster: str, weight: str, value: str, *constant: str) -> DataFrame:
    """Weighted mean and total weight of each cluster; columns that are constant within a cluster come along."""
    return households.groupBy(cluster).agg(
        F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("wealth_index"), F.sum(weight).alias("weight"), *[F.min(c).alias(c) for c in constant]
    )


def value_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """How often each value of each column occurs, as text, nulls included."""
    by = by or []
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(*by, pairs.alias("_p")).groupBy(*by, F.col("_p.column").alias("column"), F.col("_p.value").alias("value")).agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, share of nulls, distinct values, whether constant with nulls, and its type by both rules.

    type_by_values: numeric if all values are numbers and either all whole or more than half of them distinct.
    type_by_parsing: numeric if all values are finite numbers; a column without values is numeric.
    """
    by = by or []
    v = F.col("value")
    number = safe_number(v)
    known = v.isNotNull()
    counts = value_counts(df, columns, by).groupBy(*by, "column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("nulls"),
        F.count(v).alias("distinct_values"),
        F.count_distinct(number).alias("distinct_numbers"),
        F.coalesce(F.bool_and(F.when(known, number.isNotNull())), F.lit(True)).alias("all_numbers"),
        F.coalesce(F.bool_and(F.when(known, number == F.floor(number))), F.lit(True)).alias("all_whole"),
        F.coalesce(F.bool_and(F.when(known, finite(number).isNotNull())), F.lit(True)).alias("all_finite"),
    )
    filled = F.col("rows") - F.col("nulls")
    varied = F.try_divide(F.col("distinct_numbers"), filled) > 0.5
    return counts.select(
        *by, "column", "rows", "nulls", (F.col("nulls") / F.col("rows")).alias("null_share"), "distinct_values",
        ((F.col("distinct_values") == 1) & (F.col("nulls") > 0)).alias("constant_with_nulls"),
        F.when(F.col("all_numbers") & (F.col("all_whole") | F.coalesce(varied, F.lit(False))) & (filled > 0), "numeric").otherwise("categorical").alias("type_by_values"),
        F.when(F.col("all_numbers") & F.col("all_finite"), "numeric").otherwise("categorical").alias("type_by_parsing"),
    )


def dense_columns(df: DataFrame, columns: list[str], threshold: float = 0.5) -> list[str]:
    """Columns whose share of nulls isn't above the threshold and that aren't all null; one small job decides."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if shares[c] is not None and shares[c] <= threshold and shares[c] < 1]


def without_sparse_columns(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    gone = set(columns) - set(dense_columns(df, columns, threshold))
    return df.drop(*gone)


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among those that aren't null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_total")).alias("share"))


def mode_of(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row: the most frequent value, the smallest of ties; null without values. Counts are combined before the shuffle, and no task holds all values."""
    counts = df.select(value.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n"))
    return counts.agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias(name))


def smallest_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent value of each column, the smallest of ties; null for a column without values."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [mode_of(df, F.col(c), c) for c in columns])


def fill_values(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Means and modes to fill nulls with, a row of them: one pass for the means, one for each mode."""
    means = [df.agg(*[F.avg(c).alias(c) for c in numeric])] if numeric else []
    modes = [smallest_mode(df, categorical).select(*[F.coalesce(c, F.lit("missing")).alias(c) for c in categorical])] if categorical else []
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), means + modes)


def filled(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Nulls replaced by means and modes; the one row of fill values is broadcast."""
    if not numeric and not categorical:
        return df
    values = fill_values(df, numeric, categorical).select(*[F.col(c).alias(f"_fill_{c}") for c in numeric + categorical])
    both = df.crossJoin(F.broadcast(values))
    return both.select(*[F.coalesce(c, f"_fill_{c}").alias(c) if c in numeric + categorical else F.col(c) for c in df.columns])


def cleaned(df: DataFrame, columns: list[str], codes: dict[str, dict[str, str]] | None = None, numeric_labels: bool = False) -> DataFrame:
    """Texts that mean unknown become null, codes become their labels."""
    from gridloom.functions.text import mapped, numeric_texts

    out = {}
    for c in columns:
        x = null_texts(F.col(c))
        if numeric_labels:
            x = numeric_texts(x)
        out[c] = mapped(x, codes[c]) if codes and c in codes else x
    return df.withColumns(out)


def survey_rows(df: DataFrame, iso2: str, year: int, country: str = "hv000", year_column: str = "hv007") -> DataFrame:
    return df.where((F.substring(country, 1, 2) == iso2) & (F.col(year_column).cast("int") == year))
