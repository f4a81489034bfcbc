"""Factor analysis of mixed data, parallel analysis and the index made from the components.

The Gram matrix of the coded columns is summed batch by batch in each task and then over the tasks; what reaches the driver is a few matrices, whose
size the number of coded columns bounds. All levels are coded; more columns than a matrix can hold are an error. Scores are a projection expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.numbers import asset_score, weighted_components
from gridloom.operators.stats import correlations, fence_clipped
from gridloom.operators.survey import value_counts


@dataclass(frozen=True)
class Factors:
    """Coded columns (names), their expressions' parameters, eigenvalues and axes (a column each)."""

    numeric: tuple[tuple[str, float, float], ...]
    levels: tuple[tuple[str, str, float], ...]
    eigenvalues: np.ndarray
    axes: np.ndarray

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.numeric] + [f"{c}={v}" for c, v, _ in self.levels]

    def coded(self) -> Column:
        """Standardized numbers; indicators over the root of their share, centred. A null counts as the mean."""
        parts = [F.coalesce((F.col(n).cast("double") - m) / (s or 1.0), F.lit(0.0)) for n, m, s in self.numeric]
        parts += [(F.col(c).cast("string").eqNullSafe(F.lit(v)).cast("double") - p) / p**0.5 for c, v, p in self.levels]
        return F.array(*parts)

    def scores(self, df: DataFrame, components: list[int], name: str = "components") -> DataFrame:
        """Adds an array of the chosen components."""
        axes = [F.array(*[F.lit(float(x)) for x in self.axes[:, k]]) for k in components]
        coded = df.withColumn("_coded", self.coded())
        dot = lambda a: F.aggregate(F.zip_with("_coded", a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return coded.withColumn(name, F.array(*[dot(a) for a in axes])).drop("_coded")

    def contributions(self) -> np.ndarray:
        """Part of each coded column in each component; every component's parts sum to 1."""
        squared = self.axes**2
        return squared / squared.sum(0, keepdims=True)


def gram(z: DataFrame, p: int, parts: int = 16) -> tuple[int, np.ndarray]:
    """Rows, and the sum of the outer products of z, an array of p numbers: one matrix a task, then one for each of a few parts."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros((p, p))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["z"].to_numpy())
                n, total = n + len(x), total + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "g": [total.ravel()]})

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(p * p)
        for pdf in batches:
            for k, g in zip(pdf["n"], pdf["g"], strict=True):
                n, total = n + k, total + g
        if n:
            yield pd.DataFrame({"n": [n], "g": [total]})

    schema = "n bigint, g array<double>"
    found = z.select("z").mapInPandas(products, schema).repartition(parts).mapInPandas(sums, schema).collect()
    return sum(r["n"] for r in found), sum((np.array(r["g"]) for r in found), np.zeros(p * p)).reshape(p, p)


def fit(df: DataFrame, numeric: list[str], categorical: list[str], most_columns: int = 20_000) -> Factors:
    moments = df.agg(F.count("*"), *[x for n in numeric for x in (F.avg(F.col(n).cast("double")), F.stddev_pop(F.col(n).cast("double")))]).first()
    total = moments[0]
    numbers = tuple((n, moments[2 * i + 1] or 0.0, moments[2 * i + 2] or 0.0) for i, n in enumerate(numeric))
    counts = value_counts(df, categorical).where("value is not null").limit(most_columns + 1).collect() if categorical else []
    if len(numeric) + len(counts) > most_columns:
        raise ValueError(f"more than {most_columns} columns and levels; the matrix of their products would not fit")
    place = {c: i for i, c in enumerate(categorical)}
    levels = sorted(((r["column"], r["value"], r["n"] / total) for r in counts), key=lambda x: (place[x[0]], x[1]))
    bare = Factors(numbers, tuple(levels), np.zeros(0), np.zeros((0, 0)))
    n, products = gram(df.select(bare.coded().alias("z")), len(bare.names))
    values, axes = np.linalg.eigh(products / max(1, n))
    order = np.argsort(-values)
    return Factors(numbers, tuple(levels), np.maximum(values[order], 0), axes[:, order])


def parallel_analysis(spark: SparkSession, factors: Factors, rows: int, simulations: int = 1000, quantile: float = 95.0, seed: int = 42, partitions: int = 64, block: int = 50_000) -> list[int]:
    """Components whose eigenvalue is above that quantile of those of unrelated columns; not forced to be the first ones.

    Every simulation draws as many rows of normal numbers and categories by their shares, in tasks of their own; sums are kept block by block of rows.
    Eigenvalues are collected, simulations * columns of them.
    """
    if not rows:
        return []
    groups: dict[str, list[float]] = {}
    for c, _, p in factors.levels:
        groups.setdefault(c, []).append(p)
    n_numeric, size = len(factors.numeric), len(factors.names)

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                total, gram = np.zeros(size), np.zeros((size, size))
                for start in range(0, rows, block):
                    n = min(block, rows - start)
                    x = [rng.standard_normal((n, n_numeric))]
                    for shares in groups.values():
                        p = np.array([*shares, max(0.0, 1 - sum(shares))])
                        one = np.eye(len(p))[rng.choice(len(p), n, p=p / p.sum())][:, : len(shares)]
                        x.append((one - p[: len(shares)]) / np.sqrt(p[: len(shares)]))
                    z = np.hstack(x)
                    total += z.sum(0)
                    gram += z.T @ z
                cov = gram / rows - np.outer(total, total) / rows**2
                scale = np.where(np.arange(size) < n_numeric, np.sqrt(np.maximum(np.diag(cov), 1e-24)), 1.0)
                out.append(np.sort(np.linalg.eigvalsh(cov / np.outer(scale, scale)))[::-1].tolist())
            yield pd.DataFrame({"values": out})

    drawn = spark.range(0, simulations, 1, partitions).mapInPandas(simulate, "values array<double>")
    cut = drawn.agg(*[F.percentile(F.col("values")[k], F.lit(quantile / 100)) for k in range(size)]).first()
    return [k for k in range(size) if factors.eigenvalues[k] > cut[k]]


def index(df: DataFrame, factors: Factors, components: list[int], flags: list[str], k: float = 2.0, name: str = "wealth_index") -> DataFrame:
    """Components weighted by their correlation with the number of assets, clipped to the quartile fence and scaled to 0 .. 1."""
    scored = factors.scores(df, components).withColumn("_assets", asset_score(*[F.col(f) for f in flags]))
    names = [f"_c{i}" for i in range(len(components))]
    wide = scored.select("*", *[F.col("components")[i].alias(n) for i, n in enumerate(names)])
    r = {x["column"]: x["r"] or 0.0 for x in correlations(wide, names, "_assets").collect()}
    weights = F.array(*[F.lit(float(r[n])) for n in names])
    raw = wide.withColumn(name, F.coalesce(weighted_components(F.col("components"), weights), F.lit(0.0))).drop(*names, "_assets", "components")
    cut = fence_clipped(raw, name, k)
    ends = cut.agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(name) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return cut.crossJoin(F.broadcast(ends)).withColumn(name, scaled).drop("_lo", "_hi")
