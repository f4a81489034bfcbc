"""Missing values: candidate settings, hidden validation values, imputers and their comparison.

A method is anything with ``candidates``, ``complexity`` and ``impute``; METHODS registers them by name. Rows carry ``row_id``, so that results
are joined and never put together by position.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import numbers
from gridloom.operators.survey import filled, mode_of


def hidden_rows(df: DataFrame, column: str, row_id: str = "row_id", share: float = 0.1, order: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (row_id, actual) of a share of the values that are there, one at least, by a seeded order.

    The share is cut by a threshold on a hash when no order is given, so nothing is sorted as a whole; with an order it is exact.
    """
    known = df.where(F.col(column).isNotNull())
    if order is None:
        h = F.xxhash64(row_id, F.lit(column), F.lit(42))
        marked = known.withColumn("_h", h)
        least = F.broadcast(marked.groupBy(*by).agg(F.min("_h").alias("_least")))
        joined = marked.join(least, list(by)) if by else marked.crossJoin(least)
        return joined.where((F.pmod("_h", F.lit(1 << 40)) < int(share * (1 << 40))) | (F.col("_h") == F.col("_least"))).select(*by, row_id, F.col(column).alias("actual"))
    n = known.groupBy(*by).agg(F.greatest(F.floor(F.count("*") * share), F.lit(1)).alias("_k"))
    ranked = known.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order, row_id)))
    joined = ranked.join(F.broadcast(n), list(by)) if by else ranked.crossJoin(F.broadcast(n))
    return joined.where("_r <= _k").select(*by, row_id, F.col(column).alias("actual"))


def stable_split(df: DataFrame, key: str, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Marks a share of the keys as test rows; the same keys whatever the partitions."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < test_percent)


def stratified_sample(df: DataFrame, label: str, key: str, most: int = 1000) -> DataFrame:
    """At most so many rows in all, each class in its proportion, by a hash of the key. Counts are combined before the shuffle."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_quota", F.least(F.col("_n"), F.greatest(F.lit(1), F.floor(most * F.col("_n") / F.sum("_n").over(Window.partitionBy())))))
    joined = df.join(F.broadcast(sizes), label)
    likely = joined.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < F.least(F.lit(1.0), 2.0 * F.col("_quota") / F.col("_n") + 50.0 / F.col("_n")) * (1 << 30))
    return likely.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(7)), key))).where("_r <= _quota").drop("_r", "_n", "_quota")


def _odd(k: int) -> int:
    return k if k % 2 else k + 1


def neighbour_counts(n: int, missing: float) -> list[int]:
    """Numbers of neighbours to try: small ones, some around the root of n, and a larger one for large n. missing in per cent."""
    centre = _odd(min(31, max(3, math.isqrt(n))))
    spread = max(3, int(centre * (0.7 if missing > 30 else 0.4 if missing < 10 else 0.5)))
    around = {_odd(max(3, centre - spread)), _odd(centre), _odd(min(centre + spread, n // 3))}
    large = {_odd(min(int(1.5 * centre), n // 3))} if n > 1000 else set()
    return sorted(around | large | set(range(3, min(9, centre), 2)))


def _grid(**lists: list) -> list[dict]:
    return [dict(zip(lists, values, strict=True)) for values in product(*lists.values())]


def _thinned(options: list[dict], most: int) -> list[dict]:
    """Evenly spread members of a list, the first and the last among them."""
    return options if len(options) <= most else [options[round(i * (len(options) - 1) / (most - 1))] for i in range(most)]


class Imputer(Protocol):
    """A method: settings to try, how costly each is (0 to 1), and values for rows from rows."""

    def candidates(self, n: int, kind: str, missing: float) -> list[dict]: ...

    def complexity(self) -> Column: ...

    def impute(self, known: np.ndarray, target: np.ndarray, wanted: np.ndarray, kind: str, settings: dict) -> np.ndarray: ...


def _boxes(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of rows near each other, at most so many in each: halves of halves along the widest column."""
    done, left = [], [np.arange(len(x))]
    while left:
        rows = left.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        column = x[rows, np.ptp(x[rows], axis=0).argmax()] if x.shape[1] else np.zeros(len(rows))
        by = np.argpartition(column, len(rows) // 2)
        left += [rows[by[: len(rows) // 2]], rows[by[len(rows) // 2 :]]]
    return done


class NearestNeighbours:
    """Values of the nearest rows: their mean, or the most frequent of them."""

    def candidates(self, n: int, kind: str, missing: float) -> list[dict]:
        size = (n > 1000) + (n > 10000)
        metrics = ["hamming"] if kind != "numeric" else ["euclidean", "manhattan", "minkowski", "chebyshev"] if missing > 30 else ["euclidean", "manhattan"]
        algorithms = ["auto", "ball_tree"] if kind != "numeric" else [["auto"], ["auto", "kd_tree"], ["auto", "ball_tree", "kd_tree"]][size]
        leaves = [[10, 30], [20, 30], [30, 50]][size]
        found = [o | {"p": p} for o in _grid(n_neighbors=neighbour_counts(n, missing), metric=metrics, weights=["uniform", "distance"], algorithm=algorithms, leaf_size=leaves) for p in ([1, 2] if o["metric"] == "minkowski" else [None])]
        return _thinned(found, 30 if missing > 20 else 24)

    def complexity(self) -> Column:
        return numbers.neighbour_complexity(F.col("n_neighbors"), F.col("metric"), F.col("algorithm"), F.col("weights"), F.col("leaf_size"))

    def distances(self, gap: np.ndarray, settings: dict) -> np.ndarray:
        """Of absolute differences, the columns in the last axis."""
        metric, p = settings.get("metric", "euclidean"), settings.get("p") or 2
        return {"euclidean": lambda: np.sqrt((gap**2).sum(-1)), "manhattan": lambda: gap.sum(-1), "chebyshev": lambda: gap.max(-1, initial=0), "minkowski": lambda: (gap**p).sum(-1) ** (1 / p), "hamming": lambda: (gap > 0).mean(-1) if gap.shape[-1] else gap.sum(-1)}[metric]()

    def nearest(self, known: np.ndarray, wanted: np.ndarray, settings: dict) -> tuple[np.ndarray, np.ndarray]:
        """Distances and positions of the nearest known rows of each wanted one, the nearest first; of equal ones the earlier.

        Both sides are cut into boxes of neighbouring rows. A box of wanted rows looks into boxes of known ones from the nearest on, until the next is further
        away than the last neighbour of each; so nothing is left out. Values that aren't finite have no such bounds, and every box is looked into.
        """
        k = min(settings.get("n_neighbors", 5), len(known))
        d, near = np.full((len(wanted), k), np.inf), np.full((len(wanted), k), len(known))
        if not k or not len(wanted):
            return d, near
        bounded = np.isfinite(known).all() and np.isfinite(wanted).all()
        boxes = _boxes(known, 64)
        low, high = np.array([known[b].min(0) for b in boxes]), np.array([known[b].max(0) for b in boxes])
        for rows in _boxes(wanted, max(1, min(64, 2_000_000 // (256 * max(1, known.shape[1]))))):
            x, best, at = wanted[rows], d[rows], near[rows]
            least = self.distances(np.maximum(0, np.maximum(low - x.max(0), x.min(0) - high)), settings) * (1 - 1e-9) if bounded else np.zeros(len(boxes))
            order, i, step = np.argsort(least, kind="stable"), 0, 1
            while i < len(order) and not least[order[i]] > best[:, -1].max():
                ids = np.concatenate([boxes[b] for b in order[i : i + step] if not least[b] > best[:, -1].max()])
                found = self.distances(np.abs(x[:, None, :] - known[ids]), settings)
                close = ~(found > best[:, -1:]).all(0)
                both, where = np.hstack([best, found[:, close]]), np.hstack([at, np.broadcast_to(ids[close], (len(rows), int(close.sum())))])
                first = np.lexsort((where, both) if bounded else (where, both, where == len(known)), axis=1)[:, :k]
                best, at = np.take_along_axis(both, first, 1), np.take_along_axis(where, first, 1)
                i, step = i + step, min(4, 2 * step)
            d[rows], near[rows] = best, at
        return d, near

    def combined(self, d: np.ndarray, values: np.ndarray, kind: str, settings: dict) -> np.ndarray:
        """Means or most frequent values of neighbours, a row of them for each result."""
        if settings.get("weights") == "distance":
            exact = d == 0
            w = np.where(exact.any(1, keepdims=True), exact, 1 / np.where(exact, 1, d)).astype(float)
        else:
            w = np.ones(d.shape)
        if kind == "numeric":
            return (values.astype(float) * w).sum(1) / w.sum(1)
        out = np.empty(len(values), object)
        out[:] = [min({v: -wi[vi == v].sum() for v in vi}.items(), key=lambda e: (e[1], e[0]))[0] for vi, wi in zip(values, w, strict=True)]
        return out

    def impute(self, known, target, wanted, kind, settings):
        d, near = self.nearest(known, wanted, settings)
        return self.combined(d, target[near], kind, settings)


class ChainedEquations:
    """A regression of the column on the others: linear or Bayesian ridge for numbers, logistic for categories.

    Predictors don't change between iterations, so one fit gives the same values as any number of them.
    """

    _VARIANTS = {
        "numeric": [{"method": "bayesian_ridge"}, {"method": "linear"}, {"method": "linear", "extra": 0.05}],
        "categorical": [{"method": "logistic"}, {"method": "logistic", "extra": 0.05}],
    }
    _MORE = {"numeric": [{"method": "bayesian_ridge", "extra": 0.05}], "categorical": [{"method": "logistic", "extra": 0.1}]}

    def candidates(self, n: int, kind: str, missing: float) -> list[dict]:
        imputations = [5, 7, 9, 11] if missing >= 50 else [3, 5, 7, 9][: 2 + (missing >= 10) + (missing >= 30)]
        iterations = [5, 10, 15, 20] if n < 1000 and missing > 30 else [5, 10, 15]
        variants = self._VARIANTS[kind] + (self._MORE[kind] if missing > 30 else [])
        return [{"n_iter": i, "n_impute": m, "extra": 0.0} | v for i, m, v in product(iterations, imputations, variants)]

    def complexity(self) -> Column:
        return numbers.chained_complexity(F.col("method"), F.col("n_iter"), F.col("n_impute"), F.col("extra"))

    def moments(self, x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Number, means and centred products of the predictors and, last, the column."""
        z = np.column_stack([x, y.astype(float)])
        return len(z), z.mean(0), (z - z.mean(0)).T @ (z - z.mean(0))

    def summed(self, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        """The moments of all rows from those of disjoint parts."""
        n = sum(k for k, _, _ in parts)
        mean = sum(k * m for k, m, _ in parts) / n
        return n, mean, sum(g + k * np.outer(m - mean, m - mean) for k, m, g in parts)

    def coefficients(self, n: int, mean: np.ndarray, gram: np.ndarray, settings: dict) -> np.ndarray:
        """Factors of the predictors and, last, the constant."""
        spread, p = np.diag(gram)[:-1] / n, len(mean) - 1
        scale = np.sqrt(np.where(spread > 1e-24 * np.maximum(1e-300, mean[:-1] ** 2), spread, 1))
        xx, xy = gram[:-1, :-1] / np.outer(scale, scale), gram[:-1, -1] / scale
        penalty = 1e-9
        if settings.get("method") == "bayesian_ridge":
            whole = np.zeros((p + 1, p + 1))
            whole[0, 0], whole[1:, 1:] = n, xx
            penalty = _evidence_ridge(whole, np.array([n * mean[-1], *xy]), gram[-1, -1] + n * mean[-1] ** 2, n, gram[-1, -1] / n)
        b = np.linalg.solve(xx + (penalty + 1e-12) * np.eye(p), xy) / scale
        return np.array([*b, mean[-1] - b @ mean[:-1]])

    def impute(self, known, target, wanted, kind, settings):
        if kind == "numeric":
            b = self.coefficients(*self.moments(known, target), settings)
            return wanted @ b[:-1] + b[-1]
        mean, scale = known.mean(0), known.std(0)
        scale = np.where(scale > 0, scale, 1)
        design = lambda x: np.column_stack([np.ones(len(x)), (x - mean) / scale])
        x = design(known)
        labels, y = np.unique(target.astype(str), return_inverse=True)
        weights = np.zeros((x.shape[1], len(labels)))
        onehot = np.eye(len(labels))[y]
        rate = 4.0 / max(1e-9, np.linalg.norm(x, 2) ** 2)
        for _ in range(200):
            p = np.exp(x @ weights - (x @ weights).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weights -= rate * (x.T @ (p - onehot) + 1e-3 * weights)
        return labels[(design(wanted) @ weights).argmax(1)].astype(object)


def _evidence_ridge(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, variance: float) -> float:
    """The penalty (noise precision over weight precision inverted) that maximizes the evidence of a ridge regression, from its sums of products."""
    values, vectors = np.linalg.eigh(xx)
    projected = vectors.T @ xy
    alpha, lam = 1 / max(variance, 1e-12), 1.0
    for _ in range(100):
        coefficients = projected / (values + lam / alpha)
        residual = max(0.0, float(yy - 2 * coefficients @ projected + coefficients**2 @ values))
        gamma = float((alpha * values / (lam + alpha * values)).sum())
        new = (max(1e-12, n - gamma) / max(residual, 1e-12), gamma / max(float(coefficients @ coefficients), 1e-12))
        if abs(new[0] - alpha) < 1e-8 * alpha and abs(new[1] - lam) < 1e-8 * lam:
            break
        alpha, lam = new
    return lam / alpha


class Forest:
    """Randomized regression trees on the other columns, averaged; votes for categories. Predictors are fixed, so one round suffices."""

    def candidates(self, n: int, kind: str, missing: float) -> list[dict]:
        rounds = [3, 5] if missing < 10 else [3, 5, 7] if missing < 30 else [5, 7, 10]
        trees = [50, 100] if n < 1000 else [100, 200]
        depths = [None] if n < 1000 and missing < 20 else [20, None] if n < 5000 else [30, None]
        return _grid(n_iterations=rounds, n_estimators=trees, max_features=["sqrt", "log2", None], max_depth=depths, min_samples_split=[5 if n > 5000 else 2])

    def complexity(self) -> Column:
        return numbers.forest_complexity(F.col("n_estimators"), F.col("n_iterations"), F.col("max_depth"), F.col("max_features"), F.col("min_samples_split"))

    #: Trees that one task grows.
    chunk = 10

    def trees(self, settings: dict) -> int:
        return settings.get("n_estimators", 100)

    def votes(self, known: np.ndarray, y: np.ndarray, weight: np.ndarray, wanted: np.ndarray, settings: dict, numbers: range) -> np.ndarray:
        """The sum of some trees' means of y for each wanted row; weight tells how often a known row is there. Each tree has a seed of its own."""
        total, votes = int(weight.sum()), np.zeros((len(wanted), y.shape[1]))
        features = {"sqrt": math.isqrt(max(1, known.shape[1])), "log2": int(math.log2(max(2, known.shape[1])))}.get(settings.get("max_features"), known.shape[1])
        centre, copies = weight @ y / total, np.repeat(np.arange(len(known)), weight)
        for t in numbers:
            rng = np.random.default_rng([settings.get("seed", 42), t])
            drawn = np.bincount(copies[rng.integers(0, total, total)], minlength=len(known))
            rows = np.flatnonzero(drawn)
            self._grow(known[rows], y[rows] - centre, wanted, votes, rng, max(1, features), settings.get("max_depth"), settings.get("min_samples_split", 2), drawn[rows])
        return votes + len(numbers) * centre

    def impute(self, known, target, wanted, kind, settings):
        if kind == "numeric":
            labels, y = None, target.astype(float)[:, None]
        else:
            labels, codes = np.unique(target.astype(str), return_inverse=True)
            y = np.eye(len(labels))[codes]
        votes = self.votes(known, y, np.ones(len(known), int), wanted, settings, range(self.trees(settings))) / self.trees(settings)
        return votes[:, 0] if labels is None else labels[votes.argmax(1)].astype(object)

    def _grow(self, x, y, wanted, votes, rng, features, depth, least, weight=None) -> None:
        """Grows a tree level by level, all nodes of a level at once, over every cut point, and adds the means of their leaves to the votes of wanted rows.

        Of each node the best cut of ``features`` random columns is taken; if these are constant in it, the next column that is not. Columns of two values
        are counted through the rows of their rarer one, the others in their order.
        """
        weight = np.ones(len(x)) if weight is None else weight.astype(float)
        node, place, asked, level = np.zeros(len(x), int), np.zeros(len(wanted), int), np.arange(len(wanted)), 0
        low, high = x.min(0, initial=np.inf), x.max(0, initial=-np.inf)
        upper = x == high
        two = ((x == low) | upper).all(0) & (low < high)
        rare_high = 2 * upper.sum(0) <= len(x)
        middle = (low + high) / 2
        middle = np.where(middle < high, middle, low)
        column = np.flatnonzero(two)
        row, bit = np.nonzero((upper == rare_high)[:, column])
        order = {f: np.argsort(x[:, f], kind="stable") for f in np.flatnonzero(~two & ~(low == high))}
        while len(asked):
            nodes = int(node.max(initial=-1)) + 1
            by = np.argsort(node, kind="stable")
            starts = np.searchsorted(node[by], np.arange(nodes))
            size, sum_y = np.bincount(node, weight, nodes), y * weight[:, None]
            total = np.add.reduceat(sum_y[by], starts)
            mixed = (np.maximum.reduceat(y[by], starts) > np.minimum.reduceat(y[by], starts)).any(1)
            grows = mixed & (size >= max(2, least)) & (np.bincount(place, minlength=nodes) > 0) & (depth is None or level < depth)
            gains, cuts = np.full((nodes, x.shape[1] + 1), -np.inf), np.zeros((nodes, x.shape[1] + 1))
            if len(column) and grows.any():
                cell, cells = node[row] * len(column) + bit, nodes * len(column)
                n = np.bincount(cell, weight[row], cells).reshape(nodes, -1)
                able = (n > 0) & (n < size[:, None]) & grows[:, None]
                i, j = np.nonzero(able)
                n, gain = n[i, j], np.zeros(len(i))
                for c in range(y.shape[1]):
                    part = np.bincount(cell, sum_y[row, c], cells).reshape(nodes, -1)[i, j]
                    gain += part**2 / n + (total[i, c] - part) ** 2 / (size[i] - n)
                gains[i, column[j]], cuts[i, column[j]] = gain, middle[column[j]]
            for f, o in order.items() if grows.any() else ():
                o = o[np.argsort(node[o], kind="stable")]
                v, at = x[o, f], node[o]
                i = np.flatnonzero((at[1:] == at[:-1]) & (v[1:] > v[:-1]) & grows[at[:-1]])
                if not len(i):
                    continue
                sums, counts, at = np.vstack([np.zeros(y.shape[1]), np.cumsum(sum_y[o], 0)]), np.cumsum(weight[o]), at[i]
                before = starts[at]
                left, n = sums[i + 1] - sums[before], counts[i] - counts[before] + weight[o[before]]
                gain = (left**2).sum(1) / n + ((total[at] - left) ** 2).sum(1) / (size[at] - n)
                which, first, back = np.unique(at, return_index=True, return_inverse=True)
                most = np.maximum.reduceat(gain, first)
                best = np.flatnonzero(gain == most[back])
                best = i[best[np.unique(at[best], return_index=True)[1]]]
                half = (v[best] + v[best + 1]) / 2
                gains[which, f], cuts[which, f] = most, np.where(half < v[best + 1], half, v[best])
            if features < x.shape[1]:
                rank = rng.random((nodes, x.shape[1]))
                enough = np.partition(rank, features - 1, axis=1)[:, features - 1]
                gains[:, :-1][rank > np.maximum(enough, np.where(gains[:, :-1] > -np.inf, rank, 2).min(1))[:, None]] = -np.inf
            chosen = gains.argmax(1)
            splits = gains.max(1) > -np.inf
            ends = ~splits[place]
            votes[asked[ends]] += (total / size[:, None])[place[ends]]
            asked, place, keep = asked[~ends], place[~ends], splits[node]
            moved = np.cumsum(keep) - 1
            order = {f: moved[o[keep[o]]] for f, o in order.items()}
            row, bit = moved[row[keep[row]]], bit[keep[row]]
            x, y, node, weight = x[keep], y[keep], node[keep], weight[keep]
            number, cut = np.cumsum(splits) - 1, cuts[np.arange(nodes), chosen]
            node = 2 * number[node] + (x[np.arange(len(x)), chosen[node]] > cut[node])
            place = 2 * number[place] + (wanted[asked, chosen[place]] > cut[place])
            level += 1


METHODS: dict[str, Callable[[], Imputer]] = {"knn": NearestNeighbours, "mice": ChainedEquations, "missforest": Forest}


def method(name: str) -> Imputer:
    if name not in METHODS:
        raise ValueError(f"unknown imputation method {name!r}; there are {', '.join(METHODS)}")
    return METHODS[name]()


def candidate_table(spark: SparkSession, name: str, n: int, kind: str, missing: float) -> DataFrame:
    """The settings a method would try, one row each, with how costly they are."""
    chosen = method(name)
    rows = chosen.candidates(n, kind, missing)
    pdf = pd.DataFrame(rows).astype(object).where(lambda d: d.notna(), None)
    kinds = {c: "string" if any(isinstance(v, str) for v in pdf[c]) else "double" if any(isinstance(v, float) for v in pdf[c]) else "int" for c in pdf.columns}
    schema = "ord int, " + ", ".join(f"{c} {k}" for c, k in kinds.items())
    data = [(i, *[None if v is None else float(v) if kinds[c] == "double" else v for c, v in r.items()]) for i, r in enumerate(pdf.to_dict("records"))]
    return spark.createDataFrame(data, schema).withColumn("complexity", chosen.complexity())


def encoded(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[str]]:
    """Predictors as numbers: numeric columns as they are, categories as one column for each of their levels, the most frequent first; nulls filled before."""
    whole = filled(df, numeric, categorical)
    names, made = list(numeric), {}
    for c in categorical:
        levels = [r[0] for r in whole.groupBy(c).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), c).collect()]
        for i, v in enumerate(levels):
            made[f"{c}__{i}"] = F.col(c).eqNullSafe(F.lit(v)).cast("double")
            names.append(f"{c}__{i}")
    return whole.withColumns(made) if made else whole, names


def imputed(df: DataFrame, column: str, numeric: list[str], categorical: list[str], by: str, name: str = "knn", settings: dict | None = None, kind: str = "numeric", row_id: str = "row_id", part: int = 20_000, only: str | None = None) -> DataFrame:
    """row_id and value for each row of df in which the column is null, group by group, from all known rows of the group; with ``only``, for those of them that have it true.

    ``part`` bounds what a task holds and doesn't change results. Rows with equal predictors get equal values, so nearest neighbours are sought once for
    each different row of predictors: a block of about so many wanted ones is compared with each block of known ones, of which the first rows of each stay,
    and the nearest of all are kept. Regressions of numbers are fitted from moments that are summed over blocks. Trees of a forest are
    grown ten to a task from the different rows of a whole group and how often each is there; logistic regressions learn from a whole group in one task. A group without known rows takes the overall mean or mode. No predictors: all rows are equally near.
    """
    settings, chosen = settings or {}, method(name)
    out, id_type = "double" if kind == "numeric" else "string", dict(df.dtypes)[row_id]
    whole, names = encoded(df.withColumns({"_by": F.col(by), "_y": F.col(column).cast(out), "_only": F.col(only) if only else F.lit(True)}).drop(column), numeric, categorical)
    base = whole.select(row_id, "_by", "_y", "_only", F.array(*[F.col(c).cast("double") for c in names]).cast("array<double>").alias("_x"))
    base = base.where("_y is not null or _only").drop("_only")
    by_type = dict(base.dtypes)["_by"]
    blocks = lambda n: F.ceil(n / part).cast("int")
    sizes = base.groupBy("_by").agg(blocks(F.count("_y")).alias("_known"), blocks(F.count("*") - F.count("_y")).alias("_wanted"))
    rows = base.join(F.broadcast(sizes), "_by")
    default = (df.agg(F.avg(column)) if kind == "numeric" else mode_of(df, F.col(column).cast("string"), "d")).first()[0]
    alone = rows.where("_known = 0 and _y is null").select(row_id, F.lit(default).cast(out).alias("value"))
    rows = rows.where("_known > 0 and _wanted > 0")
    at = lambda n, key=row_id: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    matrix = lambda p: np.concatenate([np.zeros(0), *p["_x"]]).reshape(len(p), len(names))

    if isinstance(chosen, NearestNeighbours):
        k = settings.get("n_neighbors", 5)
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        kinds = rows.groupBy("_by").agg(*[F.greatest(F.lit(1), blocks(F.approx_count_distinct(F.when(F.col("_y").isNull() == null, F.col("_x"))))).alias(n) for n, null in (("_known", False), ("_wanted", True))])
        first = rows.where("_y is not null").withColumn("_r", F.row_number().over(Window.partitionBy("_by", "_x").orderBy(row_id))).where(F.col("_r") <= k)
        first = first.groupBy("_by", "_x").agg(F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("id"), F.col("_y").alias("y")))).alias("_rows"))
        known = first.join(F.broadcast(kinds), "_by").select("_by", "_x", F.explode(every("_wanted")).alias("_w"), at("_known", "_x").alias("_k"), F.col("_rows.id").alias("_id"), F.col("_rows.y").alias("_v"))
        wanted = rows.where("_y is null").select("_by", "_x").distinct().join(F.broadcast(kinds), "_by")
        wanted = wanted.select("_by", "_x", at("_wanted", "_x").alias("_w"), F.explode(every("_known")).alias("_k"))

        def near(pdf: pd.DataFrame) -> pd.DataFrame:
            known, wanted = pdf[pdf["_id"].notna()], pdf[pdf["_id"].isna()]
            if not len(known) or not len(wanted):
                return pd.DataFrame({"_by": [], "_x": [], "d": [], "id": [], "y": []})
            ids, values, many = np.concatenate(list(known["_id"])), np.concatenate(list(known["_v"])), known["_id"].map(len).to_numpy()
            place = np.empty(len(ids), int)
            place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            start = np.cumsum(many) - many
            turn = np.argsort(place[start])
            start, many = start[turn], many[turn]
            d, found = chosen.nearest(matrix(known)[turn], matrix(wanted), settings)
            rows, step = [(np.zeros((0, 0)), np.zeros((0, 0), int))], max(1, 1_000_000 // (found.shape[1] * many.max()))
            for a in range(0, len(wanted), step):
                f, j = found[a : a + step, :, None], np.arange(many.max())
                spare = np.broadcast_to(j >= many[f], (len(f), f.shape[1], len(j))).reshape(len(f), -1)
                flat, away = np.where(spare, 0, (start[f] + j).reshape(len(f), -1)), np.repeat(d[a : a + step], len(j), axis=1)
                order = np.lexsort((place[flat], away, spare), axis=1)[:, :k]
                left = (~np.take_along_axis(spare, order, 1)).sum(1)
                flat, away = np.take_along_axis(flat, order, 1), np.take_along_axis(away, order, 1)
                rows += [(away[i, :n], flat[i, :n]) for i, n in enumerate(left)]
            return pd.DataFrame({"_by": wanted["_by"].to_numpy(), "_x": wanted["_x"].to_numpy(), "d": [a for a, _ in rows[1:]], "id": [ids[b] for _, b in rows[1:]], "y": [values[b] for _, b in rows[1:]]})

        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = known.unionByName(wanted, allowMissingColumns=True).repartition(tasks, "_by", "_w", "_k").groupBy("_by", "_w", "_k").applyInPandas(near, f"_by {by_type}, _x array<double>, d array<double>, id array<{id_type}>, y array<{out}>")
        merged = pairs.groupBy("_by", "_x").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "id", "y")))), 1, k).alias("_n"))

        def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                value, count = np.empty(len(pdf), object), pdf["d"].map(len)
                for k in count.unique():
                    m = (count == k).to_numpy()
                    value[m] = chosen.combined(np.array(pdf["d"][m].tolist()), np.array(pdf["y"][m].tolist(), None if kind == "numeric" else object), kind, settings)
                yield pd.DataFrame({"_by": pdf["_by"], "_x": pdf["_x"], "value": value.astype(float) if kind == "numeric" else value})

        values = merged.select("_by", "_x", F.col("_n.d").alias("d"), F.col("_n.y").alias("y")).mapInPandas(voted, f"_by {by_type}, _x array<double>, value {out}")
        got = rows.where("_y is null").select(row_id, "_by", "_x").join(values, ["_by", "_x"]).select(row_id, "value")
    elif isinstance(chosen, ChainedEquations) and kind == "numeric":

        def moments(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(row_id)
            n, mean, gram = chosen.moments(matrix(pdf), pdf["_y"].to_numpy())
            return pd.DataFrame({"_by": pdf["_by"].iloc[:1].to_numpy(), "n": [n], "mean": [mean], "gram": [gram.ravel()]})

        def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = [(n, np.array(m), np.array(g).reshape(len(m), len(m))) for n, m, g in zip(pdf["n"], pdf["mean"], pdf["gram"], strict=True)]
            return pd.DataFrame({"_by": pdf["_by"].iloc[:1].to_numpy(), "_b": [chosen.coefficients(*chosen.summed(parts), settings)]})

        sums = rows.where("_y is not null").groupBy("_by", at("_known").alias("_k")).applyInPandas(moments, f"_by {by_type}, n bigint, mean array<double>, gram array<double>")
        models = sums.groupBy("_by").applyInPandas(fitted, f"_by {by_type}, _b array<double>")
        terms = F.zip_with(F.concat("_x", F.array(F.lit(1.0))), "_b", lambda a, b: a * b)
        got = rows.where("_y is null").join(models, "_by").select(row_id, F.aggregate(terms, F.lit(0.0), lambda s, t: s + t).alias("value"))
    elif isinstance(chosen, Forest):
        trees, labels = chosen.trees(settings), None if kind == "numeric" else rows.where("_y is not null").groupBy("_by").agg(F.array_sort(F.collect_set("_y")).alias("_labels"))
        turns = F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // chosen.chunk))).alias("_t")
        known = rows.where("_y is not null").groupBy("_by", "_x", "_y").agg(F.count("*").alias("_n")).select("*", turns)
        wanted = rows.where("_y is null").select("_by", "_x").distinct().select("*", turns)

        def grown(pdf: pd.DataFrame) -> pd.DataFrame:
            known, wanted, t = pdf[pdf["_n"].notna()], pdf[pdf["_n"].isna()], int(pdf["_t"].iloc[0]) * chosen.chunk
            x, y = matrix(known), known["_y"].to_numpy()
            levels, codes = np.unique(y if kind == "numeric" else y.astype(str), return_inverse=True)
            by = np.lexsort((codes, *x.T))  # the same trees however the rows come
            y = (levels[codes].astype(float)[:, None] if kind == "numeric" else np.eye(len(levels))[codes])[by]
            votes = chosen.votes(x[by], y, known["_n"].to_numpy().astype(int)[by], matrix(wanted), settings, range(t, min(trees, t + chosen.chunk)))
            return pd.DataFrame({"_by": wanted["_by"].to_numpy(), "_x": wanted["_x"].to_numpy(), "_t": t, "_v": list(votes)})

        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = known.unionByName(wanted, allowMissingColumns=True).repartition(tasks, "_by", "_t").groupBy("_by", "_t").applyInPandas(grown, f"_by {by_type}, _x array<double>, _t int, _v array<double>")
        votes = pairs.groupBy("_by", "_x").agg(F.array_sort(F.collect_list(F.struct("_t", "_v")))["_v"].alias("_v"))
        votes = votes.select("_by", "_x", F.reduce(F.slice("_v", 2, trees), F.col("_v")[0], lambda a, b: F.zip_with(a, b, lambda p, q: p + q)).alias("_v"))
        if labels is None:
            values = votes.select("_by", "_x", (F.col("_v")[0] / trees).alias("value"))
        else:
            values = votes.join(labels, "_by").select("_by", "_x", F.col("_labels")[(F.array_position("_v", F.array_max("_v")) - 1).cast("int")].alias("value"))
        got = rows.where("_y is null").select(row_id, "_by", "_x").join(values, ["_by", "_x"]).select(row_id, "value")
    else:

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            known, wanted = pdf[pdf["_y"].notna()].sort_values(row_id), pdf[pdf["_y"].isna()]
            return pd.DataFrame({row_id: wanted[row_id].to_numpy(), "value": chosen.impute(matrix(known), known["_y"].to_numpy(), matrix(wanted), kind, settings)})

        got = rows.groupBy("_by").applyInPandas(fill, f"{row_id} {id_type}, value {out}")
    return got.unionByName(alone)


def holdout_error(df: DataFrame, column: str, numeric: list[str], categorical: list[str], by: str, name: str, settings: dict, kind: str = "numeric", row_id: str = "row_id") -> DataFrame:
    """Hides a tenth of the known values, imputes them and compares: one row with the error."""
    from gridloom.operators.stats import imputation_error

    hidden = hidden_rows(df, column, row_id)
    masked = df.join(hidden.select(row_id, F.lit(True).alias("_h")), row_id, "left").withColumn(column, F.when(F.col("_h").isNull(), F.col(column)))
    guesses = imputed(masked, column, numeric, categorical, by, name, settings, kind, row_id, only="_h")
    return imputation_error(hidden.join(guesses, row_id), "actual", "value", kind)


def best_settings(scores: DataFrame, column: str, score: str, secondary: str, order: str) -> DataFrame:
    """Per column the setting with the smallest score, of ties that with the smallest secondary score, then the first."""
    rank = F.row_number().over(Window.partitionBy(column).orderBy(score, secondary, order))
    return scores.withColumn("_r", rank).where("_r = 1").drop("_r")


def best_method(scores: dict[str, float]) -> str:
    """The method with strictly the smallest score; mice if two share it."""
    least = min(scores.values())
    first = [k for k, v in scores.items() if v == least]
    return first[0] if len(first) == 1 else "mice"


def change(before: DataFrame, after: DataFrame, row_id: str, value: str, kind: str = "numeric") -> DataFrame:
    """How far an iteration moved: mean relative change of numbers, share of changed categories."""
    both = before.select(row_id, F.col(value).alias("_a")).join(after.select(row_id, F.col(value).alias("_b")), row_id)
    if kind == "numeric":
        return both.agg(F.avg(F.try_divide(F.abs(F.col("_b") - F.col("_a")), F.greatest(F.abs("_a"), F.lit(1e-10)))).alias("change"))
    return both.agg(F.avg((~F.col("_a").eqNullSafe(F.col("_b"))).cast("double")).alias("change"))


def converged(changes: list[float], tolerance: float = 1e-3, least: int = 3) -> bool:
    return len(changes) >= least and changes[-1] < tolerance
