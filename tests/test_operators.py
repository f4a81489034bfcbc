"""Properties, published values and reference implementations of operators that SQL can't express."""

import math
import tracemalloc
import warnings
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import numbers, raster
from gridloom.functions.text import case_variants
from gridloom.operators import factors, grid, imagery, imputation, integrity, label, rasters, stats, survey


def one(df):
    return df.first()[0]


# Published yearly threshold results at 30 per cent (labelled cells, Moran's I, interval width) and their aggregate.
YEARLY = [(536, 0.8568287332023042, 0.015730457068040438), (543, 0.8853456577920813, 0.016731769954795306), (860, 0.8597130612398897, 0.01221052187032401),
          (537, 0.8944483412835048, 0.017675965733922383), (539, 0.8942243066474694, 0.01847580831263118), (846, 0.8608287026928806, 0.011954386614645984)]
CELLS = 7924
# Published yearly means of the inferred index.
MEANS = {2016: 0.3585360439534826, 2017: 0.3710588722305029, 2018: 0.38331094110763236, 2019: 0.3963465101589978, 2023: 0.423600082656069, 2024: 0.41716371770009797}


def test_published_aggregate(spark):
    df = spark.createDataFrame([(0, 30.0, 100 * n / CELLS, i, 0.001, w) for n, i, w in YEARLY], "step int, threshold double, percent_cells_labelled double, moran_i double, moran_p double, interval_width double")
    r = stats.aggregated_sweeps(df).first()
    assert r.num_years == 6 and abs(r.percent_cells - 8.12089853609288) < 1e-9 and abs(r.percent_cells_max - 10.853104492680464) < 1e-9
    assert abs(r.moran_i - 0.8752314671430218) < 1e-12 and abs(r.interval_width - 0.015463151592393217) < 1e-12


def test_published_forecast(spark):
    df = spark.createDataFrame([(1, y, v) for y, v in MEANS.items()], "cell int, year int, v double")
    assert abs(stats.group_forecast(df, "cell", "year", "v", 2024, ()).first().prediction - 0.425665) < 1e-5
    assert abs(stats.group_forecast(df, "cell", "year", "v", 2024).first().prediction - 0.435856) < 1e-5


def test_t_quantile():
    for n, t in ((1, 12.7062047), (4, 2.7764451), (30, 2.0422725), (1000, 1.9623391)):
        assert abs(stats.t_quantile(0.975, n) - t) < 1e-5


def test_moran(spark):
    flat = spark.createDataFrame([("a", i, j, 1.0) for i in range(4) for j in range(4)] + [("b", i, j, float(i)) for i in range(4) for j in range(4)], "k string, i int, j int, v double")
    got = {r.k: r.moran_i for r in stats.moran_i(flat, "v", ("k",)).collect()}
    assert got["a"] is None and got["b"] > 0.3
    p = {r.k: (r.moran_i, r.p_value) for r in stats.moran_permutation(flat, "v", ("k",), 99).collect()}
    assert abs(p["b"][0] - got["b"]) < 1e-9 and p["b"][1] == 0.01


def test_interval_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "k string, v double")
    assert all(r.width is None for r in stats.mean_interval(df, "v", ("k",)).collect())


def test_geometry(spark):
    row = spark.range(1)
    ring = G.circle(F.lit(10.0), F.lit(20.0), F.lit(2000.0))
    assert abs(one(row.select(G.ring_area(ring))) - 32 * 2000**2 * math.sin(2 * math.pi / 64)) < 1e-3
    # Cells that cover a concave ring share out its area.
    concave = F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (7, 0), (7, 7), (3.5, 2), (0, 7))])
    bounds = spark.sql("select 0.0D x0, 0.0D y0, 7.0D x1, 7.0D y1")
    cells = grid.grid_anchored(bounds, 2.0).withColumn("ring", concave).withColumn("b", F.struct("x0", "y0", "x1", "y1"))
    parts = one(cells.select(G.ring_area(G.clipped(F.col("ring"), F.col("b"))).alias("a")).agg(F.sum("a")))
    assert abs(parts - one(row.select(G.ring_area(concave)))) < 1e-9
    lonlat = row.select(G.projected(F.lit(-14.5), F.lit(14.7), 32628).alias("p")).select("p.x", "p.y")
    back = lonlat.select(G.unprojected(F.col("x"), F.col("y"), 32628).alias("q")).first().q
    assert abs(back.x + 14.5) < 1e-8 and abs(back.y - 14.7) < 1e-8
    assert abs(lonlat.first().x - 553861.6) < 50  # half a degree from the central meridian


def test_unknown_place_raises(spark):
    with pytest.raises(Exception, match="unknown class"):
        spark.createDataFrame([("X",)], "p string").select(G.buffer_radius(F.col("p"))).collect()


def test_box_join_is_complete(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(-50, 50, (60, 2))
    size = rng.uniform(0, 20, (60, 2))
    data = [(i, *map(float, (*a, *(a + s)))) for i, (a, s) in enumerate(zip(xy, size, strict=True))]
    df = spark.createDataFrame(data, "id int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.a_id, r.b_id) for r in grid.box_join(df, df, 7.0).select("a_id", "b_id").collect()]
    meet = [(p[0], q[0]) for p in data for q in data if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(got) == sorted(meet)


def test_covered_area(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 3.0, 3.0), (1, 0.5, 0.5, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    assert {r.k: r.covered_area for r in grid.covered_area(df, ["k"]).collect()} == {1: 7.0, 2: 2.0}


def test_single_match_is_taken_as_it_is(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0, 2.0), (2, 1.0, 1.0, 1.0), (2, 4.0, 2.0, 1.0)], "k int, x double, a double, w double")
    got = {r.k: r.m for r in df.groupBy("k").agg(label.double_weighted_mean(F.col("x"), F.col("a"), F.col("w")).alias("m")).collect()}
    assert got == {1: 5.0, 2: 3.0}


def test_missing_location(spark):
    c = spark.createDataFrame([(1, 0.5), (2, 0.6)], "hv001 int, wealth_index double")
    p = spark.createDataFrame([(1, 0.0, 0.0, "U")], "dhsclust int, x double, y double, urban_rura string")
    on = F.col("dhsclust") == F.col("hv001")
    assert label.located(c, p, on).count() == 2 and label.located(c, p, on, "drop").count() == 1
    with pytest.raises(Exception, match="no location"):
        label.located(c, p, on, "error").collect()


def test_rasters(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 9, (6, 5))
    df = spark.createDataFrame([(a.ravel().tolist(), 6, 5)], "data array<double>, height int, width int")
    both = rasters.with_gradient(df).withColumn("_s", raster.convolved(F.col("data"), F.col("height"), F.col("width"), raster.SMOOTH)).withColumn("g", raster.gradient(F.col("_s"), F.col("height"), F.col("width"))).first()
    assert np.allclose(both.gradient, both.g)
    turned = df
    for _ in range(2):
        turned = turned.withColumn("data", raster.flipped(F.col("data"), F.col("height"), F.col("width"), True))
    assert np.allclose(turned.first().data, a.ravel())
    q = df.select(raster.quarter_turn(F.col("data"), F.col("height"), F.col("width"))).first()[0]
    assert np.allclose(np.array(q).reshape(5, 6), np.rot90(a))
    ramp = np.add.outer(np.arange(12.0), 2 * np.arange(12.0))
    small = rasters.resize(ramp, 6, 6)
    assert np.allclose(small[2:4, 2:4], ramp.reshape(6, 2, 6, 2).mean((1, 3))[2:4, 2:4])
    assert np.allclose(rasters.resize(np.full((4, 4), 3.0), 9, 9), 3.0)


def test_quantize(spark):
    df = spark.createDataFrame([(float("nan"),), (-5.0,), (1800.0,), (9000.0,), (None,)], "v double")
    assert [r[0] for r in df.select(numbers.quantize(F.col("v"), "visible")).collect()] == [0, 0, 127, 255, 0]
    assert [r[0] for r in df.select(numbers.quantize(F.col("v"), "index")).collect()] == [127, 0, 255, 255, 127]


def test_composite_ignores_what_is_missing(spark):
    df = spark.createDataFrame([(1, [1.0, None, float("nan")]), (1, [3.0, 4.0, float("nan")])], "k int, p array<double>")
    assert imagery.composite(df, ("k",), "p").first().data == [2.0, 4.0, 0.0]


def test_profile_types(spark):
    rows = [("1", "1.5", None, "x"), ("2", "2.5", None, None), ("3", "1.5", None, "x"), ("3", "2.5", None, None), ("1", "1.5", None, "x")]
    df = spark.createDataFrame(rows, "whole string, few string, empty string, half string")
    got = {r.column: r for r in survey.profile(df, ["whole", "few", "empty", "half"]).collect()}
    assert got["whole"].type_by_values == "numeric" and got["few"].type_by_values == "categorical" and got["few"].type_by_parsing == "numeric"
    assert got["empty"].type_by_parsing == "numeric" and got["half"].constant_with_nulls and not got["whole"].constant_with_nulls
    assert survey.dense_columns(df, ["whole", "empty", "half"], 0.4) == ["whole", "half"]
    assert survey.dense_columns(df.limit(4), ["half"], 0.5) == ["half"]
    assert "Don't Know" not in case_variants(["don't know"])


def test_imputation(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 120)
    rows = [(i, "s", float(v), None if i % 6 == 0 else float(3 * v + 1), "lo" if v < 5 else "hi", None if i % 7 == 0 else ("a" if v < 5 else "b")) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, survey string, x double, y double, g string, c string")
    truth = {i: 3 * v + 1 for i, v in enumerate(x)}
    for name, settings, tolerance in (("mice", {"method": "linear"}, 1e-6), ("mice", {"method": "bayesian_ridge"}, 0.1), ("knn", {"n_neighbors": 3, "weights": "distance"}, 3.0), ("missforest", {"n_estimators": 20}, 5.0)):
        got = imputation.imputed(df, "y", ["x"], [], "survey", name, settings).collect()
        assert len(got) == 20 and max(abs(r.value - truth[r.row_id]) for r in got) < tolerance, name
    for name in imputation.METHODS:
        got = imputation.imputed(df, "c", ["x"], ["g"], "survey", name, {"n_estimators": 10}, "categorical").collect()
        assert len(got) == 18 and all(r.value == ("a" if x[r.row_id] < 5 else "b") for r in got), name
    error = one(imputation.holdout_error(df, "y", ["x"], [], "survey", "mice", {"method": "linear"}))
    assert 0 <= error < 1e-6
    assert imputation.best_method({"knn": 0.2, "mice": 0.3, "missforest": 0.25}) == "knn" and imputation.best_method({"knn": 0.2, "mice": 0.3, "missforest": 0.2}) == "mice"
    with pytest.raises(ValueError, match="unknown"):
        imputation.method("other")
    assert imputation.converged([0.5, 0.1, 0.0001]) and not imputation.converged([0.0001])


def test_candidates(spark):
    assert imputation.neighbour_counts(100, 20) == [3, 5, 7, 11, 17] and max(imputation.neighbour_counts(100_000, 40)) <= 53
    for name in imputation.METHODS:
        table = imputation.candidate_table(spark, name, 2000, "numeric", 35.0)
        assert 0 < table.count() <= 96 and table.where("complexity < 0 or complexity > 1").count() == 0
    assert len(imputation.NearestNeighbours().candidates(2000, "numeric", 35.0)) == 30


def test_factor_analysis(spark):
    rng = np.random.default_rng(4)
    n = 300
    z = rng.standard_normal(n)
    rows = [(i, float(z[i] + 0.1 * rng.standard_normal()), float(-z[i] + 0.2 * rng.standard_normal()), "yes" if z[i] > 0 else "no", "yes" if z[i] + 0.5 * rng.standard_normal() > 0 else "no") for i in range(n)]
    df = spark.createDataFrame(rows, "id int, u double, v double, a string, b string")
    f = factors.fit(df, ["u", "v"], ["a", "b"])
    pdf = df.toPandas()
    coded = [(pdf[c] - pdf[c].mean()) / pdf[c].std(ddof=0) for c in ("u", "v")] + [((pdf[c] == v) - (pdf[c] == v).mean()) / (pdf[c] == v).mean() ** 0.5 for c in ("a", "b") for v in ("no", "yes")]
    s = np.linalg.svd(np.column_stack(coded) / n**0.5, compute_uv=False)
    assert np.allclose(f.eigenvalues, s**2, atol=1e-9) and np.allclose(f.contributions().sum(0), 1)
    assert factors.parallel_analysis(spark, f, n, 50)[0] == 0
    index = factors.index(df, f, [0, 1], ["a", "b"]).toPandas()
    assert index.wealth_index.min() == 0 and index.wealth_index.max() == 1 and np.corrcoef(index.wealth_index, z)[0, 1] > 0.9


def test_factor_analysis_codes_every_level(spark):
    rows = [(float(i % 7), f"v{i % 250:03d}", "x" if i % 3 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "u double, a string, b string")
    f = factors.fit(df, ["u"], ["a", "b"])
    assert len(f.names) == 1 + 250 + 1 and f.names[1:3] == ["a=v000", "a=v001"]
    # The trace is the sum of the columns' variances: 1 for numbers, 1 - share for levels.
    assert abs(f.eigenvalues.sum() - (1 + sum(1 - p for _, _, p in f.levels))) < 1e-9
    with pytest.raises(ValueError, match="more than 100"):
        factors.fit(df, ["u"], ["a"], most_columns=100)


def test_modes(spark):
    df = spark.createDataFrame([(10, "b"), (9, "b"), (10, "a"), (9, "a"), (None, None)], "n int, t string")
    assert tuple(survey.smallest_mode(df, ["n", "t"]).first()) == (9, "a")
    assert tuple(survey.smallest_mode(df.limit(0), ["n", "t"]).first()) == (None, None)
    got = survey.filled(df.withColumn("u", F.lit(None).cast("string")), ["n"], ["t", "u"]).where("t = 'a' and n = 9.5 and u = 'missing'")
    assert got.count() == 1 and survey.filled(df, [], []).count() == 5


def test_a_stream_without_files_gives_no_rows(spark, tmp_path):
    from gridloom.streaming import monitor

    (tmp_path / "none").mkdir()
    stream = monitor.log_stream(spark, str(tmp_path / "none"), "k string, ts timestamp", "parquet")
    assert monitor.drained(monitor.failure_counts(stream, "k"), "none_test").count() == 0
    assert monitor.drained(stream, "none_rows", "append").count() == 0


def test_integrity(spark):
    log = spark.createDataFrame([(None,), ("global",), ("batch_0_500",), ("17",), ("17",), ("x",)], "cell_id string")
    assert [r[0] for r in integrity.failed_cells(log).collect()] == [17]
    left, seen = [3], []

    def repair(problems):
        seen.append(problems.count())
        left[0] -= 1

    assert integrity.repair_rounds(lambda: spark.range(left[0]), repair) == 3 and seen == [3, 2, 1]
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, o int, v string")
    assert integrity.last_match(runs, ["k"], "o").first().v == "y"


def test_loss_metrics(spark):
    df = spark.createDataFrame([([1.0, 0.5], [1.0, 0.8]), ([1.0], [1.0]), ([], [])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(raster.loss_metrics(F.col("a"), F.col("b"))).collect()]
    assert got[1] is None and got[2] is None and abs(got[0].volatility - 0.1) < 1e-12 and abs(got[0].overfit_gap - 0.3) < 1e-12
    assert one(df.select(raster.best_epoch(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0))))) == 2


def test_stalls(spark, tmp_path):
    from gridloom.streaming import monitor

    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(seconds=s)) for s in (0, 10, 200, 400, 410, 420)] + [("b", start)]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = monitor.log_stream(spark, str(tmp_path / "log"), "k string, ts timestamp", "parquet")
    got = sorted((r.k, r.seconds, r.consecutive, r.escalated) for r in monitor.drained(monitor.stalls(stream, "k", "string"), "stalls_test", "append").collect())
    assert got == [("a", 190.0, 1, False), ("a", 200.0, 2, True)]




def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    for x in (rng.standard_normal(5000), rng.integers(0, 4, 3000).astype(float), np.array([7.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        got = stats.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.95, 1.0])
        assert np.allclose(got, np.quantile(x, [0.0, 0.25, 0.5, 0.95, 1.0]), atol=1e-9)
    assert stats.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_hidden_rows_are_a_tenth_and_one_at_least(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    n = imputation.hidden_rows(df, "v").count()
    assert 60 < n < 145 and imputation.hidden_rows(df.limit(3), "v").count() >= 1 and imputation.hidden_rows(df.limit(0), "v").count() == 0


def test_parallel_analysis_simulates_the_rows_of_the_table(spark, monkeypatch):
    from gridloom.operators import factors
    from gridloom.plans import learning

    asked, n = [], 5000
    monkeypatch.setattr(factors, "parallel_analysis", lambda *a, **k: asked.append((a[2:], k)) or [0])
    monkeypatch.setattr(learning, "table", lambda spark, d, name: spark.range(n).selectExpr("id as p_partkey", "id % 7 as p_size", "cast(id % 11 as double) as p_retailprice", "concat('b', id % 3) as p_brand"))
    learning.m11(spark, "")
    assert asked == [((n,), {})]


def test_parallel_analysis_adds_up_blocks_of_rows(spark):
    from gridloom.operators import factors

    eigen = np.array([1.2, 1.06, 1.0, 0.94])
    f = factors.Factors(tuple((c, 0.0, 1.0) for c in "abcd"), (), eigen, np.eye(4))
    # Unrelated columns reach about 1.15 with 500 rows and 1.03 with 20 000.
    assert factors.parallel_analysis(spark, f, 500, 50) == [0]
    assert factors.parallel_analysis(spark, f, 20_000, 50, block=3000)[:2] == [0, 1] and factors.parallel_analysis(spark, f, 0) == []


def test_moran_permutation_query_covers_every_cell(spark, monkeypatch):
    from gridloom.plans import stats as plans

    pixels = spark.range(60 * 9).selectExpr("id div 9 as cell_id", "id % 9 div 3 as i", "id % 3 as j", "cast(id % 9 as double) as value")
    monkeypatch.setattr(plans, "_pixels", lambda spark, d: pixels)
    got = plans.a12_p(spark, "").toPandas()
    assert sorted(got.cell_id) == list(range(60))
    # A slope: only one in hundreds of orders is as even, which 99 permutations couldn't tell; p comes in thousandths.
    p = got.p_value.to_numpy() * 1000
    assert np.allclose(p, p.round()) and (p < 10).all()


def test_forest_grows_as_many_and_as_deep_trees_as_it_is_told(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    y = np.floor(x[:, 0] * 64) + x[:, 1]
    forest, grown, grow = imputation.Forest(), [], imputation.Forest._grow
    monkeypatch.setattr(imputation.Forest, "_grow", lambda self, *a: grown.append(a[6]) or grow(self, *a))
    for n, depth in ((50, None), (100, 20), (200, None)):
        grown.clear()
        forest.impute(x, y, x[:5], "numeric", {"n_estimators": n, "max_depth": depth})
        assert grown == [depth] * n
    # One tree on all rows and columns, without limits, gives its own rows back: with any number of levels and cut points.
    deep, at = np.arange(300.0)[:, None], 4.0 ** -np.arange(300)
    for a, b in ((x, y), (deep, at)):
        votes = np.zeros((len(a), 1))
        grow(forest, a, b[:, None], a, votes, rng, a.shape[1], None, 2)
        assert np.allclose(votes[:, 0], b, rtol=1e-9, atol=0)
    votes = np.zeros((400, 1))
    grow(forest, x, y[:, None], x, votes, rng, 3, 1, 2)
    cut = min((((y[m] - y[m].mean()) ** 2).sum() + ((y[~m] - y[~m].mean()) ** 2).sum(), tuple(np.where(m, y[m].mean(), y[~m].mean()))) for f in range(3) for c in np.sort(x[:, f])[:-1] for m in [x[:, f] <= c])
    assert np.allclose(votes[:, 0], cut[1])
    words = forest.impute(x, np.where(x[:, 2] > 0.5, "b", "a"), np.array([[0.1, 0.1, 0.9], [0.9, 0.9, 0.1]]), "categorical", {"n_estimators": 50, "max_features": "sqrt"})
    assert list(words) == ["b", "a"]


def test_imputed_values_do_not_depend_on_the_size_of_parts(spark):
    df = spark.range(240).selectExpr("id as row_id", "cast(id % 2 as string) as survey", "case when id % 3 > 0 then cast(id * 17 % 31 as double) end as y", "case when id % 3 > 0 then concat('c', id * 5 % 4) end as c", "cast(id * 37 % 101 as double) as a", "concat('l', id div 4) as many")
    cases = [
        ("y", "knn", {"n_neighbors": 5, "weights": "distance"}, "numeric"),
        ("c", "knn", {"n_neighbors": 7, "metric": "manhattan"}, "categorical"),
        ("y", "mice", {"method": "linear"}, "numeric"),
        ("y", "mice", {"method": "bayesian_ridge"}, "numeric"),
        ("c", "mice", {"method": "logistic"}, "categorical"),
        ("y", "missforest", {"n_estimators": 5}, "numeric"),
    ]
    for column, name, settings, kind in cases:
        levels = ["many"] if name == "knn" else []
        a, b = [imputation.imputed(df, column, ["a"], levels, "survey", name, settings, kind, part=p).toPandas().sort_values("row_id") for p in (20_000, 15)]
        assert list(a.row_id) == list(b.row_id) == list(range(0, 240, 3))
        assert np.allclose(a.value, b.value, rtol=1e-8) if kind == "numeric" else list(a.value) == list(b.value)
    # The nearest rows of the whole survey, and a survey without known rows.
    got = dict(imputation.imputed(df, "y", ["a"], [], "survey", "knn", {"n_neighbors": 3}, part=10).collect())
    known = [(i, i * 37 % 101, i * 17 % 31) for i in range(240) if i % 3]
    for i, v in got.items():
        near = sorted((abs(a - i * 37 % 101), j, y) for j, a, y in known if j % 2 == i % 2)[:3]
        assert abs(v - sum(n[2] for n in near) / 3) < 1e-9
    bare = df.withColumn("y", F.when(F.col("survey") == "0", F.col("y")))
    lone = imputation.imputed(bare, "y", ["a"], [], "survey", "mice", {"method": "linear"}).where("row_id % 2 = 1").collect()
    assert len(lone) == 120 and len({r.value for r in lone}) == 1
    assert len(imputation.encoded(df, [], ["many"])[1]) == 60


def test_nearest_rows_are_sought_once_for_equal_predictors(spark, monkeypatch):
    class Strict(imputation.NearestNeighbours):
        def nearest(self, known, wanted, settings):
            for x in (known, wanted):
                if len(np.unique(x, axis=0)) < len(x):
                    raise ValueError("rows with equal predictors")
            return super().nearest(known, wanted, settings)

    monkeypatch.setitem(imputation.METHODS, "knn", Strict)
    df = spark.range(600).selectExpr("id as row_id", "cast(id % 3 as string) as survey", "case when id % 10 > 1 then concat('c', id * 7 % 11 % 4) end as kind", "concat('b', id * 13 % 17 % 5) as brand")
    rows = df.collect()
    for part in (20_000, 3):
        got = dict(imputation.imputed(df, "kind", [], ["brand"], "survey", "knn", {"n_neighbors": 5, "metric": "hamming", "weights": "distance"}, "categorical", part=part).collect())
        assert len(got) == 120
        for r in rows:
            if r.kind is None:
                near = [k.kind for k in sorted((k for k in rows if k.kind and k.survey == r.survey), key=lambda k: (k.brand != r.brand, k.row_id))[:5]]
                assert got[r.row_id] == min(near, key=lambda v: (-near.count(v), v))


def test_trees_of_rows_counted_once_are_those_of_all_rows():
    rng = np.random.default_rng(8)
    level = rng.integers(0, 6, 150)
    x = np.column_stack([np.round(rng.random(150), 1), *[(level == i).astype(float) for i in range(6)], rng.random(150) < 0.8, rng.random(150), np.ones(150)])
    y, weight, wanted = rng.normal(size=(150, 2)), rng.integers(1, 5, 150), x[rng.permutation(150)[:60]]

    def plain(rows, q, depth):
        here = np.repeat(rows, weight[rows])
        mean = y[here].mean(0)
        loss = lambda r: ((y[r] - y[r].mean(0)) ** 2).sum()
        cuts = [(loss(here[m]) + loss(here[~m]), f, c) for f in range(x.shape[1]) for c in np.unique(x[rows, f])[:-1] for m in [x[here, f] <= c]]
        if not depth or len(here) < 4 or not cuts:
            return mean
        _, f, c = min(cuts)
        after = x[rows, f][x[rows, f] > c].min()
        return plain(rows[x[rows, f] <= c] if q[f] <= (c + after) / 2 else rows[x[rows, f] > c], q, depth - 1)

    for depth in (1, 4, 12):
        votes = np.zeros((60, 2))
        imputation.Forest()._grow(x, y, wanted, votes, rng, x.shape[1], depth, 4, weight)
        assert np.allclose(votes, [plain(np.arange(150), q, depth) for q in wanted])
    settings = {"max_features": "sqrt", "min_samples_split": 3}
    once = imputation.Forest().votes(x, y, weight, wanted, settings, range(3, 9))
    again = [imputation.Forest().votes(np.repeat(x, weight, 0), np.repeat(y, weight, 0), np.ones(weight.sum(), int), wanted, settings, range(*r)) for r in ((3, 5), (5, 9))]
    assert np.allclose(once, again[0] + again[1])


def test_forests_are_grown_in_several_tasks_of_different_rows(spark, monkeypatch):
    class Strict(imputation.Forest):
        def _grow(self, x, y, *rest):
            self.grown = getattr(self, "grown", 0) + 1
            if len(np.unique(np.column_stack([x, y]), axis=0)) < len(x):
                raise ValueError("a row is there twice")
            return super()._grow(x, y, *rest)

        def votes(self, *rest):
            self.grown = 0
            votes = super().votes(*rest)
            if self.grown > 10:
                raise ValueError("too many trees in a task")
            return votes

    monkeypatch.setitem(imputation.METHODS, "missforest", Strict)
    df = spark.range(900).selectExpr("id as row_id", "cast(id % 3 as string) as survey", "id * 7 % 90 as u").selectExpr("*", "case when row_id % 10 > 1 then u % 5 * 10.0D end as y", "cast(u % 5 as double) as x", "concat('b', u % 4) as brand")
    got = imputation.imputed(df, "y", ["x"], ["brand"], "survey", "missforest", {"n_estimators": 25, "max_features": None}).collect()
    assert len(got) == 180 and all(abs(r.value - r.row_id * 7 % 90 % 5 * 10) < 1e-6 for r in got)


@pytest.mark.parametrize(("metric", "p"), [("euclidean", None), ("manhattan", None), ("chebyshev", None), ("minkowski", 3), ("hamming", None)])
def test_nearest_rows_are_those_of_brute_force(metric, p):
    rng = np.random.default_rng(5)
    numbers = np.round(rng.random((700, 3)) * 10, 1)
    odd = numbers.copy()
    odd[rng.integers(0, 700, 40), rng.integers(0, 3, 40)] = rng.choice([np.nan, np.inf, -np.inf, 1e300], 40)
    search = imputation.NearestNeighbours()
    for x in (numbers, np.column_stack([numbers[:, :1] * 10, np.eye(9)[rng.integers(0, 9, 700)]]), odd, numbers[:, :0], numbers[:4]):
        known, wanted = x[: len(x) * 3 // 4], x[len(x) * 3 // 4 :]
        settings = {"n_neighbors": 7, "metric": metric, "p": p}
        with np.errstate(all="ignore"), warnings.catch_warnings(action="ignore"):
            d, near = search.nearest(known, wanted, settings)
            every = search.distances(np.abs(wanted[:, None, :] - known), settings)
        first = np.argsort(every, axis=1, kind="stable")[:, :7]
        assert (near == first).all() and np.array_equal(d, np.take_along_axis(every, first, 1), equal_nan=True)


def test_nearest_rows_are_found_without_a_matrix_of_all_pairs():
    x = np.random.default_rng(6).random((6000, 1))
    tracemalloc.start()
    d, near = imputation.NearestNeighbours().nearest(x[:3000], x[3000:], {"n_neighbors": 5})
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert d.shape == near.shape == (3000, 5) and most < 3000 * 3000 * 8 / 2


def test_holdout_error_is_that_of_brute_force_over_the_hidden_rows_alone(spark, monkeypatch):
    class Strict(imputation.NearestNeighbours):
        def nearest(self, known, wanted, settings):
            if (wanted[:, 0] >= 1000).any():
                raise ValueError("a row that isn't hidden")
            return super().nearest(known, wanted, settings)

    monkeypatch.setitem(imputation.METHODS, "knn", Strict)
    df = spark.range(400).selectExpr("id as row_id", "cast(id % 2 as string) as survey", "id % 4 = 3 as gone", "cast(id * 37 % 101 as double) as a", "concat('b', id * 13 % 17 % 5) as brand")
    df = df.selectExpr("row_id", "survey", "case when not gone then cast(row_id * 17 % 31 as double) end as y", "case when gone then a + 1000 else a end as a", "brand")
    hidden = dict(imputation.hidden_rows(df, "y").collect())
    known = [r for r in df.collect() if r.y is not None and r.row_id not in hidden]
    off = []
    for w in df.where(F.col("row_id").isin(list(hidden))).collect():
        near = sorted((k for k in known if k.survey == w.survey), key=lambda k: ((k.a - w.a) ** 2 + 2 * (k.brand != w.brand), k.row_id))[:7]
        off.append((sum(k.y for k in near) / 7 - hidden[w.row_id]) ** 2)
    error = one(imputation.holdout_error(df, "y", ["a"], ["brand"], "survey", "knn", {"n_neighbors": 7}))
    assert abs(error - math.sqrt(sum(off) / len(off)) / (max(hidden.values()) - min(hidden.values()))) < 1e-9


def test_methods_are_compared_over_different_rows(spark, monkeypatch, tmp_path):
    from gridloom import catalog

    def different(x):
        if len(np.unique(x, axis=0)) < len(x):
            raise ValueError("a row is there twice")

    class Neighbours(imputation.NearestNeighbours):
        def nearest(self, known, wanted, settings):
            different(known)
            return super().nearest(known, wanted, settings)

    class Trees(imputation.Forest):
        def _grow(self, x, y, *rest):
            different(np.column_stack([x, y]))
            return super()._grow(x, y, *rest)

    monkeypatch.setitem(imputation.METHODS, "knn", Neighbours)
    monkeypatch.setitem(imputation.METHODS, "missforest", Trees)
    spark.range(3000).selectExpr("id as p_partkey", "concat('b', id % 4) as p_brand", "concat('t', id % 5) as p_type", "cast(id * 7 % 50 as int) as p_size", "cast(id % 50 as double) as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.method: r for r in catalog.QUERIES["m9_best_method"](spark, str(tmp_path)).collect()}
    assert set(got) == {"knn", "mice", "missforest"} and got["knn"].error < 1e-9 and got["missforest"].error < 0.05 < got["mice"].error
    assert [k for k in got if got[k].chosen] == ["knn"]


def test_mean_intervals_of_groups_of_any_size(spark, monkeypatch):
    from gridloom import catalog
    from gridloom.plans import stats as plans

    rows = [(i, 0 if i < 200 else 1, "a", float(i * 7919 % 1009)) for i in range(203)]
    monkeypatch.setattr(plans, "table", lambda spark, d, name: spark.createDataFrame(rows, "c_custkey int, c_nationkey int, c_mktsegment string, c_acctbal double"))
    got = {r.c_nationkey: r for r in catalog.QUERIES["a11_mean_interval"](spark, "").collect()}
    # Quantiles from published tables: 199 and 2 degrees of freedom.
    for k, t in ((0, 1.971957), (1, 4.302653)):
        x = np.array([v for _, n, _, v in rows if n == k])
        half = t * x.std(ddof=1) / math.sqrt(len(x))
        assert got[k].n == len(x) and abs(got[k].lower - (x.mean() - half)) < 1e-3 and abs(got[k].upper - (x.mean() + half)) < 1e-3


def test_every_cell_is_reordered_and_turned(spark, monkeypatch):
    from gridloom import catalog
    from gridloom.plans import imagery as plans

    monkeypatch.setattr(plans, "_wide", lambda spark, d: spark.range(25).selectExpr("id as vec_id", *[f"transform(sequence(1, 16), x -> x + {100 * n}.0) as {c}" for n, c in enumerate("abc")]))
    monkeypatch.setattr(plans.P, "bands", lambda spark, d: spark.range(25).selectExpr("id as cell_id", "transform(sequence(1, 64), x -> x + 0.0) as data", "8 as height", "8 as width"))
    for name, key, n in (("r2_r10_channel_order", "vec_id", 48), ("r9_augmented", "cell_id", 64)):
        got = catalog.QUERIES[name](spark, "").groupBy(key).count().collect()
        assert sorted(r[key] for r in got) == list(range(25)) and {r["count"] for r in got} == {n}
