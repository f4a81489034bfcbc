"""Queries on imputation, factor analysis and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numbers, raster
from gridloom.operators import factors, imputation, rasters, stats
from gridloom.plans import proxies as P
from gridloom.plans._registry import Registry
from gridloom.sources.tables import table

query = Registry()


def _holes(spark, d):
    """Parts with a third of their sizes missing."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("row_id"), (k % 3).cast("string").alias("survey"), F.when(k * 7 % 10 >= 3, F.col("p_size").cast("double")).alias("size"), F.col("p_retailprice").alias("price"), "p_brand", F.when(k * 7 % 10 >= 2, F.col("p_type")).alias("kind"))


@query("m4_knn_numeric", """with t as (select p_partkey as row_id, p_partkey % 3 as s, case when p_partkey * 7 % 10 >= 3 then p_size end as v, p_retailprice as x from part),
    k as (select a.row_id, b.v, row_number() over (partition by a.row_id order by abs(a.x - b.x), b.row_id) as r from t a join t b on a.s = b.s where a.v is null and b.v is not null)
    select row_id, round(avg(v), 6) as value from k where r <= 5 group by 1""")
def m4(spark, d):
    got = imputation.imputed(_holes(spark, d), "size", ["price"], [], "survey", "knn", {"n_neighbors": 5, "metric": "euclidean", "weights": "uniform"})
    return got.select("row_id", F.round("value", 6).alias("value"))


@query("m4_knn_categorical")
def m4_categorical(spark, d):
    return imputation.imputed(_holes(spark, d), "kind", [], ["p_brand"], "survey", "knn", {"n_neighbors": 5, "metric": "hamming", "weights": "distance"}, "categorical")


@query("m5_mice_linear", """with t as (select p_partkey as row_id, p_partkey % 3 as s, case when p_partkey * 7 % 10 >= 3 then p_size end as v, p_retailprice as x from part),
    m as (select s, regr_slope(v, x) as b, regr_intercept(v, x) as a from t group by s) select row_id, round(a + b * x, 4) as value from t join m using (s) where v is null""")
def m5(spark, d):
    got = imputation.imputed(_holes(spark, d), "size", ["price"], [], "survey", "mice", {"method": "linear"})
    return got.select("row_id", F.round("value", 4).alias("value"))


@query("m5_mice_bayesian")
def m5_bayesian(spark, d):
    return imputation.imputed(_holes(spark, d), "size", ["price"], ["p_brand"], "survey", "mice", {"method": "bayesian_ridge"})


@query("m5_mice_logistic")
def m5_logistic(spark, d):
    return imputation.imputed(_holes(spark, d), "kind", ["price"], ["p_brand"], "survey", "mice", {"method": "logistic"}, "categorical")


@query("m6_forest")
def m6(spark, d):
    return imputation.imputed(_holes(spark, d), "size", ["price"], ["p_brand"], "survey", "missforest", {"n_estimators": 100, "max_features": "sqrt"})


@query("m7_convergence", "select round(avg(abs(0.5 / greatest(abs(p_size), 1e-10))), 6) as change from part")
def m7(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    return imputation.change(p, p.withColumn("v", F.col("v") + 0.5), "p_partkey", "v").select(F.round("change", 6).alias("change"))


@query("m8_holdout_error")
def m8(spark, d):
    return imputation.holdout_error(_holes(spark, d), "size", ["price"], ["p_brand"], "survey", "knn", {"n_neighbors": 7})


@query("m9_best_method")
def m9(spark, d):
    scores = {name: imputation.holdout_error(_holes(spark, d), "size", ["price"], [], "survey", name, {"n_estimators": 100} if name == "missforest" else {}).first()[0] for name in imputation.METHODS}
    return spark.createDataFrame([(k, float(v), k == imputation.best_method(scores)) for k, v in scores.items()], "method string, error double, chosen boolean")


@query("m3_u7_f25_candidates", "select i as n_iter, count(*) as n, round(min(0.4 * i / 20 + 0.3 * m / 11 + 0.2 * w + 0.1 * e), 6) as least from (values (5), (10), (15)) a(i), (values (3), (5), (7)) b(m), (values (0.2, 0.0), (0.1, 0.0), (0.1, 0.05)) c(w, e) group by i")
def m3(spark, d):
    rows = imputation.candidate_table(spark, "mice", 1500, "numeric", 12.0)
    return rows.groupBy("n_iter").agg(F.count("*").alias("n"), F.round(F.min("complexity"), 6).alias("least"))


@query("m3_knn_candidates")
def m3_knn(spark, d):
    return imputation.candidate_table(spark, "knn", 400, "numeric", 35.0)


@query("m3_forest_candidates")
def m3_forest(spark, d):
    return imputation.candidate_table(spark, "missforest", 6000, "categorical", 15.0)


@query("f25_neighbour_complexity", "select p_size as k, round(0.35 * case when p_size <= 5 then 0.3 when p_size <= 15 then 0.1 else 0.2 + (p_size - 15) / 50.0 end + 0.25 * 0.3 + 0.2 * 0.15 + 0.15 * 0.2 + 0.05 * 0.1, 6) as c from (select distinct p_size from part)")
def f25(spark, d):
    sizes = table(spark, d, "part", ["p_size"]).distinct()
    c = numbers.neighbour_complexity(F.col("p_size"), F.lit("minkowski"), F.lit("kd_tree"), F.lit("distance"), F.lit(30))
    return sizes.select(F.col("p_size").alias("k"), F.round(c, 6).alias("c"))


@query("o5_hidden_rows", """with t as (select p_partkey as row_id, p_partkey % 3 as s, case when p_partkey * 7 % 10 >= 3 then cast(p_size as double) end as v from part where p_partkey % 3 is not null),
    r as (select *, row_number() over (partition by s order by row_id * 7919 % 10007, row_id) as r, greatest(floor(count(*) over (partition by s) * 0.1), 1) as k from t where v is not null) select cast(s as varchar) as survey, row_id, v as actual from r where r <= k""")
def o5(spark, d):
    return imputation.hidden_rows(_holes(spark, d), "size", order=F.col("row_id") * 7919 % 10007, by=("survey",))


@query("o4_stable_split")
def o4(spark, d):
    return imputation.stable_split(table(spark, d, "orders", ["o_orderkey"]), "o_orderkey")


@query("o6_stratified_sample")
def o6(spark, d):
    return imputation.stratified_sample(table(spark, d, "orders", ["o_orderkey", "o_orderpriority"]), "o_orderpriority", "o_orderkey", 1000)


@query("w7_best_settings", "with s as (select p_brand, p_partkey, p_size, p_partkey % 11 as second, row_number() over (partition by p_brand order by p_size, p_partkey % 11, p_partkey) as r from part) select p_brand, p_partkey, p_size, second from s where r = 1")
def w7(spark, d):
    return imputation.best_settings(table(spark, d, "part").select("p_brand", "p_partkey", "p_size", (F.col("p_partkey") % 11).alias("second")), "p_brand", "p_size", "second", "p_partkey")


def _mixed(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), "p_brand")
    flag = lambda m: F.when(F.col("row_id") % m == 0, "yes").otherwise("no")
    return rows.withColumns({"a": flag(2), "b": flag(3), "c": flag(5)})


@query("m10_factors")
def m10(spark, d):
    f = factors.fit(_mixed(spark, d), ["size", "price"], ["a", "b", "p_brand"])
    return spark.createDataFrame([(i, float(round(v, 6))) for i, v in enumerate(f.eigenvalues)], "component int, eigenvalue double")


@query("m17_contributions")
def m17(spark, d):
    f = factors.fit(_mixed(spark, d), ["size", "price"], ["a", "b"])
    c = f.contributions()
    return spark.createDataFrame([(n, k, float(c[i, k])) for i, n in enumerate(f.names) for k in range(3)], "variable string, component int, contribution double")


@query("m11_parallel_analysis")
def m11(spark, d):
    rows = _mixed(spark, d)
    f = factors.fit(rows, ["size", "price"], ["a", "b", "c"])
    kept = factors.parallel_analysis(spark, f, rows.count())
    return spark.createDataFrame([(k,) for k in kept], "component int")


@query("m12_wealth_index")
def m12(spark, d):
    rows = _mixed(spark, d)
    f = factors.fit(rows, ["size", "price"], ["a", "b", "c"])
    return factors.index(rows, f, [0, 1, 2], ["a", "b", "c"]).select("row_id", "wealth_index")


@query("m2_feature_matrix")
def m2(spark, d):
    whole, names = imputation.encoded(_holes(spark, d), ["size", "price"], ["kind"])
    return whole.select("row_id", *names)


@query("m14_band_regressor")
def m14(spark, d):
    b = P.bands(spark, d).withColumn("band", F.lit("one"))
    stats_ = rasters.band_statistics(b, ["cell_id"], ["one"])
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.when(F.col("vec_id") % 3 != 0, F.col("label") / 10.0).alias("weighted_wealth"))
    rows = stats_.join(labels, "cell_id")
    return rasters.fitted_labels(rows, ["cell_id"], "weighted_wealth", [c for c in stats_.columns if c != "cell_id"])


_RUNS = "select user_id, array_agg(value order by ts, event_id) as train, array_agg(value / 2 order by ts, event_id) as test from events group by 1"


def _runs(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return e.select("user_id", F.transform("e", lambda x: x["value"]).alias("train"), F.transform("e", lambda x: x["value"] / 2).alias("test"))


@query("r11_m16_run_metrics", f"""with r as ({_RUNS}), m as (select user_id, (train[1] - train[-1]) / (train[1] + 1e-8) as tr, (test[1] - test[-1]) / (test[1] + 1e-8) as te, list_stddev_pop(test) as v, abs(train[-1] - test[-1]) as g from r where len(train) >= 2)
    select user_id, round(tr, 6) as train_improvement, round(te, 6) as test_improvement, round(v, 6) as volatility, round(g, 6) as overfit_gap, round(te - 2 * v - g, 6) as score from m""")
def r11(spark, d):
    m = _runs(spark, d).select("user_id", raster.loss_metrics(F.col("train"), F.col("test")).alias("m")).where("m is not null").select("user_id", "m.*")
    return m.select("user_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "user_id"])


@query("w6_best_epoch", f"select user_id, list_position(test, list_min(test))::bigint as epoch from ({_RUNS})")
def w6(spark, d):
    return _runs(spark, d).select("user_id", raster.best_epoch(F.col("test")).alias("epoch"))


@query("s8_s9_parsed_lists", f"select user_id, round(list_sum(list_transform(train, lambda x: round(x, 3))), 3) as total, 2 as bands from ({_RUNS})")
def s9(spark, d):
    from gridloom.functions.text import listed_texts, unquoted_list

    written = _runs(spark, d).select("user_id", F.concat(F.lit("['"), F.concat_ws("', '", F.transform("train", lambda x: F.round(x, 3).cast("string"))), F.lit("']")).alias("t"), F.lit("['ndvi', 'rgb']").alias("b"))
    return written.select("user_id", F.round(F.aggregate(unquoted_list(F.col("t")), F.lit(0.0), lambda s, x: s + x), 3).alias("total"), F.size(listed_texts(F.col("b"))).alias("bands"))


@query("x3_x4_methods")
def registry(spark, d):
    return spark.createDataFrame([(k, v.__name__) for k, v in imputation.METHODS.items()], "name string, method string")


@query("o5_a26_error_of_mean", "with t as (select p_partkey as row_id, cast(p_size as double) as v from part), m as (select avg(v) as m, max(v) - min(v) as r from t) select round(least(sqrt(avg((v - m) * (v - m))) / max(r), 1), 6) as error from t, m")
def mean_error(spark, d):
    t = table(spark, d, "part").select(F.col("p_size").cast("double").alias("v"))
    m = t.agg(F.avg("v").alias("m"))
    return stats.imputation_error(t.crossJoin(F.broadcast(m)), "v", "m").select(F.round("error", 6).alias("error"))
