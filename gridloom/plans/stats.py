"""Queries for statistics, regressions and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import numbers
from gridloom.operators import label, stats
from gridloom.plans import proxies as P
from gridloom.plans._registry import Registry
from gridloom.sources.tables import table

query = Registry()


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("a8_summary", "select o_orderpriority, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as min, max(o_totalprice) as max, round(median(o_totalprice), 4) as median, round(stddev_samp(o_totalprice), 4) as std, count(o_totalprice) as n from orders group by 1")
def a8(spark, d):
    return rounded(stats.summary(table(spark, d, "orders"), "o_totalprice", ("o_orderpriority",)), "mean", "median", "std", digits=4)


@query("a8_summary_cube", "select o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) as mean, count(o_totalprice) as n, cast(grouping_id(o_orderpriority, o_orderstatus) as integer) as level from orders group by cube (o_orderpriority, o_orderstatus)")
def a8_cube(spark, d):
    return rounded(stats.summary_sets(table(spark, d, "orders"), "o_totalprice", ("o_orderpriority", "o_orderstatus")), "mean", digits=4)


@query("a9_value_range", "select coalesce(min(s_acctbal), 0) as global_min, coalesce(max(s_acctbal), 1) as global_max from supplier")
def a9(spark, d):
    return stats.value_range(table(spark, d, "supplier"), "s_acctbal")


_SWEEPS = f"""select step, 30.0 + step * 0.25 as threshold, year, count(case when coverage_percent >= 30 + step * 0.25 then 1 end) * 100.0 / count(*) as percent_cells_labelled,
    case when year % 3 <> 0 then year % 7 / 8.0 end as moran_i, 0.001 as moran_p, (step + 1) / 64.0 as interval_width from ({P.PANEL}) c, (select unnest(range(5)) as step) s group by step, year"""


@query("a10_aggregated_sweeps", f"""select step, min(threshold) as threshold, count(*) as num_years, round(avg(percent_cells_labelled), 6) as percent_cells, round(min(percent_cells_labelled), 6) as percent_cells_min, round(max(percent_cells_labelled), 6) as percent_cells_max,
    round(avg(moran_i), 6) as moran_i, min(moran_i) as moran_i_min, max(moran_i) as moran_i_max, round(avg(moran_p), 6) as moran_p, avg(interval_width) as interval_width, min(interval_width) as interval_width_min, max(interval_width) as interval_width_max from ({_SWEEPS}) group by step""")
def a10(spark, d):
    rows = P.panel(spark, d).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("threshold", 30.0 + F.col("step") * 0.25)
    rows = rows.groupBy("step", "threshold", "year").agg((F.count_if(F.col("coverage_percent") >= F.col("threshold")) * 100.0 / F.count("*")).alias("percent_cells_labelled"))
    rows = rows.select("step", "threshold", "percent_cells_labelled", F.when(F.col("year") % 3 != 0, F.col("year") % 7 / 8.0).alias("moran_i"), F.lit(0.001).alias("moran_p"), ((F.col("step") + 1) / 64.0).alias("interval_width"))
    return rounded(stats.aggregated_sweeps(rows), "percent_cells", "percent_cells_min", "percent_cells_max", "moran_i", "moran_p")


# Student's quantile by halving angles: |T| <= sqrt(df) * tan(x) has the probability of a finite series in sin(x) and cos(x), one for even and one for odd df.
_INSIDE = """case when df % 2 = 0 then sin((lo + hi) / 2) * list_sum(list_transform(range(df // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos((lo + hi) / 2), 2 * j)))
    else 2 / pi() * ((lo + hi) / 2 + sin((lo + hi) / 2) * coalesce(list_sum(list_transform(range((df - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos((lo + hi) / 2), 2 * j + 1))), 0)) end"""


@query("a11_mean_interval", f"""with recursive g as (select c_nationkey, c_mktsegment, count(c_acctbal) as n, avg(c_acctbal) as m, stddev_samp(c_acctbal) as s from customer group by 1, 2),
    q as (select distinct n - 1 as df, 0.0::double as lo, pi() / 2 as hi, 0 as step from g where n > 1
        union all select df, case when p < 0.95 then (lo + hi) / 2 else lo end, case when p < 0.95 then hi else (lo + hi) / 2 end, step + 1 from (select *, {_INSIDE} as p from q where step < 52)),
    h as (select g.*, case when s > 0 then sqrt(df) * tan((lo + hi) / 2) * s / sqrt(n) end as h from g left join q on df = n - 1 and step = 52)
    select c_nationkey, c_mktsegment, n, round(m, 4) as mean, round(m - h, 4) as lower, round(m + h, 4) as upper, round(2 * h, 4) as width from h""")
def a11(spark, d):
    got = stats.mean_interval(table(spark, d, "customer"), "c_acctbal", ("c_nationkey", "c_mktsegment"))
    return rounded(got, "mean", "lower", "upper", "width", digits=4)


def _pixels(spark, d):
    return P.bands(spark, d).select("cell_id", F.posexplode("data").alias("pos", "value")).select("cell_id", F.floor(F.col("pos") / 8).alias("i"), (F.col("pos") % 8).alias("j"), "value")


_PIXELS = f"select cell_id, (p - 1) // 8 as i, (p - 1) % 8 as j, data[p] as value from (select cell_id, data, unnest(range(1, 65)) as p from ({P.BANDS}))"


@query("a12_moran_i", f"""with p as ({_PIXELS}), z as (select *, value - avg(value) over (partition by cell_id) as z from p),
    l as (select a.cell_id, a.i, a.j, a.z, avg(b.z) as lag from z a join z b on a.cell_id = b.cell_id and abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and (a.i <> b.i or a.j <> b.j) group by 1, 2, 3, 4)
    select cell_id, count(*) as n, round(count(*) * sum(z * lag) / (count(lag) * sum(z * z)), 6) as moran_i from l group by cell_id""")
def a12(spark, d):
    return rounded(stats.moran_i(_pixels(spark, d), "value", ("cell_id",)), "moran_i")


@query("a12_moran_permutation")
def a12_p(spark, d):
    return stats.moran_permutation(_pixels(spark, d), "value", ("cell_id",))


_YEARS = f"select cell_id, year, weighted_wealth from ({P.PANEL})"


@query("a13_m13_ols_per_cell", f"""select cell_id, n, round(slope, 8) as slope, round(intercept + slope * 2024, 4) as prediction from
    (select cell_id, count(*) as n, regr_slope(weighted_wealth, year) as slope, regr_intercept(weighted_wealth, year) as intercept from ({_YEARS}) where year <> 1998 group by cell_id) where n >= 2""")
def a13(spark, d):
    got = stats.group_forecast(P.panel(spark, d), "cell_id", "year", "weighted_wealth", 2024, (1998,))
    return got.select("cell_id", "n", F.round("slope", 8).alias("slope"), F.round("prediction", 4).alias("prediction"))


@query("a13_a14_ols_of_means", f"with m as (select year, avg(weighted_wealth) as y from ({_YEARS}) group by year) select round(regr_slope(y, year), 6) as slope, round(regr_r2(y, year), 6) as r2, count(*) as n from m")
def a14(spark, d):
    means = P.panel(spark, d).groupBy("year").agg(F.avg("weighted_wealth").alias("y"))
    return rounded(stats.ols(means, "year", "y"), "slope", "r2").select("slope", "r2", "n")


@query("j2_a15_forecast_errors", """with p as (select o_orderkey, o_totalprice as a, o_totalprice * (0.9 + o_orderkey % 5 / 20.0) as p from orders)
    select round(100 * avg(abs(a - p) / abs(a)), 6) as mape, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 6) as r2, count(*) as n from p""")
def a15(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    forecast = o.select("o_orderkey", (F.col("o_totalprice") * (0.9 + F.col("o_orderkey") % 5 / 20.0)).alias("p"))
    return rounded(stats.errors(o.join(forecast, "o_orderkey"), "o_totalprice", "p"), "mape", "r2")


_Q = "(select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem)"


@query("a16_f17_fence", f"select round(a, 4) as q1, round(b, 4) as q3, round(a - 2 * (b - a), 4) as low, round(b + 2 * (b - a), 4) as high from {_Q}")
def a16(spark, d):
    return rounded(stats.quartile_fence(table(spark, d, "lineitem", ["l_extendedprice"]), "l_extendedprice"), "q1", "q3", "low", "high", digits=4)


@query("f15_f16_clip_and_scale", f"""with c as (select l_orderkey, l_linenumber, least(greatest(l_extendedprice, a - 0.25 * (b - a)), b + 0.25 * (b - a)) as x from lineitem, {_Q} q)
    select l_orderkey, l_linenumber, round((x - min(x) over ()) / (max(x) over () - min(x) over ()), 6) as x from c""")
def f16(spark, d):
    x = stats.fence_clipped(table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"]), "l_extendedprice", 0.25)
    ends = x.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return x.crossJoin(F.broadcast(ends)).select("l_orderkey", "l_linenumber", F.round(numbers.unit_scale(F.col("l_extendedprice"), F.col("lo"), F.col("hi")), 6).alias("x"))


@query("f18_z_scores", "select s_suppkey, round((s_acctbal - avg(s_acctbal) over ()) / stddev_pop(s_acctbal) over (), 6) as z from supplier")
def f18(spark, d):
    s = table(spark, d, "supplier", ["s_suppkey", "s_acctbal"])
    m = s.agg(F.avg("s_acctbal").alias("m"), F.stddev_pop("s_acctbal").alias("sd"))
    return s.crossJoin(F.broadcast(m)).select("s_suppkey", F.round(numbers.z_score(F.col("s_acctbal"), F.col("m"), F.col("sd")), 6).alias("z"))


@query("a17_correlations", "select 'l_quantity' as \"column\", round(corr(l_quantity, l_extendedprice), 6) as r from lineitem union all select 'l_discount', round(corr(l_discount, l_extendedprice), 6) from lineitem")
def a17(spark, d):
    return rounded(stats.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"), "r")


@query("a24_pivot_mean", "select o_orderpriority, round(avg(case when o_orderstatus = 'F' then o_totalprice end), 4) as f, round(avg(case when o_orderstatus = 'O' then o_totalprice end), 4) as o from orders group by 1")
def a24(spark, d):
    got = stats.pivot_mean(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O"])
    return got.select("o_orderpriority", F.round("F", 4).alias("f"), F.round("O", 4).alias("o"))


@query("a25_weighted_score", "select p_brand, round(coalesce(sum(p_size / 64.0 * (p_partkey % 5)) / nullif(sum(p_partkey % 5), 0), 0), 6) as score, sum(p_partkey % 5)::bigint as missing from part group by 1")
def a25(spark, d):
    rows = table(spark, d, "part").select("p_brand", (F.col("p_size") / 64.0).alias("s"), (F.col("p_partkey") % 5).alias("m"))
    return rounded(stats.weighted_score(rows, "s", "m", ("p_brand",)), "score")


@query("a26_imputation_errors", "select round(least(sqrt(avg((p_size - g) * (p_size - g))) / (max(p_size) - min(p_size)), 1), 6) as numeric_error, round(avg(case when p_brand is distinct from b then 1.0 else 0 end), 6) as category_error from (select *, p_size + p_partkey % 3 as g, case when p_partkey % 4 = 0 then 'x' else p_brand end as b from part)")
def a26(spark, d):
    rows = table(spark, d, "part").select("p_size", "p_brand", (F.col("p_size") + F.col("p_partkey") % 3).alias("g"), F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(F.col("p_brand")).alias("b"))
    a, b = stats.imputation_error(rows, "p_size", "g"), stats.imputation_error(rows, "p_brand", "b", "categorical")
    return a.select(F.round("error", 6).alias("numeric_error")).crossJoin(b.select(F.round("error", 6).alias("category_error")))


@query("a31_histogram", "with e as (select min(l_quantity) as lo, (max(l_quantity) - min(l_quantity)) / 20 as w from lineitem) select cast(least(19, floor((l_quantity - lo) / w)) as integer) as bin, count(*) as n from lineitem, e group by 1")
def a31(spark, d):
    return stats.histogram(table(spark, d, "lineitem", ["l_quantity"]), "l_quantity", 20)


@query("p14_within_sigmas", "select l_orderkey, l_linenumber from lineitem, (select avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as s from lineitem) where abs(l_extendedprice - m) <= 1.5 * s")
def p14(spark, d):
    return stats.within_sigmas(table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"]), "l_extendedprice", 1.5).select("l_orderkey", "l_linenumber")


@query("w10_shares", "select o_orderpriority, round(count(*) / sum(count(*)) over (), 6) as share from orders group by 1")
def w10(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return stats.shares(counts, "n").select("o_orderpriority", F.round("share", 6).alias("share"))


@query("w8_drawn_categories", """with f as (select o_orderpriority as v, count(*) / sum(count(*)) over () as p from orders group by 1), c as (select v, sum(p) over (order by v) as hi, row_number() over (order by v desc) as last from f),
    d as (select v, coalesce(lag(hi) over (order by v), 0) as lo, case when last = 1 then 2 else hi end as hi from c) select c_custkey, v from customer join d on (c_custkey * 7919 % 1000 + 0.5) / 1000 >= lo and (c_custkey * 7919 % 1000 + 0.5) / 1000 < hi""")
def w8(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("v")).agg(F.count("*").alias("n"))
    points = table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 1000 + 0.5) / 1000).alias("u"))
    return stats.drawn_categories(stats.shares(counts, "n", "p"), "v", "p", points, "u").select("c_custkey", "v")


@query("w3_w4_request_rates", """with r as (select user_id, event_id, ts, (row_number() over w - lag(row_number() over w) over w) as x from events window w as (partition by user_id order by ts, event_id)),
    c as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
    q as (select *, (k - lag(k) over w) * 60.0 / nullif((epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6, 0) as rate from c window w as (partition by user_id order by ts, event_id))
    select event_id, round(rate, 6) as rate, round(avg(rate) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 6) as mean_rate from q""".replace("with r as (select user_id, event_id, ts, (row_number() over w - lag(row_number() over w) over w) as x from events window w as (partition by user_id order by ts, event_id)),\n    c as", "with c as"))
def w3(spark, d):
    e = table(spark, d, "events", ["user_id", "event_id", "ts"])
    rows = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return stats.request_rates(rows, ("user_id",), "ts", "k", "event_id").select("event_id", F.round("rate", 6).alias("rate"), F.round("mean_rate", 6).alias("mean_rate"))


@query("w5_j13_last_match", "select user_id, arg_max(event_id, (ts, event_id)) as event_id from events where event_type = 'purchase' group by 1")
def w5(spark, d):
    from gridloom.operators.integrity import last_match

    rows = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return last_match(rows, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id")


@query("a19_running_tracker", "select label, min(v) as min, max(v) as max, round(sum(v), 4) as sum, count(v) as count from (select label, unnest(list_transform(embedding, lambda v: cast(v as double))) as v from embeddings) group by label")
def a19(spark, d):
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return rounded(stats.running_tracker(e, F.col("v"), ("label",)).drop("mean"), "sum", digits=4).withColumn("count", F.col("count").cast("bigint"))


@query("o1_o2_top_runs", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def o2(spark, d):
    return table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("f23_weighted_components", "select vec_id, round((2 * cast(embedding[1] as double) - cast(embedding[2] as double) + 0.5 * cast(embedding[3] as double)) / 3.5, 6) as x from embeddings")
def f23(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("p"))
    return e.select("vec_id", F.round(numbers.weighted_components(F.col("p"), F.array(F.lit(2.0), F.lit(-1.0), F.lit(0.5))), 6).alias("x"))
