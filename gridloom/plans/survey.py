"""Queries on survey tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numbers, text
from gridloom.operators import survey
from gridloom.plans import proxies as P
from gridloom.plans._registry import Registry
from gridloom.sources.tables import checked, table

query = Registry()


@query("a1_cluster_means", f"select hv001, round(sum(hv005 * wealth_index) / sum(hv005), 4) as wealth_index, sum(hv005) as weight, min(hv007) as hv007 from ({P.HOUSEHOLDS}) group by hv001")
def a1(spark, d):
    return survey.cluster_means(P.households(spark, d), "hv001", "hv005", "wealth_index", "hv007").withColumn("wealth_index", F.round("wealth_index", 4))


@query("x1_weighted_mean", f"select hv007, round(sum(hv005 * wealth_index) / sum(hv005), 4) as mean from ({P.HOUSEHOLDS}) group by hv007")
def x1(spark, d):
    return P.households(spark, d).groupBy("hv007").agg(F.round(survey.weighted_mean(F.col("wealth_index"), F.col("hv005")), 4).alias("mean"))


@query("s1_projected_scan", "select l_orderkey, l_linenumber, l_quantity, 2019 as hv007 from lineitem where l_quantity > 49")
def s1(spark, d):
    return table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]).where("l_quantity > 49").withColumn("hv007", F.lit(2019))


@query("s2_partitioned_scan", "select count(*) as n, sum(o_totalprice > 1000)::bigint as large from orders")
def s2(spark, d):
    rows = spark.read.option("ignoreMissingFiles", "true").option("pathGlobFilter", "orders*.parquet").parquet(f"{d}/orders.parquet")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 1000).alias("large"))


@query("s3_s6_checked_scan", "select s_suppkey, s_nationkey from supplier where s_acctbal is not null")
def s3(spark, d):
    return checked(table(spark, d, "supplier"), ["s_suppkey", "s_acctbal"]).na.drop(subset=["s_acctbal"]).select("s_suppkey", "s_nationkey")


@query("p1_p2_projection", "select p_partkey as id, p_size as size, 'fixed' as label from part")
def p1(spark, d):
    return table(spark, d, "part").drop("p_name", "p_brand").withColumnRenamed("p_partkey", "id").withColumnRenamed("p_size", "size").withColumn("label", F.lit("fixed")).select("id", "size", "label")


@query("p3_prefix_and_year", "select o_orderkey, o_custkey from orders where substr(o_orderpriority, 1, 2) = '1-' and year(o_orderdate) = 1996")
def p3(spark, d):
    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return survey.survey_rows(rows, "1-", 1996, "o_orderpriority", "year").select("o_orderkey", "o_custkey")


@query("p4_drop_nulls", "select p_partkey, nullif(p_partkey % 10, 0) as m from part where p_partkey % 10 <> 0")
def p4(spark, d):
    return table(spark, d, "part", ["p_partkey"]).withColumn("m", F.nullif(F.col("p_partkey") % 10, F.lit(0))).na.drop(subset=["m"])


_MIXED = """select p_partkey as row_id, p_partkey % 7 as survey, cast(p_size as varchar) as size, case when p_partkey % 10 = 0 then null else p_brand end as brand,
    case when p_partkey % 3 <> 0 then null else p_type end as kind, case when p_partkey % 4 = 0 then 'unknown' when p_partkey % 4 = 1 then '95 or more' when p_partkey % 4 = 2 then '12.5' else 'Don''t Know' end as label,
    case when p_partkey % 5 = 0 then null else 'same' end as fixed from part"""
_MIXED_COLUMNS = ["size", "brand", "kind", "label", "fixed"]


def _mixed(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part", ["p_partkey", "p_size", "p_brand", "p_type"]).select(
        k.alias("row_id"), (k % 7).alias("survey"), F.col("p_size").cast("string").alias("size"), F.when(k % 10 != 0, F.col("p_brand")).alias("brand"), F.when(k % 3 == 0, F.col("p_type")).alias("kind"),
        F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "95 or more").when(k % 4 == 2, "12.5").otherwise("Don't Know").alias("label"), F.when(k % 5 != 0, "same").alias("fixed"),
    )


_LONG = f"select * from ({_MIXED}) unpivot include nulls (value for col in (size, brand, kind, label, fixed))"
_PROFILE = f"""
    select col as "column", count(*) as "rows", count(*) - count(value) as nulls, round((count(*) - count(value)) / count(*), 6) as null_share, count(distinct value) as distinct_values,
        count(distinct value) = 1 and count(value) < count(*) as constant_with_nulls,
        case when count(value) > 0 and count(value) = count(try_cast(value as double)) and (count(value) = count(case when try_cast(value as double) = floor(try_cast(value as double)) then 1 end)
            or count(distinct try_cast(value as double)) / count(value) > 0.5) then 'numeric' else 'categorical' end as type_by_values,
        case when count(value) = count(try_cast(value as double)) then 'numeric' else 'categorical' end as type_by_parsing
    from ({_LONG}) group by col"""


@query("a4_a5_a30_f8_f9_profile", _PROFILE)
def profile(spark, d):
    return survey.profile(_mixed(spark, d), _MIXED_COLUMNS).withColumn("null_share", F.round("null_share", 6))


@query("a4_profile_by_survey", f"select survey, col as \"column\", count(*) - count(value) as nulls, count(distinct value) as distinct_values from ({_LONG}) group by 1, 2")
def profile_by(spark, d):
    return survey.profile(_mixed(spark, d), _MIXED_COLUMNS, ["survey"]).select("survey", "column", "nulls", "distinct_values")


@query("p11_sparse_columns", f"select row_id, survey, size, brand, label, fixed from ({_MIXED})")
def p11(spark, d):
    return survey.without_sparse_columns(_mixed(spark, d), _MIXED_COLUMNS)


@query("a6_frequencies", f"select brand, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from ({_MIXED}) where brand is not null group by brand")
def a6(spark, d):
    return survey.frequencies(_mixed(spark, d), "brand").withColumn("share", F.round("share", 6))


_MODE = "(select {c} from t where {c} is not null group by 1 order by count(*) desc, 1 limit 1)"


@query("a7_smallest_mode", f"with t as ({_MIXED}) select " + ", ".join(f"{_MODE.format(c=c)} as {c}" for c in ("size", "brand", "kind")))
def a7(spark, d):
    return survey.smallest_mode(_mixed(spark, d), ["size", "brand", "kind"])


@query("m1_initial_fill", f"with t as ({_MIXED}), m as (select avg(try_cast(size as double)) as s from t where row_id % 6 <> 0) select row_id, coalesce(case when row_id % 6 <> 0 then cast(size as double) end, round(s, 6)) as size, coalesce(brand, {_MODE.format(c='brand')}) as brand from t, m")
def m1(spark, d):
    rows = _mixed(spark, d).select("row_id", F.when(F.col("row_id") % 6 != 0, F.col("size").cast("double")).alias("size"), "brand")
    return survey.filled(rows, ["size"], ["brand"]).withColumn("size", F.round("size", 6))


@query("f4_f5_f6_j12_cleaning", f"""select row_id, case when label in ('unknown', 'don''t know', 'Don''t know', 'DON''T KNOW') then null else label end as label,
    case brand when 'Brand#11' then 'roof' when 'Brand#12' then 'wall' else brand end as brand from ({_MIXED})""")
def cleaning(spark, d):
    return survey.cleaned(_mixed(spark, d), ["label", "brand"], {"brand": {"Brand#11": "roof", "Brand#12": "wall"}}).select("row_id", "label", "brand")


@query("f5_numeric_labels", f"select row_id, case when label in ('unknown') then null when label = '95 or more' then '95' else label end as label from ({_MIXED})")
def f5(spark, d):
    return survey.cleaned(_mixed(spark, d), ["label"], numeric_labels=True).select("row_id", "label")


@query("f7_f10_typed_values", f"select row_id, try_cast(label as double) as parsed, cast(round(try_cast(label as double) + 0.1) as integer) as whole, cast(try_cast(label as double) as varchar) as shown from ({_MIXED})")
def f7(spark, d):
    x = numbers.safe_number(F.col("label"))
    return _mixed(spark, d).select("row_id", x.alias("parsed"), text.typed(x + 0.1, "int").alias("whole"), text.typed(x, "string").alias("shown"))


@query("f1_country_year", "select doc_id, 'Senegal' as country, 2010 + cast(substr(source, 4) as integer) % 10 as year from documents")
def f1(spark, d):
    name = F.concat(F.lit("sg"), (2010 + F.substring("source", 4, 9).cast("int") % 10).cast("string"))
    country, year = text.country_year(name)
    return table(spark, d, "documents", ["doc_id", "source"]).select("doc_id", country.alias("country"), year.alias("year"))


@query("f2_f3_f11_names", """select page_id, try_cast(nullif(regexp_extract(n, '(20\\d{2})', 1), '') as integer) as year, case when contains(n, 'inferred') then 'inferred' when contains(n, 'labelled') then 'labelled' end as kind,
    split_part(n, '_', 1) as country, printf('%.1f%%', page_id / 7.0) as shown from (select page_id, case when page_id % 3 = 0 then 'Ghana_2022_labelled' when page_id % 3 = 1 then 'Senegal_2016_labelled_inferred' else 'other' end as n from pages)""")
def f2(spark, d):
    n = F.when(F.col("page_id") % 3 == 0, "Ghana_2022_labelled").when(F.col("page_id") % 3 == 1, "Senegal_2016_labelled_inferred").otherwise("other")
    return table(spark, d, "pages", ["page_id"]).withColumn("n", n).select("page_id", text.year_in_name(F.col("n")).alias("year"), text.kind_in_name(F.col("n")).alias("kind"), text.part(F.col("n"), "_", 0).alias("country"), text.percent_text(F.col("page_id") / 7.0).alias("shown"))


@query("f24_asset_score", f"select hv001, sum((case when l_returnflag = 'A' then 1 else 0 end) + (case when l_linestatus = 'O' then 1 else 0 end))::bigint as assets from ({P.HOUSEHOLDS}) group by hv001")
def f24(spark, d):
    rows = P.households(spark, d).select("hv001", F.when(F.col("l_returnflag") == "A", "yes").alias("a"), F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("b"))
    return rows.groupBy("hv001").agg(F.sum(numbers.asset_score(F.col("a"), F.col("b"))).alias("assets"))


@query("j14_country_crs", "select n_name, case when n_name = 'GHANA' then 32630 when n_nationkey % 2 = 0 then 32628 else 4326 end as crs from nation")
def j14(spark, d):
    return table(spark, d, "nation").select("n_name", F.when(F.col("n_name") == "GHANA", 32630).when(F.col("n_nationkey") % 2 == 0, 32628).otherwise(4326).alias("crs"))


@query("u1_union_rows", "select s_suppkey as k, s_acctbal as v, null::varchar as segment from supplier union all select c_custkey, c_acctbal, c_mktsegment from customer")
def u1(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("u2_column_concat", "select doc_id, n_chars, quality from documents join labels using (doc_id)")
def u2(spark, d):
    return table(spark, d, "documents", ["doc_id", "n_chars"]).join(table(spark, d, "labels", ["doc_id", "quality"]), "doc_id")


@query("u3_common_keys", "select doc_id from documents intersect select doc_id from labels")
def u3(spark, d):
    return table(spark, d, "documents", ["doc_id"]).intersect(table(spark, d, "labels", ["doc_id"]))


@query("u5_distinct_keys", "select doc_id from documents union select doc_id from labels")
def u5(spark, d):
    return table(spark, d, "documents", ["doc_id"]).union(table(spark, d, "labels", ["doc_id"])).distinct()
