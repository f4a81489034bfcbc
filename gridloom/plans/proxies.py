"""The driver's tables in the roles of surveys, places, rasters, collections and logs; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.tables import table


def households(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus"])
    return rows.select(F.col("l_suppkey").alias("hv001"), F.col("l_quantity").alias("hv005"), F.col("l_extendedprice").alias("wealth_index"), F.year("l_shipdate").alias("hv007"), "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")


HOUSEHOLDS = "select l_suppkey as hv001, l_quantity as hv005, l_extendedprice as wealth_index, cast(year(l_shipdate) as integer) as hv007, l_returnflag, l_linestatus, l_orderkey, l_linenumber from lineitem"


def places(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    return s.select(F.col("s_suppkey").alias("dhsclust"), (F.col("s_suppkey") * 7919 % 1000 * 100.0).alias("x"), (F.col("s_suppkey") * 104729 % 1000 * 100.0).alias("y"), F.when(F.col("s_nationkey") % 2 == 0, "U").otherwise("R").alias("urban_rura"))


PLACES = "select s_suppkey as dhsclust, cast(s_suppkey * 7919 % 1000 * 100 as double) as x, cast(s_suppkey * 104729 % 1000 * 100 as double) as y, case when s_nationkey % 2 = 0 then 'U' else 'R' end as urban_rura from supplier"


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Yearly label and coverage of cells."""
    o = table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    p = o.groupBy(F.col("o_custkey").alias("cell_id"), F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 1e5).alias("weighted_wealth"))
    return p.withColumn("coverage_percent", F.pmod(F.col("cell_id") * 37, F.lit(101)).cast("double"))


PANEL = "select o_custkey as cell_id, cast(year(o_orderdate) as integer) as year, avg(o_totalprice) / 1e5 as weighted_wealth, cast(o_custkey * 37 % 101 as double) as coverage_percent from orders group by 1, 2"


def bands(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 rasters."""
    e = table(spark, d, "embeddings", ["vec_id", "embedding"])
    return e.select(F.col("vec_id").alias("cell_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda x: x.cast("double")).alias("data"))


BANDS = "select vec_id as cell_id, list_transform(embedding, lambda v: cast(v as double)) as data from embeddings"


def images(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.select(F.col("user_id").alias("cell_id"), F.col("event_id").alias("image_id"), "ts", F.col("value").alias("cloud_pct"), F.col("event_type").alias("band"))


IMAGES = "select user_id as cell_id, event_id as image_id, ts, value as cloud_pct, event_type as band from events"
#: Days of a month take the place of months: the tables cover one month.
MONTH = "cast(day(ts) % 6 as integer)"


def grid_cells(spark: SparkSession) -> DataFrame:
    from gridloom.operators.grid import grid_anchored

    bounds = spark.sql("select 0.0D as x0, 0.0D as y0, 100000.0D as x1, 100000.0D as y1")
    return grid_anchored(bounds, 5000.0).withColumn("cell_id", F.col("i") * 20 + F.col("j"))


GRID = "select i * 20 + j as cell_id, i, j, i * 5000.0 as x0, j * 5000.0 as y0, (i + 1) * 5000.0 as x1, (j + 1) * 5000.0 as y1 from (select unnest(range(20)) as i) a, (select unnest(range(20)) as j) b"
