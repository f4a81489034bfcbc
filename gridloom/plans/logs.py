"""Queries on failure logs, repair, sources and sinks, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import raster
from gridloom.operators import integrity
from gridloom.plans import proxies as P
from gridloom.plans._registry import Registry
from gridloom.sources import formats, tables
from gridloom.sources.shared import shared_path
from gridloom.sources.tables import table
from gridloom.streaming import monitor

query = Registry()


_CELL = "case event_id % 11 when 0 then 'global' when 1 then 'batch_0_500' when 2 then null else cast(user_id as varchar) end"


def _log(spark, d):
    e = F.col("event_id") % 11
    return table(spark, d, "events").select("ts", "event_id", F.when(e == 0, "global").when(e == 1, "batch_0_500").when(e == 2, None).otherwise(F.col("user_id").cast("string")).alias("cell_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("error_type"), (F.col("value") > 200).alias("success"), "value")


_LOG = f"select ts, event_id, {_CELL} as cell_id, case when event_type <> 'view' then event_type end as error_type, value > 200 as success, value from events"


@query("p16_p7_failed_cells", f"select distinct try_cast(cell_id as integer) as cell_id from ({_LOG}) where cell_id is not null and cell_id <> 'global' and not starts_with(cell_id, 'batch')")
def p16(spark, d):
    return integrity.failed_cells(_log(spark, d))


@query("p7_rows_of_failed_cells", "select c_custkey from customer where c_custkey in (select user_id from events where event_type = 'error')")
def p7(spark, d):
    failed = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer", ["c_custkey"]).join(failed, "c_custkey", "left_semi")


_FAILURES = f"select coalesce(error_type, 'unknown') as error_type, count(*) as n from ({_LOG}) group by 1"


@query("a20_failure_summary", _FAILURES)
def a20(spark, d):
    return integrity.failure_summary(_log(spark, d))


@query("a21_repair_summary", f"select coalesce(error_type, 'unknown') as error_type, count(success) as attempts, sum(success::int)::bigint as successes, printf('%.1f%%', 100.0 * sum(success::int) / count(success)) as success_rate from ({_LOG}) group by 1")
def a21(spark, d):
    return integrity.repair_summary(_log(spark, d), "error_type")


@query("a22_status_counts", "select user_id, count(*) as total, sum((event_type = 'error')::int)::bigint as error, sum((event_type = 'click')::int)::bigint as click from events group by 1")
def a22(spark, d):
    return integrity.status_counts(table(spark, d, "events"), "event_type", ["error", "click"], ("user_id",))


@query("a23_request_counts", "select sum(n)::bigint as total, round(avg(n), 6) as mean_per_cell, max(n) as most_of_a_cell from (select user_id, count(*) as n from events group by 1)")
def a23(spark, d):
    return integrity.request_counts(table(spark, d, "events"), "user_id").withColumn("mean_per_cell", F.round("mean_per_cell", 6))


@query("a33_column_timings", "select event_type, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds, count(*) as entries from events group by 1")
def a33(spark, d):
    return integrity.column_timings(table(spark, d, "events"), "event_type", "ts")


@query("s22_unfinished", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def s22(spark, d):
    return integrity.unfinished(table(spark, d, "documents", ["doc_id"]), table(spark, d, "labels"), ["doc_id"])


@query("u4_t8_repaired", "select distinct user_id from events where event_type = 'error' except select user_id from events where event_type = 'error' and value > 400")
def u4(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return integrity.repaired(e, e.where("value > 400"), ["user_id"])


@query("p17_p18_scan_problems", """select vec_id as cell_id, case when vec_id % 5 = 0 then ['b'] else []::varchar[] end as missing, case when vec_id % 7 = 0 then ['a'] else []::varchar[] end as blank from embeddings where vec_id % 5 = 0 or vec_id % 7 = 0""")
def p17(spark, d):
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("cell_id"), F.lit("a").alias("band"), F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("data"))
    b = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("cell_id"), F.lit("b").alias("band"), F.col("embedding").alias("data"))
    return integrity.scan_problems(a.union(b), ["cell_id"], ["a", "b"])


@query("p18_missing_bands", "select vec_id, 2 - (vec_id % 3)::bigint as missing from embeddings")
def p18(spark, d):
    have = F.slice(F.array(F.lit("rgb"), F.lit("ndvi")), F.lit(1), (F.col("vec_id") % 3).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.size(raster.missing_bands(["rgb", "ndvi"], have)).cast("bigint").alias("missing"))


@query("s10_s21_json_lines", f"select cell_id, count(*) as n from ({_LOG}) where cell_id is not null or error_type is not null group by 1")
def s10(spark, d):
    path = shared_path(spark, "failures")
    rows = _log(spark, d).select("cell_id", "error_type")
    integrity_rows = rows.where("cell_id is not null or error_type is not null")
    tables.append_failures(integrity_rows, path)
    spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(path)
    return tables.failure_log(spark, path).groupBy("cell_id").agg(F.count("*").alias("n"))


@query("s15_s16_panel_sink", f"select year, count(*) as n from ({P.PANEL}) group by 1")
def s16(spark, d):
    path = shared_path(spark, "panel")
    tables.write_panel(P.panel(spark, d).withColumn("country", F.lit("SN")), path)
    return tables.surveys(spark, path).groupBy("year").agg(F.count("*").alias("n"))


@query("s8_s17_csv_round_trip", "select s_suppkey as k, s_acctbal as v_a, s_nationkey as v_b from supplier")
def s17(spark, d):
    path = shared_path(spark, "csv")
    tables.write_flat_csv(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.struct(F.col("s_acctbal").alias("a"), F.col("s_nationkey").alias("b")).alias("v")), path)
    return tables.read_csv(spark, path, "k bigint, v_a double, v_b int")


@query("s19_metadata", "select count(*) as years from (select distinct year(o_orderdate) from orders)")
def s19(spark, d):
    rows = P.panel(spark, d).groupBy("year").agg(F.round(F.avg("weighted_wealth"), 6).alias("mean")).agg(F.sort_array(F.collect_list(F.struct("year", "mean"))).alias("years"))
    text = rows.select(tables.metadata_text("years").alias("j"))
    return text.select(F.size(F.from_json("j", "years array<struct<year:int,mean:double>>")["years"]).cast("bigint").alias("years"))


@query("s20_run_log_append", "select user_id, count(*) * 2 as n from events where event_type = 'purchase' group by 1")
def s20(spark, d):
    path = shared_path(spark, "runs")
    rows = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "value")
    for _ in range(2):
        tables.append_runs(rows, path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


@query("s26_file_catalog", "select 2010 + cast(g as integer) as year, concat('x_', 2010 + g, '_labelled') as labelled, case when g % 2 = 0 then concat('x_', 2010 + g, '_labelled_inferred') end as inferred from (select unnest(range(8)) as g)")
def s26(spark, d):
    g = spark.range(8).select(F.explode(F.array(F.concat(F.lit("x_"), (F.col("id") + 2010).cast("string"), F.lit("_labelled")), F.when(F.col("id") % 2 == 0, F.concat(F.lit("x_"), (F.col("id") + 2010).cast("string"), F.lit("_labelled_inferred"))))).alias("name"))
    return tables.file_catalog(g.where("name is not null"))


@query("s7_s25_geojson_round_trip", "select s_suppkey as id from supplier")
def s7(spark, d):
    path = shared_path(spark, "geojson")
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1))])
    f = table(spark, d, "supplier").select("s_suppkey", tables.geojson_text(ring, F.col("s_suppkey").alias("id")).alias("f"))
    tables.write_collections(f, "f", F.col("s_suppkey"), path)
    return tables.geojson(spark, path, "id:bigint", lines=True).select("id")


def _stream(spark, d):
    """The events as a stream of files."""
    return monitor.log_stream(spark, f"{d}/events.parquet", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", "parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_failure_stream", "select event_type, count(*) as n from events group by 1")
def t1(spark, d):
    return monitor.drained(monitor.failure_counts(_stream(spark, d), "event_type"), f"t1_{uuid.uuid4().hex[:8]}")


@query("t2_sliding_windows", """select start, start + interval 75 second as "end", count(*) as n, count(*) * 60.0 / 75 as per_minute from (select unnest(list_transform(range(5), lambda k: to_timestamp(floor(epoch(ts) / 15) * 15 - k * 15)::timestamp)) as start from (select ts at time zone 'UTC' as ts0, ts from events)) group by 1""")
def t2(spark, d):
    return monitor.drained(monitor.request_windows(_stream(spark, d)), f"t2_{uuid.uuid4().hex[:8]}")


_SESSIONS = """with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 6 hour then 1 else 0 end as f from events window w as (partition by user_id order by ts)), s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as s from g)
    select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as events from s group by user_id, s"""


@query("t3_activity_sessions", _SESSIONS)
def t3(spark, d):
    return monitor.activity_sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", gap="6 hours")


@query("t3_activity_session_stream", _SESSIONS)
def t3_stream(spark, d):
    return monitor.drained(monitor.activity_sessions(_stream(spark, d), "user_id", gap="6 hours", late="60 days"), f"t3_{uuid.uuid4().hex[:8]}")


@query("t3_stalls", """with g as (select user_id, ts, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as d, event_id from events) select user_id, count(*) as stalls, round(max(d) / 1e6, 3) as longest from g where d > 43200000000 group by 1""")
def t3_stalls(spark, d):
    got = monitor.drained(monitor.stalls(_stream(spark, d), "user_id", "bigint", after=43200.0), f"t3s_{uuid.uuid4().hex[:8]}", "append")
    return got.groupBy("user_id").agg(F.count("*").alias("stalls"), F.round(F.max("seconds"), 3).alias("longest"))


@query("t4_running_ranges", "select event_type, min(value) as min, max(value) as max, round(sum(value), 4) as sum, count(value) as count from events group by 1")
def t4(spark, d):
    return monitor.drained(monitor.running_ranges(_stream(spark, d), "event_type"), f"t4_{uuid.uuid4().hex[:8]}").withColumn("sum", F.round("sum", 4))


@query("t6_t7_once_only", "select distinct user_id from events where user_id is not null")
def t7(spark, d):
    return monitor.drained(monitor.without_repeats(_stream(spark, d).select("user_id", "ts"), ["user_id"], late="60 days"), f"t7_{uuid.uuid4().hex[:8]}", "append").select("user_id")


@query("t5_flushed_progress", "select count(*) as n from events")
def t5(spark, d):
    out, checkpoint = shared_path(spark, "progress"), shared_path(spark, "progress-state")
    stream = _stream(spark, d).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    for _ in range(2):  # a restart finds nothing new and writes nothing twice
        stream.start().awaitTermination()
    return spark.read.schema("event_id bigint").parquet(out).agg(F.count("*").alias("n"))


@query("s11_s18_npz", "select 0::bigint as n")
def s11(spark, d):
    """An empty folder of arrays gives no bands; files are covered by tests."""
    path = shared_path(spark, "arrays")
    spark.range(1).write.parquet(path)
    return formats.npz_bands(spark, path).agg(F.count("*").alias("n"))
