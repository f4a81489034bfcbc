"""Queries on image collections and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import dates, numbers, raster
from gridloom.operators import imagery, integrity
from gridloom.operators import rasters as kernels
from gridloom.plans import proxies as P
from gridloom.plans._registry import Registry
from gridloom.sources.tables import table

query = Registry()

_E = "list_transform(embedding, lambda v: cast(v as double))"
_WIDE = f"select vec_id, {_E}[1:16] as a, {_E}[17:32] as b, {_E}[33:48] as c, {_E}[49:64] as d from embeddings"


def _wide(spark, d):
    part = lambda i: F.transform(F.slice("embedding", 16 * i + 1, 16), lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", part(0).alias("a"), part(1).alias("b"), part(2).alias("c"), part(3).alias("d"))


@query("s13_p8_usable_images", f"select cell_id, image_id from ({P.IMAGES}) where ts >= date '2024-01-05' and ts < date '2024-01-20' and cloud_pct < 20")
def p8(spark, d):
    return imagery.usable_images(P.images(spark, d), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).select("cell_id", "image_id")


_RANKED = f"select cell_id, image_id, {P.MONTH} as month, row_number() over (partition by cell_id, {P.MONTH} order by cloud_pct, image_id) as rank from ({P.IMAGES})"


@query("w1_o3_least_cloudy", f"select cell_id, image_id, rank from ({_RANKED}) where rank <= 5")
def w1(spark, d):
    return imagery.selected_images(P.images(spark, d), "cell_id", F.expr(P.MONTH.replace("integer", "int")), "cloud_pct", "image_id", 5, 0).select("cell_id", "image_id", "rank")


@query("w1_w2_selected_images", f"""with r as ({_RANKED}), m as (select cell_id, month, greatest(count(*) - 5, 0) as extra, least(count(*), 5) as chosen from r group by 1, 2),
    t as (select *, greatest(45 - sum(chosen) over (partition by cell_id), 0) as need, coalesce(sum(extra) over (partition by cell_id order by extra desc, month rows between unbounded preceding and 1 preceding), 0) as before from m),
    k as (select cell_id, month, least(extra, greatest(need - before, 0)) as take from t) select cell_id, image_id, month, rank from r join k using (cell_id, month) where rank <= 5 + take""")
def w2(spark, d):
    return imagery.selected_images(P.images(spark, d), "cell_id", F.expr(P.MONTH.replace("integer", "int")), "cloud_pct", "image_id", 5, 45).select("cell_id", "image_id", "month", "rank")


@query("a18_median_composite", "select label, p - 1 as pos, round(median(v), 6) as value from (select label, p, cast(embedding[p] as double) as v from (select label, embedding, unnest(range(1, 65)) as p from embeddings)) group by 1, 2")
def a18(spark, d):
    rows = table(spark, d, "embeddings").select("label", "embedding")
    return imagery.composite(rows, ("label",), "embedding").select("label", F.posexplode("data").alias("pos", "value")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query("a18_mean_composite", "select label, p - 1 as pos, round(avg(v), 6) as value from (select label, p, cast(embedding[p] as double) as v from (select label, embedding, unnest(range(1, 65)) as p from embeddings)) group by 1, 2")
def a18_mean(spark, d):
    rows = table(spark, d, "embeddings").select("label", "embedding")
    return imagery.composite(rows, ("label",), "embedding", "mean").select("label", F.posexplode("data").alias("pos", "value")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query("p12_rescaled_bands", "select event_id, case when ts < timestamp '2024-01-10' and event_type in ('B2', 'B4') then value * 10000 else value end as value from (select event_id, ts, value, case event_type when 'view' then 'B2' when 'click' then 'B4' else 'QA' end as event_type from events)")
def p12(spark, d):
    band = F.when(F.col("event_type") == "view", "B2").when(F.col("event_type") == "click", "B4").otherwise("QA")
    rows = table(spark, d, "events").withColumn("band", band)
    return imagery.rescaled(rows, F.col("ts") < F.lit("2024-01-10").cast("timestamp")).select("event_id", "value")


@query("p9_p10_masks", f"""select vec_id, len(list_filter(list_zip(a, k), lambda p: p[2] not in (3, 8, 9, 10))) as by_class, len(list_filter(list_zip(a, k), lambda p: p[2] & 2 = 0 and p[2] & 8 = 0)) as by_bits
    from (select vec_id, a, list_transform(range(16), lambda i: cast((vec_id + i) % 12 as integer)) as k from ({_WIDE}))""")
def p9(spark, d):
    rows = _wide(spark, d).withColumn("k", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((F.col("vec_id") + i) % 12).cast("int")))
    left = lambda a: F.size(F.filter(a, lambda x: x.isNotNull())).cast("bigint")
    return rows.select("vec_id", left(raster.masked_by_class(F.col("a"), F.col("k"))).alias("by_class"), left(raster.masked_by_bits(F.col("a"), F.col("k"))).alias("by_bits"))


_ND = "least(greatest(case when p[1] + p[2] = 0 then 0 else (p[1] - p[2]) / (p[1] + p[2]) end, -1), 1)"


@query("r1_indices", f"select vec_id, round(list_sum(list_transform(list_zip(a, b), lambda p: {_ND})), 6) as ndvi, round(list_sum(list_transform(list_zip(c, a), lambda p: {_ND})), 6) as built_up from ({_WIDE})")
def r1(spark, d):
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    return _wide(spark, d).select("vec_id", total(raster.ndvi(F.col("a"), F.col("b"))).alias("ndvi"), total(raster.built_up(F.col("c"), F.col("a"))).alias("built_up"))


@query("f19_f20_quantized", f"""select vec_id, list_sum(list_transform(a, lambda v: cast(floor(least(greatest(v * 16384, 0), 3600) / 3600 * 255) as bigint)))::bigint as visible,
    list_sum(list_transform(b, lambda v: cast(floor((least(greatest(v, -1), 1) + 1) * 127.5) as bigint)))::bigint as index, list_sum(list_transform(c, lambda v: cast(floor(least(greatest(v * 16384, 0), 6000) / 6000 * 65535) as bigint)))::bigint as nir from ({_WIDE})""")
def f20(spark, d):
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    big = lambda c: F.transform(c, lambda v: v * 16384)
    return _wide(spark, d).select("vec_id", total(raster.quantized(big("a"), "visible")).alias("visible"), total(raster.quantized(F.col("b"), "index")).alias("index"), total(raster.quantized(big("c"), "nir", "uint16")).alias("nir"))


@query("f19_log_quantized", "select event_id, cast(floor(least(greatest(ln(1 + greatest(value, 0)) / 7, 0), 1) * 255) as integer) as light from events")
def f19(spark, d):
    return table(spark, d, "events", ["event_id", "value"]).select("event_id", numbers.log_quantize(F.col("value"), 0.0, 7.0, "uint8").alias("light"))


@query("f21_r5_r6_channels", f"select vec_id, round(list_sum(list_transform(a, lambda v: (v + 1) / (2 + 1e-8))), 6) as scaled, len(list_distinct(a)) as distinct_values, list_min(a) as least, list_max(a) as most, len(list_filter(a, lambda v: v <> 0)) = 0 as blank from ({_WIDE})")
def f21(spark, d):
    a = F.col("a")
    s = F.round(F.aggregate(raster.channel_scaled(raster.filled(a), -1.0, 1.0), F.lit(0.0), lambda x, y: x + y), 6)
    return _wide(spark, d).select("vec_id", s.alias("scaled"), raster.distinct_values(a).cast("bigint").alias("distinct_values"), F.array_min(a).alias("least"), F.array_max(a).alias("most"), raster.blank(a).alias("blank"))


@query("r2_r10_channel_order", f"select vec_id, unnest(range(48)) as k, unnest(list_concat(list_concat(a, b), c)) as first, unnest(flatten(list_transform(range(1, 17), lambda i: [a[i], b[i], c[i]]))) as last from ({_WIDE})")
def r2(spark, d):
    return _channels(_wide(spark, d))


def _channels(rows):
    three = [F.col(x) for x in "abc"]
    rows = rows.withColumn("z", F.arrays_zip(raster.channels_first(*three).alias("first"), F.flatten(raster.stacked(*three)).alias("last")))
    return rows.select("vec_id", F.posexplode("z").alias("k", "p")).select("vec_id", F.col("k").cast("bigint").alias("k"), "p.first", "p.last")


@query("r4_r8_gradient")
def r4(spark, d):
    rows = P.bands(spark, d).withColumn("data", F.transform("data", lambda v: v * 100))
    got = imagery.night_lights(rows, ["cell_id"])
    return got.select("cell_id", F.aggregate("gradient", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("gradient"), F.aggregate("nightlights", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("nightlights"))


@query("r4_gradient_kernel")
def r4_kernel(spark, d):
    return kernels.with_gradient(P.bands(spark, d)).select("cell_id", F.round(F.aggregate("gradient", F.lit(0.0), lambda s, x: s + x), 6).alias("gradient"))


@query("r3_resampled")
def r3(spark, d):
    return kernels.resampled(P.bands(spark, d), 16).select("cell_id", F.size("data").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_TURN = ", ".join(f"data[{(i % 8) * 8 + (7 - i // 8) + 1}]" for i in range(64))
_FLIP = ", ".join(f"data[{(i // 8) * 8 + (7 - i % 8) + 1}]" for i in range(64))


@query("r9_augmented", f"select cell_id, unnest(range(64)) as k, unnest([{_TURN}]) as turned, unnest([{_FLIP}]) as flipped from ({P.BANDS})")
def r9(spark, d):
    return _turned(P.bands(spark, d))


def _turned(rows):
    args = F.col("data"), F.col("height"), F.col("width")
    z = F.arrays_zip(raster.quarter_turn(*args).alias("turned"), raster.flipped(*args, horizontal=True).alias("flipped"))
    return rows.select("cell_id", F.posexplode(z).alias("k", "p")).select("cell_id", F.col("k").cast("bigint").alias("k"), "p.turned", "p.flipped")


def _bands_long(spark, d):
    rows = _wide(spark, d)
    names = F.create_map(*[F.lit(x) for kv in (("B2", 0), ("B3", 1), ("B4", 2), ("B8", 3), ("B11", 4), ("B12", 5)) for x in kv])
    parts = F.array(*[F.struct(F.lit(b).alias("band"), F.transform(c, lambda v: F.abs(v) * 8192).alias("data")) for b, c in (("B2", "a"), ("B3", "b"), ("B4", "c"), ("B8", "d"), ("B11", "a"), ("B12", "b"))])
    return rows.select(F.col("vec_id").alias("cell_id"), F.inline(parts)).where(~((F.col("cell_id") % 5 == 0) & (F.col("band") == "B11")) & names[F.col("band")].isNotNull())


@query("r7_processed_bands", "select vec_id as cell_id, unnest(case when vec_id % 5 = 0 then ['rgb', 'nir', 'swir2', 'ndvi'] else ['rgb', 'nir', 'swir1', 'swir2', 'ndvi', 'built_up'] end) as band from embeddings")
def r7(spark, d):
    return imagery.processed_bands(imagery.band_table(_bands_long(spark, d), ["cell_id"]), ["cell_id"]).select("cell_id", "band")


@query("r7_ndvi_sum", f"select vec_id as cell_id, list_sum(list_transform(list_zip(d, c), lambda p: cast(floor((case when abs(p[1]) + abs(p[2]) = 0 then 0 else (abs(p[1]) * 8192 - abs(p[2]) * 8192) / (abs(p[1]) * 8192 + abs(p[2]) * 8192) end + 1) * 127.5) as bigint)))::bigint as total from ({_WIDE})")
def r7_ndvi(spark, d):
    got = imagery.processed_bands(imagery.band_table(_bands_long(spark, d), ["cell_id"]), ["cell_id"]).where("band = 'ndvi'")
    return got.select("cell_id", F.aggregate("data", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("j4_fused_cells", "select a.vec_id as cell_id, a.label as sentinel_label, b.n_chars as viirs_n_chars from embeddings a join documents b on a.vec_id = b.doc_id")
def j4(spark, d):
    first = table(spark, d, "embeddings", ["vec_id", "label"]).withColumnRenamed("vec_id", "cell_id")
    second = table(spark, d, "documents", ["doc_id", "n_chars"]).withColumnRenamed("doc_id", "cell_id")
    return imagery.fused(first, second, ["cell_id"])


@query("j3_labels_and_arrays", "select doc_id, quality, embedding is not null as has_array from labels left join embeddings on doc_id = vec_id")
def j3(spark, d):
    arrays = table(spark, d, "embeddings", ["vec_id", "embedding"]).select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    return table(spark, d, "labels", ["doc_id", "quality"]).join(arrays, "doc_id", "left").select("doc_id", "quality", F.coalesce("has", F.lit(False)).alias("has_array"))


@query("s23_fallback", f"with i as ({P.IMAGES}), a as (select * from i where band = 'view'), b as (select * from i where band = 'click'), e as (select cell_id from a group by 1 having count(*) >= 25) select cell_id, image_id, 'first' as source from a where cell_id in (select cell_id from e) union all select cell_id, image_id, 'second' from b where cell_id not in (select cell_id from e)")
def s23(spark, d):
    i = P.images(spark, d).select("cell_id", "image_id", "band")
    return imagery.with_fallback(i.where("band = 'view'"), i.where("band = 'click'"), ["cell_id"], 25).select("cell_id", "image_id", "source")


@query("u6_merged_collections", f"select image_id from ({P.IMAGES}) where band = 'view' union all select image_id from ({P.IMAGES}) where cloud_pct < 20")
def u6(spark, d):
    i = P.images(spark, d)
    return i.where("band = 'view'").select("image_id").unionAll(i.where("cloud_pct < 20").select("image_id"))


@query("a32_image_counts", f"select cell_id, count(*) as images from ({P.IMAGES}) group by 1")
def a32(spark, d):
    nested = P.images(spark, d).groupBy("cell_id", "band").agg(F.collect_list("image_id").alias("ids")).groupBy("cell_id").agg(F.collect_list("ids").alias("n"))
    return imagery.image_counts(nested, ["cell_id"], "n")


@query("a28_r12_array_facts", "select vec_id, list_min(embedding) as min, list_max(embedding) as max, len(list_distinct(embedding)) as distinct, 64 as size, 256 as bytes, (vec_id + 8.0) / 8 as pixel from embeddings")
def a28(spark, d):
    rows = integrity.array_facts(table(spark, d, "embeddings"), ["vec_id"], "embedding")
    return rows.withColumn("distinct", F.col("distinct").cast("bigint")).withColumn("pixel", raster.pixel_size(F.lit(-8.0), F.col("vec_id").cast("double"), F.lit(8)))


@query("f12_month_ranges", """select y, m as month, cast(make_date(y, m, 1) as varchar) as first_day, cast(last_day(make_date(y, m, 1)) as varchar) as last_day, cast(cast(make_date(y, m, 1) + interval 1 month as date) as varchar) as until from (select distinct year(o_orderdate) as y from orders) a, (select unnest(range(1, 13)) as m) b""")
def f12(spark, d):
    years = table(spark, d, "orders", ["o_orderdate"]).select(F.year("o_orderdate").alias("y")).distinct()
    return years.select("y", F.inline(dates.month_ranges(F.col("y")))).select(F.col("y").cast("bigint").alias("y"), F.col("month").cast("bigint").alias("month"), *[F.col(c).cast("string").alias(c) for c in ("first_day", "last_day", "until")])


@query("f13_f14_times", "select event_id, year(ts) < 2017 as early, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as elapsed from events")
def f13(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", dates.early_year(F.year(ts)).alias("early"), dates.iso(ts).alias("iso"), dates.elapsed_seconds(F.lit("2024-01-01").cast("timestamp"), ts).alias("elapsed"))


@query("p15_finite_values", "select event_id from events where value < 400")
def p15(spark, d):
    v = F.when(F.col("value") >= 400, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").where(numbers.finite(v).isNotNull()).select("event_id")
