"""Queries on grids, labels and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import grid, label, survey
from gridloom.plans import proxies as P
from gridloom.plans._registry import Registry
from gridloom.sources.tables import geojson_text

query = Registry()

_CLUSTERS = f"select hv001, sum(hv005 * wealth_index) / sum(hv005) / 1000 as wealth_index, sum(hv005) as weight from ({P.HOUSEHOLDS}) group by hv001"
_BUFFERS = f"""select hv001, wealth_index, weight, x - r as x0, y - r as y0, x + r as x1, y + r as y1
    from (select c.*, p.*, case urban_rura when 'U' then 2000.0 when 'R' then 5050.0 end as r from ({P.PLACES}) p right join ({_CLUSTERS}) c on p.dhsclust = c.hv001)"""
_MET = f"""select g.cell_id, b.hv001, b.wealth_index, b.weight, (g.x1 - g.x0) * (g.y1 - g.y0) as total, case when b.x0 is not null then greatest(0, least(g.x1, b.x1) - greatest(g.x0, b.x0)) * greatest(0, least(g.y1, b.y1) - greatest(g.y0, b.y0)) end as a
    from ({P.GRID}) g left join ({_BUFFERS}) b on g.x0 <= b.x1 and b.x0 <= g.x1 and g.y0 <= b.y1 and b.y0 <= g.y1"""
_COVERAGE = f"""select cell_id, max(total) as total_area, coalesce(sum(a), 0) as covered_area, 100 * coalesce(sum(a), 0) / max(total) as coverage_percent,
    case when sum(a) > 0 then sum(a * wealth_index) / sum(a) end as weighted_wealth from ({_MET}) group by cell_id"""


def clusters(spark, d):
    return survey.cluster_means(P.households(spark, d), "hv001", "hv005", "wealth_index").withColumn("wealth_index", F.col("wealth_index") / 1000)


def buffers(spark, d):
    places = P.places(spark, d)
    return label.square_buffers(label.located(clusters(spark, d), places, F.col("dhsclust") == F.col("hv001")))


def coverage(spark, d):
    return label.coverage(P.grid_cells(spark), "cell_id", buffers(spark, d), "wealth_index", 5000.0)


@query("j1_located_clusters", f"select dhsclust, urban_rura, hv001, round(wealth_index, 6) as wealth_index from ({P.PLACES}) p right join ({_CLUSTERS}) c on p.dhsclust = c.hv001")
def j1(spark, d):
    return label.located(clusters(spark, d), P.places(spark, d), F.col("dhsclust") == F.col("hv001")).select("dhsclust", "urban_rura", "hv001", F.round("wealth_index", 6).alias("wealth_index"))


@query("g8_square_buffers", f"select hv001, x0, y0, x1, y1 from ({_BUFFERS})")
def g8(spark, d):
    return buffers(spark, d).select("hv001", "x0", "y0", "x1", "y1")


@query("j5_j6_box_join", f"select cell_id, hv001, round(a, 3) as overlap from ({_MET}) where hv001 is not null")
def j6(spark, d):
    met = grid.box_join(P.grid_cells(spark).select("cell_id", *grid.BOUNDS), buffers(spark, d).select("hv001", *grid.BOUNDS), 5000.0)
    return met.select(F.col("a_cell_id").alias("cell_id"), F.col("b_hv001").alias("hv001"), F.round("overlap", 3).alias("overlap"))


@query("a3_p6_labelled_grid", f"select cell_id, total_area, round(covered_area, 3) as covered_area, round(coverage_percent, 6) as coverage_percent, case when coverage_percent >= 32 then round(weighted_wealth, 6) end as weighted_wealth from ({_COVERAGE})")
def flagship(spark, d):
    labelled = label.with_threshold(coverage(spark, d), 32.0)
    return labelled.select("cell_id", "total_area", F.round("covered_area", 3).alias("covered_area"), F.round("coverage_percent", 6).alias("coverage_percent"), F.round("weighted_wealth", 6).alias("weighted_wealth"))


@query("a2_double_weighted", f"select cell_id, round(case when count(*) = 1 then max(wealth_index) else sum(a * weight * wealth_index) / nullif(sum(a * weight), 0) end, 6) as wealth from ({_MET}) where hv001 is not null group by cell_id")
def a2(spark, d):
    met = grid.box_join(P.grid_cells(spark).select("cell_id", *grid.BOUNDS), buffers(spark, d).select("hv001", "wealth_index", "weight", *grid.BOUNDS), 5000.0)
    return met.groupBy(F.col("a_cell_id").alias("cell_id")).agg(F.round(label.double_weighted_mean(F.col("b_wealth_index"), F.col("overlap"), F.col("b_weight")), 6).alias("wealth"))


@query("p5_covered_cells", f"select cell_id from ({_COVERAGE}) where coverage_percent >= 50 and weighted_wealth is not null")
def p5(spark, d):
    return coverage(spark, d).where("coverage_percent >= 50 and weighted_wealth is not null").select("cell_id")


@query("a27_cell_counts", f"select count(*) as cells, sum((coverage_percent > 0)::int)::bigint as covered_cells, sum((coverage_percent >= 20)::int)::bigint as at_least_20, sum((coverage_percent >= 50)::int)::bigint as at_least_50 from ({_COVERAGE})")
def a27(spark, d):
    return label.cell_counts(coverage(spark, d), [20.0, 50.0])


@query("f22_threshold_sweep", f"""with c as ({P.PANEL}), s as (select unnest(range(20)) as step)
    select year, step, round(30.01 + step * 5.0 / 19, 9) as threshold, count(*) as num_cells, count(case when coverage_percent >= 30.01 + step * 5.0 / 19 then weighted_wealth end) as num_cells_labelled,
        round(100 * count(case when coverage_percent >= 30.01 + step * 5.0 / 19 then weighted_wealth end) / count(*), 6) as percent_cells_labelled,
        round(avg(case when coverage_percent >= 30.01 + step * 5.0 / 19 then weighted_wealth end), 6) as mean_label, round(stddev_samp(case when coverage_percent >= 30.01 + step * 5.0 / 19 then weighted_wealth end), 6) as std_label
    from c, s group by year, step""")
def f22(spark, d):
    got = label.sweep(P.panel(spark, d), 20, 30.01, 35.01, by=("year",))
    return got.withColumns({"threshold": F.round("threshold", 9), **{c: F.round(c, 6) for c in ("percent_cells_labelled", "mean_label", "std_label")}})


_MODEL = "select cell_id, year, 0.5 as prediction from c where cell_id % 3 = 0"


@query("m15_fill_labels", f"with c as (select cell_id, year, case when coverage_percent >= 50 then weighted_wealth end as weighted_wealth from ({P.PANEL})), p as ({_MODEL}) select cell_id, year, round(coalesce(weighted_wealth, prediction), 10) as weighted_wealth, weighted_wealth is null and prediction is not null as predicted_flag from c left join p using (cell_id, year)")
def m15(spark, d):
    c = label.with_threshold(P.panel(spark, d), 50.0).drop("coverage_percent")
    p = c.where("cell_id % 3 = 0").select("cell_id", "year", F.lit(0.5).alias("prediction"))
    return label.with_predictions(c, p, ["cell_id", "year"]).withColumn("weighted_wealth", F.round("weighted_wealth", 10))


_BOUNDS = f"select urban_rura, min(x) as x0, min(y) as y0, max(x) + 7 as x1, max(y) + 7 as y1 from ({P.PLACES}) group by 1"


def _bounds(spark, d):
    return P.places(spark, d).groupBy("urban_rura").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 7).alias("x1"), (F.max("y") + 7).alias("y1"))


@query("g2_f26_grid_outward", f"""select urban_rura, i, j, i * 8000.0 as x0, j * 8000.0 as y0, (i + 1) * 8000.0 as x1, (j + 1) * 8000.0 as y1 from
    (select urban_rura, y0, y1, unnest(range(cast(floor(x0 / 8000) as bigint), cast(ceil(x1 / 8000) as bigint) + 1)) as i from ({_BOUNDS})) t, lateral (select unnest(range(cast(floor(y0 / 8000) as bigint), cast(ceil(y1 / 8000) as bigint) + 1)) as j) u""")
def g2(spark, d):
    return grid.grid_outward(_bounds(spark, d), 8000.0)


_ANCHORED = f"""select urban_rura, i, j, bx0 + i * 8000.0 as x0, by0 + j * 8000.0 as y0, least(bx0 + (i + 1) * 8000.0, bx1) as x1, least(by0 + (j + 1) * 8000.0, by1) as y1 from
    (select urban_rura, x0 as bx0, y0 as by0, x1 as bx1, y1 as by1, unnest(range(cast(ceil((x1 - x0) / 8000) as bigint))) as i from ({_BOUNDS})) t, lateral (select unnest(range(cast(ceil((by1 - by0) / 8000) as bigint))) as j) u"""


@query("g3_w9_grid_anchored", f"select urban_rura, i, j, x0, y0, x1, y1, row_number() over (partition by urban_rura order by i, j) - 1 as cell_id from ({_ANCHORED}) where (x1 - x0) * (y1 - y0) >= 0.4 * 64000000")
def g3(spark, d):
    cells = grid.grid_anchored(_bounds(spark, d), 8000.0)
    return grid.numbered(cells.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 0.4 * 64e6), by=("urban_rura",))


_BOUNDARY = "select * from (values (12000.0, 9000.0, 61000.0, 40000.0), (61000.0, 40000.0, 95000.0, 88000.0)) t(x0, y0, x1, y1)"


def _boundary(spark):
    return spark.createDataFrame([(12000.0, 9000.0, 61000.0, 40000.0), (61000.0, 40000.0, 95000.0, 88000.0)], "x0 double, y0 double, x1 double, y1 double")


@query("j7_cells_in_country", f"select cell_id from ({P.GRID}) g where exists (select 1 from ({_BOUNDARY}) b where g.x0 <= b.x1 and b.x0 <= g.x1 and g.y0 <= b.y1 and b.y0 <= g.y1)")
def j7(spark, d):
    return grid.touching_cells(P.grid_cells(spark).select("cell_id", *grid.BOUNDS), ["cell_id"], _boundary(spark), 5000.0).select("cell_id")


@query("j8_overlap_share", f"""select cell_id, round(coalesce(sum(greatest(0, least(g.x1, b.x1) - greatest(g.x0, b.x0)) * greatest(0, least(g.y1, b.y1) - greatest(g.y0, b.y0))), 0) / 25000000, 6) as share from ({P.GRID}) g, ({_BOUNDARY}) b group by cell_id having share >= 0.4""")
def j8(spark, d):
    got = grid.overlap_share(P.grid_cells(spark).select("cell_id", *grid.BOUNDS), ["cell_id"], _boundary(spark), 5000.0)
    return got.where("share >= 0.4").select("cell_id", F.round("share", 6).alias("share"))


@query("j9_self_overlaps", f"""with b as ({_BUFFERS}) select l.hv001 as a, r.hv001 as b, round((least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)), 3) as overlap
    from b l join b r on l.hv001 < r.hv001 and l.x0 < r.x1 and r.x0 < l.x1 and l.y0 < r.y1 and r.y0 < l.y1""")
def j9(spark, d):
    return grid.self_overlaps(buffers(spark, d).select("hv001", *grid.BOUNDS), "hv001", 5000.0).withColumn("overlap", F.round("overlap", 3))


@query("j10_queen_neighbours", f"with g as ({P.GRID}) select a.cell_id as cell, b.cell_id as neighbour from g a join g b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and a.cell_id <> b.cell_id")
def j10(spark, d):
    return grid.queen_neighbours(P.grid_cells(spark), "cell_id")


@query("g9_g10_union_area", f"""with b as ({_BUFFERS}), k as (select hv001 % 10 as k, x0, y0, x1, y1 from b),
    xs as (select k, x, lead(x) over (partition by k order by x) as nx from (select distinct k, unnest([x0, x1]) as x from k)), ys as (select k, y, lead(y) over (partition by k order by y) as ny from (select distinct k, unnest([y0, y1]) as y from k)),
    c as (select xs.k, x, nx, y, ny from xs join ys on xs.k = ys.k where nx is not null and ny is not null)
    select k, round(sum((nx - x) * (ny - y)), 3) as covered_area from c where exists (select 1 from k where k.k = c.k and k.x0 <= c.x and k.x1 >= c.nx and k.y0 <= c.y and k.y1 >= c.ny) group by k""")
def g9(spark, d):
    rows = buffers(spark, d).select((F.col("hv001") % 10).alias("k"), *grid.BOUNDS)
    return grid.covered_area(rows, ["k"]).withColumn("covered_area", F.round("covered_area", 3))


def _triangle(spark, d):
    p = G.point
    x, y = F.col("x"), F.col("y")
    return P.places(spark, d).select("dhsclust", F.array(p(x, y), p(x + 3000, y + 500), p(x + 1000, y + 4000)).alias("ring"), G.box(x + 500.0, y + 400.0, x + 2500.0, y + 2500.0).alias("box"), "x", "y")


_T = f"select dhsclust, x, y from ({P.PLACES})"


@query("g4_g12_g13_rings", f"select dhsclust, 5750000.0 as area, round(x + 4000 / 3.0, 4) as cx, round(y + 1500, 4) as cy, x as x0, y as y0, x + 3000 as x1, y + 4000 as y1, false as valid from ({_T})")
def g4(spark, d):
    r = F.col("ring")
    rows = _triangle(spark, d).withColumn("c", G.centroid(r)).withColumn("b", G.ring_box(r))
    return rows.select("dhsclust", F.round(G.ring_area(r), 3).alias("area"), F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"), "b.x0", "b.y0", "b.x1", "b.y1", G.valid_ring(r).alias("valid"))


# Widths of the triangle between the box's sides, integrated over heights 400 to 2500: right edges less left ones.
_CLIP = """3 * (pow(2500 / 6.0, 2) - pow(400, 2)) + 2500 * (1375 - 2500 / 6.0) + 3000.0 * 1125 - 2 / 7.0 * (pow(2000, 2) - pow(875, 2))
    - 500.0 * 1600 - (pow(2500, 2) - pow(2000, 2)) / 8"""


@query("g6_g7_clipped_area", f"select dhsclust, round({_CLIP}, 1) as area from ({_T})")
def g6(spark, d):
    return _triangle(spark, d).select("dhsclust", F.round(G.ring_area(G.clipped(F.col("ring"), F.col("box"))), 1).alias("area"))


@query("p13_valid_shapes", f"select dhsclust from ({P.PLACES}) where dhsclust % 4 not in (0, 1)")
def p13(spark, d):
    """Of closed triangles, those without a ring or with one of no area go."""
    k, r = F.col("dhsclust") % 4, F.col("ring")
    ring = F.when(k == 0, F.lit(None)).when(k == 1, F.array(r[0], r[1], r[1], r[0])).otherwise(F.concat(r, F.slice(r, 1, 1)))
    return grid.valid_shapes(_triangle(spark, d).withColumn("ring", ring), "ring").select("dhsclust")


@query("g8_circles", f"select dhsclust, round(32 * r * r * sin(2 * pi() / 64), 2) as area, 64 as points from (select dhsclust, case urban_rura when 'U' then 2000.0 else 5050.0 end as r from ({P.PLACES}))")
def g8_circles(spark, d):
    ring = G.circle(F.col("x"), F.col("y"), G.buffer_radius(F.col("urban_rura")))
    return P.places(spark, d).select("dhsclust", F.round(G.ring_area(ring), 2).alias("area"), F.size(ring).alias("points"))


@query("g11_projection", f"select dhsclust, round(-17 + x / 50000, 7) as lon, round(12 + y / 25000, 7) as lat from ({P.PLACES})")
def g11(spark, d):
    rows = P.places(spark, d).select("dhsclust", (-17 + F.col("x") / 50000).alias("lon"), (12 + F.col("y") / 25000).alias("lat"))
    there = rows.withColumn("p", G.projected(F.col("lon"), F.col("lat"), 32628)).select("dhsclust", "p.x", "p.y")
    return there.withColumn("q", G.unprojected(F.col("x"), F.col("y"), 32628)).select("dhsclust", F.round("q.x", 7).alias("lon"), F.round("q.y", 7).alias("lat"))


@query("a29_map_centre", f"select round(avg(x + 4000 / 3.0), 4) as cx, round(avg(y + 1500), 4) as cy from ({_T})")
def a29(spark, d):
    c = _triangle(spark, d).select(G.centroid(F.col("ring")).alias("c"))
    return c.agg(F.round(F.avg("c.x"), 4).alias("cx"), F.round(F.avg("c.y"), 4).alias("cy"))


@query("s25_geojson")
def s25(spark, d):
    return _triangle(spark, d).select("dhsclust", geojson_text(F.col("ring"), "dhsclust").alias("feature"))


@query("g13_kinds", f"select case when dhsclust % 4 = 0 then 'empty' else 'polygon' end as kind, count(*) as n from ({P.PLACES}) group by 1")
def g13(spark, d):
    ring = F.when(F.col("dhsclust") % 4 == 0, F.slice("ring", 1, 1)).otherwise(F.col("ring"))
    return _triangle(spark, d).groupBy(F.when(G.ring_area(ring) > 0, "polygon").otherwise("empty").alias("kind")).agg(F.count("*").alias("n"))
