"""Grids and joins of boxes by bins.

Boxes that intersect lie in a common bin of a regular grid; a join on the bins' numbers and the exact test replace comparing every pair. A pair
that shares several bins is kept in that of its lower corner only, so nothing has to be made distinct afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.geometry import boxes_meet, overlap_area, valid_ring
from gridloom.functions.numbers import snap_down, snap_up

BOUNDS = ("x0", "y0", "x1", "y1")


def _cells(bounds: DataFrame, first_i: Column, last_i: Column, first_j: Column, last_j: Column) -> DataFrame:
    rows = bounds.withColumn("i", F.explode(F.sequence(first_i, last_i)))
    return rows.withColumn("j", F.explode(F.sequence(first_j, last_j)))


def grid_outward(bounds: DataFrame, size: float) -> DataFrame:
    """Cells on multiples of the size that cover the bounds, with one more row and column beyond; keeps the bounds' other columns."""
    keep = [c for c in bounds.columns if c not in BOUNDS]
    cells = _cells(bounds, snap_down(F.col("x0"), size), snap_up(F.col("x1"), size), snap_down(F.col("y0"), size), snap_up(F.col("y1"), size))
    edge = lambda c, k: (c + k) * F.lit(size)
    return cells.select(*keep, "i", "j", edge(F.col("i"), 0).alias("x0"), edge(F.col("j"), 0).alias("y0"), edge(F.col("i"), 1).alias("x1"), edge(F.col("j"), 1).alias("y1"))


def grid_anchored(bounds: DataFrame, size: float) -> DataFrame:
    """Cells from the lower corner of the bounds on; the last ones end with the bounds."""
    keep = [c for c in bounds.columns if c not in BOUNDS]
    count = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a)) / size).cast("bigint") - 1, F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    cells = _cells(bounds, zero, count("x0", "x1"), zero, count("y0", "y1"))
    low = lambda a, c: F.col(a) + F.col(c) * F.lit(size)
    high = lambda a, b, c: F.least(F.col(a) + (F.col(c) + 1) * F.lit(size), F.col(b))
    return cells.select(*keep, "i", "j", low("x0", "i").alias("x0"), low("y0", "j").alias("y0"), high("x0", "x1", "i").alias("x1"), high("y0", "y1", "j").alias("y1"))


def _box(df_prefix: str = "") -> Column:
    return F.struct(*[F.col(df_prefix + c).alias(c) for c in BOUNDS])


def _binned(df: DataFrame, size: float, prefix: str) -> DataFrame:
    low, high = (lambda c: F.floor(F.col(prefix + c) / size).cast("bigint")), (lambda c: F.floor(F.col(prefix + c) / size).cast("bigint"))
    df = df.withColumns({f"{prefix}bi": low("x0"), f"{prefix}bj": low("y0")})
    return df.withColumn("_bi", F.explode(F.sequence(low("x0"), high("x1")))).withColumn("_bj", F.explode(F.sequence(low("y0"), high("y1"))))


def box_join(left: DataFrame, right: DataFrame, bin_size: float, closed: bool = True) -> DataFrame:
    """Pairs of boxes that intersect. Columns of the left side get the prefix a_, those of the right side b_; overlap is the shared area."""
    a = _binned(left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns]), bin_size, "a_")
    b = _binned(right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns]), bin_size, "b_")
    own = (F.col("_bi") == F.greatest("a_bi", "b_bi")) & (F.col("_bj") == F.greatest("a_bj", "b_bj"))
    met = a.join(b, ["_bi", "_bj"]).where(own & boxes_meet(_box("a_"), _box("b_"), closed))
    return met.withColumn("overlap", overlap_area(_box("a_"), _box("b_"))).drop("_bi", "_bj", "a_bi", "a_bj", "b_bi", "b_bj")


def touching_cells(cells: DataFrame, key: list[str], boundary: DataFrame, bin_size: float) -> DataFrame:
    """Cells that intersect any box of the boundary."""
    found = box_join(cells, boundary, bin_size).select(*[F.col(f"a_{k}").alias(k) for k in key]).distinct()
    return cells.join(found, key, "left_semi")


def overlap_share(cells: DataFrame, key: list[str], boundary: DataFrame, bin_size: float) -> DataFrame:
    """Cells with the share of their area inside the boundary's boxes, which don't overlap one another."""
    inside = box_join(cells, boundary, bin_size, closed=False).groupBy(*[F.col(f"a_{k}").alias(k) for k in key]).agg(F.sum("overlap").alias("_inside"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return cells.join(inside, key, "left").withColumn("share", F.coalesce(F.try_divide(F.col("_inside"), area), F.lit(0.0))).drop("_inside")


def numbered(cells: DataFrame, name: str = "cell_id", order: tuple[str, ...] = ("i", "j"), by: tuple[str, ...] = ()) -> DataFrame:
    """Cells numbered from 0 without gaps, columns first; with ``by`` each country's grid by itself.

    Columns are numbered in parallel: a cell's number is how many cells the columns before have, plus its place in its own.
    """
    first, rest = order[0], order[1:]
    columns = cells.groupBy(*by, first).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.join(columns.withColumn("_before", before).drop("_n"), [*by, first])
    own = F.row_number().over(Window.partitionBy(*by, first).orderBy(*rest)) - 1
    return placed.withColumn(name, (F.col("_before") + own).cast("bigint")).select(*cells.columns, name)


def self_overlaps(cells: DataFrame, key: str, bin_size: float) -> DataFrame:
    """Pairs of different cells that share area."""
    return box_join(cells, cells, bin_size, closed=False).where((F.col(f"a_{key}") < F.col(f"b_{key}")) & (F.col("overlap") > 0)).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), "overlap")


def queen_neighbours(cells: DataFrame, key: str, by: tuple[str, ...] = (), i: str = "i", j: str = "j") -> DataFrame:
    """Pairs of cells that share an edge or a corner: eight offsets and an equality join."""
    offsets = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in (-1, 0, 1) for dj in (-1, 0, 1) if di or dj])
    moved = cells.select(*by, F.col(key).alias("cell"), F.col(i).alias("_i"), F.col(j).alias("_j"), F.explode(offsets).alias("_o"))
    moved = moved.select(*by, "cell", (F.col("_i") + F.col("_o.di")).alias(i), (F.col("_j") + F.col("_o.dj")).alias(j))
    return moved.join(cells.select(*by, F.col(key).alias("neighbour"), i, j), [*by, i, j]).select(*by, "cell", "neighbour")


def covered_area(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Area of the union of boxes that may overlap, per key: exact, by compressing coordinates.

    A key's distinct x bounds cut the plane into slabs; in each slab the boxes' y intervals are merged by a running maximum.
    """
    xs = boxes.select(*key, "x0").union(boxes.select(*key, "x1")).distinct().withColumnRenamed("x0", "x")
    slabs = xs.withColumn("to", F.lead("x").over(Window.partitionBy(*key).orderBy("x"))).where("to is not null")
    inside = slabs.join(boxes, key).where("x0 <= x and x1 >= to")
    order = Window.partitionBy(*key, "x").orderBy("y0", "y1")
    before = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(before, F.col("y0"))))
    return inside.withColumn("_gain", gain).groupBy(*key).agg(F.sum(F.col("_gain") * (F.col("to") - F.col("x"))).alias("covered_area"))


def valid_shapes(df: DataFrame, ring: str) -> DataFrame:
    """Rows whose ring is there, closed and has an area."""
    return df.where(F.coalesce(valid_ring(F.col(ring)), F.lit(False)))
