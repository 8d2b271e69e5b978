"""Polygon measures and point-in-polygon joins with array functions only.

A polygon is an array of rings (outer first, then holes); a ring is an array of
``struct<x, y>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscope.functions import geodesy as G

GRID_STEPS = 40


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.pmod(i + 1, n)).alias("b")),
    )


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def ring_measure(ring: Column) -> Column:
    """struct(area, x, y) of one ring; a ring without area yields its vertex mean."""
    signed = _sum(F.transform(_edges(ring), _cross)) / 2.0
    cx = _sum(F.transform(_edges(ring), lambda e: (e["a"]["x"] + e["b"]["x"]) * _cross(e)))
    cy = _sum(F.transform(_edges(ring), lambda e: (e["a"]["y"] + e["b"]["y"]) * _cross(e)))
    n = F.size(ring).cast("double")
    mean_x = _sum(F.transform(ring, lambda p: p["x"])) / n
    mean_y = _sum(F.transform(ring, lambda p: p["y"])) / n

    def shape(area: Column, x: Column, y: Column) -> Column:
        return F.struct(area.alias("area"), x.alias("x"), y.alias("y"))

    zero = F.lit(0.0)
    divisor = F.nullif(signed * 6.0, zero)
    return (
        F.when(F.size(ring) < 3, shape(zero, zero, zero))
        .when(F.abs(signed) < 1e-12, shape(zero, mean_x, mean_y))
        .otherwise(shape(F.abs(signed), F.try_divide(cx, divisor), F.try_divide(cy, divisor)))
    )


def _holes(rings: Column) -> Column:
    """All rings but the first, however many."""
    return F.filter(rings, lambda _, i: i > 0)


def polygon_measure(rings: Column) -> Column:
    """struct(area, x, y) of the outer ring minus its holes."""
    parts = F.transform(rings, ring_measure)
    outer = F.get(parts, 0)
    holes = _holes(parts)
    net = outer["area"] - _sum(F.transform(holes, lambda h: h["area"]))
    x = outer["area"] * outer["x"] - _sum(F.transform(holes, lambda h: h["area"] * h["x"]))
    y = outer["area"] * outer["y"] - _sum(F.transform(holes, lambda h: h["area"] * h["y"]))
    return F.when(net <= 1e-12, outer).otherwise(
        F.struct(net.alias("area"), F.try_divide(x, net).alias("x"), F.try_divide(y, net).alias("y"))
    )


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test: an odd number of edges crossed to the right."""
    crossed = F.filter(
        _edges(ring),
        lambda e: ((e["b"]["y"] > y) != (e["a"]["y"] > y))
        & (
            x
            < F.try_divide((e["a"]["x"] - e["b"]["x"]) * (y - e["b"]["y"]), e["a"]["y"] - e["b"]["y"])
            + e["b"]["x"]
        ),
    )
    return (F.size(ring) >= 3) & (F.pmod(F.size(crossed), F.lit(2)) == 1)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    in_hole = F.exists(_holes(rings), lambda h: in_ring(x, y, h))
    return F.coalesce((F.size(rings) > 0) & in_ring(x, y, F.get(rings, 0)) & ~in_hole, F.lit(False))


def with_measure(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    m = polygons.withColumn("_m", polygon_measure(F.col(rings)))
    return m.select(*polygons.columns, F.col("_m.area").alias("area"), F.col("_m.x").alias("cx"), F.col("_m.y").alias("cy"))


def bounding_box(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")
    )


def round_rings(rings: Column, digits: int = 5) -> Column:
    return F.transform(
        rings,
        lambda ring: F.transform(
            ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
        ),
    )


def representative_points(polygons: DataFrame, key: str = "region_key") -> DataFrame:
    """One point per key that lies on its land.

    The area-weighted centroid if some polygon holds it, else the centroid of
    the largest polygon, else the inside point of a 41 x 41 grid closest to it.
    Centroid sums are ordinary aggregates; only the largest polygon of each key
    travels with its rings.
    """
    parts = with_measure(polygons).filter("area > 0").withColumn("_p", F.xxhash64("rings"))
    totals = parts.groupBy(key).agg(
        (F.sum(F.col("area") * F.col("cx")) / F.sum("area")).alias("tx"),
        (F.sum(F.col("area") * F.col("cy")) / F.sum("area")).alias("ty"),
        F.max_by(F.struct("rings", "cx", "cy"), F.struct("area", "_p")).alias("big"),
        F.count(F.lit(1)).alias("n_polygons"),
    )
    held = (
        parts.select(key, "rings")
        .join(totals.select(key, "tx", "ty"), key)
        .groupBy(key)
        .agg(F.max(in_polygon(F.col("tx"), F.col("ty"), F.col("rings"))).alias("inside"))
    )
    rings, gx, gy = F.col("big.rings"), F.col("big.cx"), F.col("big.cy")
    box = bounding_box(F.slice(rings, 1, 1))
    steps = F.sequence(F.lit(0), F.lit(GRID_STEPS))

    def grid_x(i: Column) -> Column:
        return F.col("box.min_x") + (F.col("box.max_x") - F.col("box.min_x")) * i / float(GRID_STEPS)

    def grid_y(j: Column) -> Column:
        return F.col("box.min_y") + (F.col("box.max_y") - F.col("box.min_y")) * j / float(GRID_STEPS)

    grid = F.flatten(
        F.transform(
            steps,
            lambda i: F.transform(
                steps,
                lambda j: F.struct(
                    ((grid_x(i) - gx) * (grid_x(i) - gx) + (grid_y(j) - gy) * (grid_y(j) - gy)).alias("d"),
                    i.alias("i"), j.alias("j"), grid_x(i).alias("x"), grid_y(j).alias("y"),
                ),
            ),
        )
    )
    joined = totals.join(held, key).withColumn("box", box)
    # the grid is only built for the few keys that need it
    simple = (
        F.when(F.col("inside"), F.struct(F.col("tx").alias("x"), F.col("ty").alias("y")))
        .when(in_polygon(gx, gy, rings), F.struct(gx.alias("x"), gy.alias("y")))
    )
    first = joined.withColumn("point", simple)
    near = F.array_min(F.filter(grid, lambda g: in_polygon(g["x"], g["y"], rings)))
    rest = first.filter("point is null").withColumn("_g", near).withColumn(
        "point", F.struct(F.col("_g.x").alias("x"), F.col("_g.y").alias("y"))
    ).drop("_g")
    both = first.filter("point is not null").unionByName(rest)
    return both.select(key, F.col("point.x").alias("lon"), F.col("point.y").alias("lat"), "n_polygons")


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: list[str], level: int = 10) -> DataFrame:
    """Pairs of points and the polygons that hold them.

    Polygons are listed under the grid cells their box touches, points under
    their own cell, so the join is an equality on the cell; adaptive skew
    handling splits a crowded cell on the point side.  Points on one spot are
    tested once, and edges are only walked for points inside the box.
    """
    size = G.ROOT_DEGREES / 2**level
    boxed = polygons.withColumn("_box", bounding_box(F.col("rings")))
    rows = F.sequence(F.floor((F.col("_box.min_y") + 90.0) / size), F.floor((F.col("_box.max_y") + 90.0) / size))
    cols = F.sequence(F.floor((F.col("_box.min_x") + 180.0) / size), F.floor((F.col("_box.max_x") + 180.0) / size))
    cells = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("r"), c.alias("c")))))
    listed = boxed.withColumn("_cell", F.explode(cells))
    placed = points.select("lat", "lon").distinct().withColumn(
        "_cell",
        F.struct(F.floor((F.col("lat") + 90.0) / size).alias("r"), F.floor((F.col("lon") + 180.0) / size).alias("c")),
    )
    x, y = F.col("lon"), F.col("lat")
    boxes = x.between(F.col("_box.min_x"), F.col("_box.max_x")) & y.between(F.col("_box.min_y"), F.col("_box.max_y"))
    held = placed.join(listed, "_cell").filter(boxes & in_polygon(x, y, F.col("rings"))).drop("_cell", "_box", "rings")
    return points.join(held, ["lat", "lon"])
