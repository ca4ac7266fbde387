"""Spatial joins by grid cells: nearest edge, polygons that hold a point, nearest polygon within a bound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import geo
from headway.sources.staging import settle


def touched_cells(x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column, cell: float) -> Column:
    """All grid cells that a box touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / F.lit(cell)), F.floor(hi / F.lit(cell)))
    return F.flatten(F.transform(span(x_lo, x_hi), lambda i: F.transform(span(y_lo, y_hi), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _best(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """(x, y, edge_id, distance) of points (c, x, y) whose nearest edge of their cell lies within ``size``, as far as the cell can prove it."""
    distance = geo.segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    best = points.join(boxes, "c").withColumn("distance", distance).groupBy("x", "y").agg(F.min(F.struct("distance", "edge_id")).alias("b"))
    return best.filter(F.col("b.distance") <= F.lit(size)).select("x", "y", "b.edge_id", "b.distance")


def _cell_of(size: float) -> Column:
    return F.struct(F.floor(F.col("x") / F.lit(size)).alias("i"), F.floor(F.col("y") / F.lit(size)).alias("j"))


def _wide_cells(size: float) -> Column:
    """The cells of an edge widened by ``size``."""
    r = F.lit(size)
    return touched_cells(F.least("x1", "x2") - r, F.greatest("x1", "x2") + r, F.least("y1", "y2") - r, F.greatest("y1", "y2") + r, size)


def nearest_edge(points: DataFrame, edges: DataFrame, cell_m: float = 500.0, rounds: int = 12, *, crowd: int = 250_000, least_m: float = 0.01) -> DataFrame:
    """Adds edge_id and distance (Web-Mercator metres) of the nearest edge to points (point_id, x, y).

    ``edges``: edge_id, x1, y1, x2, y2.  Equal places and equal edges are looked at once.  Places meet the edges of their cell,
    widened by its size.  A cell in which more than ``crowd`` pairs would meet is split into 64, and these again, down to
    ``least_m``, so a dense place costs no square of what it holds.  A place whose nearest edge so far lies beyond what
    its cell can prove goes on with the cell around it, and beyond the first size with cells of eight times the size; each step is
    written down, so none is computed again.  Points without coordinates have no edge.  Ties go to the lowest edge_id.
    """
    ends = ["x1", "y1", "x2", "y2"]
    alone = edges.dropna(subset=ends).groupBy(*ends).agg(F.min("edge_id").alias("edge_id"))
    places = points.filter("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    here, boxes, size, levels = places.withColumn("c", _cell_of(cell_m)), alone.withColumn("c", F.explode(_wide_cells(cell_m))), cell_m, []
    while size > least_m:
        full = here.groupBy("c").agg(F.count("*").alias("n")).join(boxes.groupBy("c").agg(F.count("*").alias("m")), "c").filter(F.col("n") * F.col("m") > crowd).select("c")
        if full.isEmpty():
            break
        here, boxes, full = settle(here, "places"), settle(boxes, "boxes"), settle(full, "crowded")
        levels.append((here.join(full, "c", "left_anti"), boxes, size))
        below = size / 8
        here = here.join(full, "c", "left_semi").withColumn("c", _cell_of(below))
        # an edge goes on to those of its cell's parts that it touches
        part = F.floor(F.col("p.i") / F.lit(8.0)), F.floor(F.col("p.j") / F.lit(8.0))
        boxes = boxes.join(full, "c", "left_semi").withColumn("p", F.explode(_wide_cells(below))).filter((part[0] == F.col("c.i")) & (part[1] == F.col("c.j"))).withColumn("c", F.col("p")).drop("p")
        size = below
    levels.append((here, boxes, size))
    found, rest = [], None
    for mine, near, size in reversed(levels):
        todo = mine if rest is None else mine.unionByName(rest.withColumn("c", _cell_of(size)))
        best = settle(_best(todo, near, size), "nearest")
        found.append(best)
        rest = todo.select("x", "y").join(best, ["x", "y"], "left_anti")
    for _ in range(rounds - 1):
        if rest.isEmpty():
            break
        size *= 8
        best = settle(_best(rest.withColumn("c", _cell_of(size)), alone.withColumn("c", F.explode(_wide_cells(size))), size), "nearest")
        found.append(best)
        rest = rest.join(best, ["x", "y"], "left_anti")
    return points.join(reduce(DataFrame.unionByName, found), ["x", "y"], "left").select(*points.columns, "edge_id", "distance")


def stop_edges(stop_times: DataFrame, stop_to_edge: DataFrame) -> DataFrame:
    """Distinct (trip_id, edge_id) of trips' stops."""
    return stop_times.select("trip_id", "stop_id").join(stop_to_edge.select("stop_id", "edge_id"), "stop_id").select("trip_id", "edge_id").distinct()


def _all_rings(polygons: DataFrame) -> DataFrame:
    """Polygons with ``rings``; those given by one ``ring`` have that alone."""
    return polygons if "rings" in polygons.columns else polygons.withColumn("rings", F.array("ring"))


def _box(widen: float = 0.0) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    b = F.lit(widen)
    return F.array_min(xs) - b, F.array_max(xs) + b, F.array_min(ys) - b, F.array_max(ys) + b


def containing(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """(point_id, polygon_id) of points (point_id, x, y) inside polygons (polygon_id, ring, or rings by the even-odd rule, so
    that points in holes are outside); a shared border may give two.

    A polygon's rings meet the points of the cells of its box that they cross or hold; points are told from each other by place.
    """
    p = _all_rings(polygons).select("polygon_id", "rings").withColumn("c", F.explode(touched_cells(*_box(), cell)))
    places = points.select("x", "y").dropna().distinct().withColumn("c", _cell_of(cell))
    held = places.join(p, "c").filter(geo.inside_rings(F.col("x"), F.col("y"), F.col("rings"))).select("x", "y", "polygon_id").distinct()
    return points.join(held, ["x", "y"]).select("point_id", "polygon_id").distinct()


def nearest_within(points: DataFrame, polygons: DataFrame, bound: float) -> DataFrame:
    """(point_id, polygon_id, distance) of the nearest polygon border not farther than ``bound``; ties to the lowest id."""
    cell = max(bound * 16, 1e-9)
    p = _all_rings(polygons).select("polygon_id", "rings").withColumn("c", F.explode(touched_cells(*_box(bound), cell)))
    met = points.withColumn("c", _cell_of(cell)).join(p, "c").withColumn("distance", geo.rings_distance(F.col("x"), F.col("y"), F.col("rings"))).filter(F.col("distance") <= F.lit(bound))
    return met.groupBy("point_id").agg(F.min(F.struct("distance", "polygon_id")).alias("b")).select("point_id", "b.polygon_id", "b.distance")


def counties_of_stops(stops: DataFrame, counties: DataFrame, snap_m: float = 3000.0) -> DataFrame:
    """Distinct county ids of stops (stop_id, stop_lat, stop_lon); a stop over ``snap_m`` from all counties is an error."""
    pts = stops.select(F.col("stop_id").alias("point_id"), F.col("stop_lon").alias("x"), F.col("stop_lat").alias("y"))
    poly = _all_rings(counties).select(F.col("county_id").alias("polygon_id"), "rings")
    inside = containing(pts, poly)
    rest = pts.join(inside, "point_id", "left_anti")
    x, y = geo.albers(F.col("y"), F.col("x"))

    def flat(p: Column) -> Column:
        px, py = geo.albers(p["y"], p["x"])
        return F.struct(px.alias("x"), py.alias("y"))

    near = nearest_within(rest.select("point_id", x.alias("x"), y.alias("y")), poly.withColumn("rings", F.transform("rings", lambda r: F.transform(r, flat))), snap_m)
    lost = rest.join(near, "point_id", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"stops more than {snap_m:g} m from any county: {[r.point_id for r in lost]}")
    return inside.select("polygon_id").union(near.select("polygon_id")).distinct().withColumnRenamed("polygon_id", "county_id")
