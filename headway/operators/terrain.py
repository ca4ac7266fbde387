"""Heights from raster tiles, and the grades of edges.

A tile holds ``n`` by ``n`` cells and the samples on all its borders, so that a height between four samples needs one tile
only: points and tiles meet by tile key, one row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import geo


@dataclass(frozen=True)
class Grid:
    """Sample (i, j) lies at lon0 + i * step, lat0 + j * step; a tile has ``n`` cells a side."""

    lon0: float
    lat0: float
    step: float
    n: int = 64


def tiles(samples: DataFrame, grid: Grid) -> DataFrame:
    """(ti, tj, heights) of samples (i, j, height): rows of a tile from south to north, in each from west to east.

    Samples on a border go to all tiles that share it; one that is missing, or has no height, is null in its tile.  Of samples
    given twice the lower counts.
    """
    n = grid.n
    # the tile that begins at a sample's cell, and the one that ends there
    both = lambda c: F.when(F.pmod(F.col(c), F.lit(n)) == 0, F.array(F.floor(F.col(c) / n), F.floor(F.col(c) / n) - 1)).otherwise(F.array(F.floor(F.col(c) / n)))
    each = samples.filter("i IS NOT NULL AND j IS NOT NULL").withColumn("ti", F.explode(both("i"))).withColumn("tj", F.explode(both("j")))
    place = (F.col("j") - F.col("tj") * n) * (n + 1) + F.col("i") - F.col("ti") * n
    by = each.groupBy("ti", "tj", place.cast("int").alias("k")).agg(F.min("height").alias("h"))
    held = by.groupBy("ti", "tj").agg(F.map_from_entries(F.collect_list(F.struct("k", "h"))).alias("m"))
    return held.select("ti", "tj", F.transform(F.sequence(F.lit(0), F.lit((n + 1) * (n + 1) - 1)), lambda k: F.try_element_at("m", k)).alias("heights"))


def heights(points: DataFrame, raster: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``height`` to points (lat, lon, any others), bilinear between the four samples around; null where one is missing."""
    n = grid.n
    x, y = (F.col("lon") - grid.lon0) / grid.step, (F.col("lat") - grid.lat0) / grid.step
    p = points.withColumns({"_x": x, "_y": y}).withColumns({"_i": F.floor("_x"), "_j": F.floor("_y")}).withColumns({"ti": F.floor(F.col("_i") / n), "tj": F.floor(F.col("_j") / n)})
    met = p.join(raster, ["ti", "tj"], "left")
    at = lambda a, b: F.get("heights", ((F.col("_j") + b - F.col("tj") * n) * (n + 1) + F.col("_i") + a - F.col("ti") * n).cast("int"))
    u, v = F.col("_x") - F.col("_i"), F.col("_y") - F.col("_j")
    mixed = (at(0, 0) * (1 - u) + at(1, 0) * u) * (1 - v) + (at(0, 1) * (1 - u) + at(1, 1) * u) * v
    return met.withColumn("height", mixed).select(*[F.col(f"`{c}`") for c in points.columns], "height")


def edge_grades(edges: DataFrame, raster: DataFrame, grid: Grid, *, spacing_m: float = 50.0, smooth: int = 1) -> DataFrame:
    """(edge_id, grade, climb_m) of edges (edge_id, lat1, lon1, lat2, lon2).

    Heights are taken about every ``spacing_m`` along an edge and averaged over ``smooth`` places on either side, so that steps of
    the raster do not count as hills.  ``grade`` is rise over run between the ends, ``climb_m`` the sum of what goes up; both are null for
    edges that leave the raster, and the grade for those without length.
    """
    km = geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    e = edges.select("edge_id", "lat1", "lon1", "lat2", "lon2", (km * 1000).alias("run_m")).dropna()
    e = e.withColumn("n", F.greatest(F.ceil(F.col("run_m") / spacing_m), F.lit(1)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    part = lambda c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col("k") / F.col("n")
    high = heights(e.select("edge_id", "run_m", "k", part("lat").alias("lat"), part("lon").alias("lon")), raster, grid)
    w = Window.partitionBy("edge_id").orderBy("k")
    level = high.withColumn("s", F.avg("height").over(w.rowsBetween(-smooth, smooth))).withColumn("up", F.greatest(F.col("s") - F.lag("s").over(w), F.lit(0.0)))
    g = level.groupBy("edge_id").agg(F.max("run_m").alias("run_m"), F.min_by("s", "k").alias("a"), F.max_by("s", "k").alias("b"), F.sum("up").alias("climb"), (F.count("*") == F.count("height")).alias("whole"))
    rise = F.when(F.col("whole") & (F.col("run_m") > 0), (F.col("b") - F.col("a")) / F.col("run_m"))
    return g.select("edge_id", rise.alias("grade"), F.when(F.col("whole"), F.coalesce("climb", F.lit(0.0))).alias("climb_m"))


def with_grades(edges: DataFrame, vertices: DataFrame, raster: DataFrame, grid: Grid, **params) -> DataFrame:
    """``edges`` (edge_id, src, dst, ..) with the ``grade`` of the ground between their vertices, 0 where it is not known."""
    end = lambda k, i: vertices.select(F.col("vertex_id").alias(k), F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{i}"))
    placed = edges.select("edge_id", "src", "dst").join(end("src", 1), "src").join(end("dst", 2), "dst")
    known = edge_grades(placed, raster, grid, **params).select("edge_id", F.col("grade").alias("_grade"))
    return edges.drop("grade").join(known, "edge_id", "left").withColumn("grade", F.coalesce("_grade", F.lit(0.0))).drop("_grade")
