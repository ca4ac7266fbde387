"""Cells of a quadtree that adapts to where points are: a crowded place is split until no cell holds too many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from headway.sources.staging import settle

#: Levels of the tree; a cell of the last one is the 16-millionth part of the box along each side.
DEPTH = 24


def _spread(v: Column) -> Column:
    """The bits of a number below 2 ** 32, each moved to the even place of twice its order."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def code(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """The cell of the last level that (x, y) lies in; each two bits less is the cell one level above."""
    x0, y0, x1, y1 = box
    place = lambda v, low, high: F.least(F.greatest(F.floor((v - low) / F.lit((high - low) or 1.0) * (1 << DEPTH)), F.lit(0)), F.lit((1 << DEPTH) - 1)).cast("long")
    return _spread(place(x, x0, x1)).bitwiseOR(F.shiftleft(_spread(place(y, y0, y1)), 1))


def box_of(points: DataFrame, x: str = "x", y: str = "y") -> tuple[float, float, float, float]:
    r = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return tuple(0.0 if v is None else float(v) for v in r)


def leaves(codes: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, n): the cells, from the root down, that hold at most ``limit`` of the rows (``code``), or are of the last level.

    One round a level, over counts of the cells that are still too full.
    """
    found, depth = [], 0
    counts = settle(codes.groupBy("code").agg(F.count("*").alias("n")), "cells")
    while True:
        prefix = F.shiftright("code", 2 * (DEPTH - depth)).alias("prefix")
        at = settle(counts.groupBy(prefix).agg(F.sum("n").alias("n")).withColumn("depth", F.lit(depth)), "cells")
        fits = at if depth == DEPTH else at.filter(F.col("n") <= limit)
        found.append(fits.select("depth", "prefix", "n"))
        full = at.filter(F.col("n") > limit).select("prefix")
        if depth == DEPTH or full.isEmpty():
            return reduce(DataFrame.union, found)
        counts = counts.withColumn("prefix", prefix).join(full, "prefix", "left_semi").drop("prefix")
        depth += 1


def placed(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """``rows`` (with ``code``) with the ``depth`` and ``prefix`` of their leaf; rows outside all leaves go."""
    depths = sorted(r[0] for r in tree.select("depth").distinct().collect())  # at most DEPTH + 1
    if not depths:
        return rows.withColumn("depth", F.lit(0)).withColumn("prefix", F.lit(0).cast("long")).filter("false")
    each = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    each = each.withColumn("prefix", F.expr(f"shiftright(code, CAST(2 * ({DEPTH} - depth) AS INT))"))
    return each.join(tree.select("depth", "prefix"), ["depth", "prefix"])


def tiles(vertices: DataFrame, limit: int) -> DataFrame:
    """(vertex_id, tile, code): the leaf of a quadtree that each of ``vertices`` (vertex_id, lat, lon) lies in, at most ``limit`` in
    one, and the cell of the last level."""
    known = vertices.select("vertex_id", F.col("lon").alias("x"), F.col("lat").alias("y")).dropna()
    at = known.select("vertex_id", code(F.col("x"), F.col("y"), box_of(known)).alias("code"))
    tree = settle(leaves(at, limit), "tiles")
    return settle(placed(at, tree).select("vertex_id", F.concat_ws(":", "depth", "prefix").alias("tile"), "code"), "tiles")


def dealt(rows: DataFrame, key: str, known: DataFrame, name: str) -> GroupedData:
    """``rows`` by tile in as many tasks as there are tiles (``name`` of ``known``), at most spark.sql.shuffle.partitions: small as
    its rows are, a tile is long work, and Spark would put many into one task."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = known.select(name).distinct().limit(most).count()
    return rows.repartition(max(n, 1), key).groupBy(key)
