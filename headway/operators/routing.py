"""Shortest paths over tiles of a network, and paths from nearest edges.

No network passes through the driver or travels with the tasks: a task sees the edges of one tile.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import geo
from headway.operators import cells, search
from headway.operators.spatial import nearest_edge
from headway.sources.staging import forget, settle

#: Vertices of a tile of the network.
TILE_VERTICES = search.TILE_VERTICES
#: Pairs of portals inside tiles, as a multiple of the roads, beyond which a network has no tiles worth the name.
MOST_PAIRS = 64


def shortest_paths(ods: DataFrame, vertices: DataFrame, edges: DataFrame, tile_vertices: int = TILE_VERTICES) -> DataFrame:
    """Routed shapes (one row per point) of ODs (od_key, o_lat, o_lon, d_lat, d_lon) by least travel time.

    Ends snap to their nearest vertex; ODs that name their vertices (od_key, o, d) keep them, as several may stand in one place.
    ODs without a route give no rows; the caller draws a straight line.
    """
    named = {"o", "d"} <= set(ods.columns)
    return path_shapes(overlay_paths(ods if named else snapped(ods, vertices), vertices, edges, tile_vertices), vertices)


def overlay_paths(ods: DataFrame, vertices: DataFrame, edges: DataFrame, tile_vertices: int = TILE_VERTICES) -> DataFrame:
    """(od_key, minutes, path) of ODs (od_key, o, d), as ``fastest_paths``, in rounds that grow with the tiles crossed.

    Tiles are cells of a quadtree with at most ``tile_vertices`` vertices.  The search goes over their portals: ends of
    edges between tiles, and the ODs' own vertices.  Ways between portals inside a tile are found a tile at a time, each with its
    own edges only; the rounds of joins move over these ways and over the edges between tiles, and the ways in use are
    unfolded at the end.  Of equally fast paths any one may be given.

    Where roads lead anywhere rather than to neighbours, nearly all vertices are portals and their pairs grow with the square of
    a tile; such a network is searched by ``fastest_paths``.
    """
    tile = cells.tiles(vertices, tile_vertices)
    end = lambda k, name: tile.select(F.col("vertex_id").alias(k), F.col("tile").alias(name))
    cost = F.try_divide(60 * F.col("miles"), "speed_mph")
    roads = edges.filter("miles > 0").select("src", "dst", cost.alias("cost")).filter("cost > 0").groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    roads = settle(roads.join(end("src", "tile"), "src").join(end("dst", "to_tile"), "dst"), "roads")
    inner, between = roads.filter("tile = to_tile").select("tile", "src", "dst", "cost"), roads.filter("tile <> to_tile")
    wanted = settle(ods.filter("o IS NOT NULL AND d IS NOT NULL AND o <> d").select("od_key", F.col("o").cast("long").alias("o"), F.col("d").cast("long").alias("d")), "wanted")
    entering = between.select(F.col("dst").alias("vertex_id")).union(wanted.select("o")).select("vertex_id", F.lit("in").alias("side"))
    leaving = between.select(F.col("src").alias("vertex_id")).union(wanted.select("d")).select("vertex_id", F.lit("out").alias("side"))
    portals = settle(entering.union(leaving).distinct().join(tile, "vertex_id").select(F.col("tile").alias("_tile"), "vertex_id", "side"), "portals")
    each = portals.groupBy("_tile").agg((F.count_if(F.col("side") == "in") * F.count_if(F.col("side") == "out")).alias("pairs"))
    if (each.agg(F.sum("pairs")).first()[0] or 0) > MOST_PAIRS * roads.count() + tile_vertices:
        placed = edges.join(end("src", "_a"), "src", "left_semi").join(end("dst", "_b"), "dst", "left_semi")
        return fastest_paths(wanted, placed)

    def through(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(e) and len(p):
            into, outof = (p["vertex_id"][p["side"] == k].tolist() for k in ("in", "out"))
            rows = [r[:3] for r in search.ways_inside(e["src"].tolist(), e["dst"].tolist(), e["cost"].tolist(), dict.fromkeys(into, outof), paths=False)]
        return pd.DataFrame(rows, columns=["state", "next", "cost"])

    folded = cells.dealt(inner, "tile", tile, "tile").cogroup(cells.dealt(portals, "_tile", tile, "tile")).applyInPandas(through, "state long, next long, cost double")
    moves = settle(folded.union(between.select("src", "dst", "cost")), "moves")
    starts = wanted.select("o").distinct().select("o", F.col("o").alias("state"), F.lit(0.0).alias("cost"))
    goals = wanted.select("o", F.col("d").alias("goal"), F.col("d").alias("state")).distinct()
    best = search.least_costs(starts, moves, goals)
    found = settle(wanted.join(best.select("o", F.col("state").alias("d"), F.col("cost").alias("minutes")), ["o", "d"]), "found")
    ways = settle(search.ways_back(found.select(F.col("od_key").alias("key"), "o", F.col("d").alias("state")), best), "ways")
    hops = ways.select("key", F.posexplode(F.arrays_zip(F.slice("states", 1, F.size("states") - 1).alias("a"), F.slice("states", 2, F.size("states") - 1).alias("b"))).alias("k", "hop"))
    hops = hops.select("key", "k", "hop.a", "hop.b").join(end("a", "tile"), "a").join(end("b", "to_tile"), "b")
    used = hops.filter("tile = to_tile").select(F.col("tile").alias("_tile"), "a", "b").distinct()

    def unfolded(e: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(e) and len(u):
            wanted_of = u.groupby("a")["b"].apply(list).to_dict()
            rows = [(a, b, path[1:]) for a, b, _, path in search.ways_inside(e["src"].tolist(), e["dst"].tolist(), e["cost"].tolist(), wanted_of)]
        return pd.DataFrame(rows, columns=["a", "b", "more"])

    inside = inner.groupBy("tile").cogroup(used.groupBy("_tile")).applyInPandas(unfolded, "a long, b long, more array<long>")
    pieces = hops.join(inside, ["a", "b"], "left").select("key", "k", F.coalesce("more", F.array("b")).alias("more"))
    paths = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "more"))).alias("p"))
    paths = paths.select(F.col("key").alias("od_key"), F.flatten(F.transform("p", lambda x: x["more"])).alias("_path"))
    return found.join(paths, "od_key").select("od_key", "minutes", F.concat(F.array("o"), "_path").alias("path"))


def snapped(ods: DataFrame, vertices: DataFrame) -> DataFrame:
    """(od_key, o, d): the vertices nearest to the ends of ODs; ODs whose ends lack coordinates or meet in one vertex go."""
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    at = vertices.select(F.col("vertex_id").alias("edge_id"), x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2"))
    end = lambda k: ods.select("od_key", F.lit(k).alias("end"), F.col(f"{k}_lat").alias("lat"), F.col(f"{k}_lon").alias("lon"))
    points = end("o").unionByName(end("d")).select(F.struct("od_key", "end").alias("point_id"), x.alias("x"), y.alias("y"))
    near = nearest_edge(points, at).select("point_id.*", "edge_id")
    both = near.groupBy("od_key").agg(F.max(F.when(F.col("end") == "o", F.col("edge_id"))).alias("o"), F.max(F.when(F.col("end") == "d", F.col("edge_id"))).alias("d"))
    return both.filter("o <> d")


def fastest_paths(ods: DataFrame, edges: DataFrame) -> DataFrame:
    """(od_key, minutes, path) of ODs (od_key, o, d) over a network of any size, all by joins; ``path`` lists vertices.

    One search serves all ODs of an origin.  A round extends the places reached or bettered in the round before by one
    edge and keeps the least time of each (origin, vertex); the search of an origin stops beyond the time of its
    slowest destination, once all are reached, and ends when nothing is bettered.  Each round is written down and the
    one before is removed, so a lost executor costs a part of one round.  Costs have to be positive; edges without a
    speed or length are not used.  ODs without a route, or with a null end, give no rows; of equally fast paths one
    with the fewest edges stays, then the one whose vertices are smallest from the start.
    """
    roads = edges.filter("miles > 0").withColumn("cost", F.try_divide(60 * F.col("miles"), "speed_mph")).filter("cost > 0").select(F.col("src").alias("vertex"), "dst", "cost")
    wanted = settle(ods.filter("o IS NOT NULL AND d IS NOT NULL").select("od_key", "o", "d"), "wanted")
    goals = wanted.select("o", F.col("d").alias("vertex")).distinct()
    at = F.col("o").cast("long")
    best = fresh = settle(wanted.select("o").distinct().select("o", at.alias("vertex"), F.lit(0.0).alias("minutes"), F.array(at).alias("path")), "reached")
    while not fresh.isEmpty():
        reached = goals.join(best.select("o", "vertex", "minutes"), ["o", "vertex"], "left").groupBy("o")
        bound = reached.agg(F.when(F.count("minutes") == F.count("*"), F.max("minutes")).alias("bound"))
        on = fresh.join(bound, "o").filter("bound IS NULL OR minutes < bound").join(roads, "vertex")
        on = on.select("o", F.col("dst").alias("vertex"), (F.col("minutes") + F.col("cost")).alias("minutes"), F.concat("path", F.array("dst")).alias("path"))
        known = best.withColumn("_new", F.lit(0)).unionByName(on.withColumn("_new", F.lit(1)))
        now = known.groupBy("o", "vertex").agg(F.min(F.struct("minutes", "_new", "path")).alias("b"))
        after = settle(now.select("o", "vertex", "b.*"), "reached")
        forget(best)
        best = after.drop("_new")
        best.stored_at = after.stored_at
        fresh = after.filter("_new = 1").drop("_new")
    return wanted.join(best.withColumnRenamed("vertex", "d"), ["o", "d"]).filter("o <> d").select("od_key", "minutes", "path")


def path_shapes(paths: DataFrame, vertices: DataFrame) -> DataFrame:
    """Shapes (one row per vertex) of paths (od_key, path)."""
    w = Window.partitionBy("shape_id").orderBy("shape_pt_sequence")
    at = paths.select(F.col("od_key").alias("shape_id"), F.posexplode("path").alias("k", "vertex_id")).join(vertices.select("vertex_id", "lat", "lon"), "vertex_id")
    at = at.select("shape_id", (F.col("k") + 1).alias("shape_pt_sequence"), F.col("lat").alias("shape_pt_lat"), F.col("lon").alias("shape_pt_lon"))
    km = geo.haversine_km(F.lag("shape_pt_lat").over(w), F.lag("shape_pt_lon").over(w), F.col("shape_pt_lat"), F.col("shape_pt_lon"))
    steps = at.withColumn("_km", F.coalesce(km, F.lit(0.0)))
    return steps.withColumn("shape_dist_traveled", F.sum("_km").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_km")


def match_nearest(trace: DataFrame, nearest: DataFrame) -> DataFrame:
    """Path edges (shape_id, seq, edge_id) from each point's nearest edge, runs of one edge counted once: all DataFrame."""
    w = Window.partitionBy("shape_id").orderBy("second")
    p = trace.join(nearest.select("point_id", "edge_id"), "point_id").withColumn("_prev", F.lag("edge_id").over(w))
    return p.filter("_prev IS NULL OR _prev <> edge_id").select("shape_id", F.row_number().over(w).alias("seq"), "edge_id")


def nearest_of_path(trace: DataFrame, path: DataFrame, edges: DataFrame) -> DataFrame:
    """Each point of a trace (shape_id, second, ...) with the nearest edge of its own shape's path, ties to the earlier
    one; pairs are those within one shape.  Adds edge_id, miles and speed_mph."""
    (x1, y1), (x2, y2) = geo.mercator(F.col("lat1"), F.col("lon1")), geo.mercator(F.col("lat2"), F.col("lon2"))
    along = path.select("shape_id", "seq", "edge_id").join(edges.select("edge_id", "miles", "speed_mph", x1.alias("_x1"), y1.alias("_y1"), x2.alias("_x2"), y2.alias("_y2")), "edge_id")
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    met = trace.withColumn("_x", x).withColumn("_y", y).join(along, "shape_id")
    met = met.withColumn("_d", geo.segment_distance(F.col("_x"), F.col("_y"), F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2")))
    best = met.groupBy("shape_id", "second").agg(F.min(F.struct("_d", "seq", "edge_id", "miles", "speed_mph")).alias("b"))
    return trace.join(best.select("shape_id", "second", "b.edge_id", "b.miles", "b.speed_mph"), ["shape_id", "second"])
