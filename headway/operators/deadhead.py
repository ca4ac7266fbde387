"""Deadhead trips: between trips of a block, and from and to depots; their stops and straight-line shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import clock, geo


def first_arrivals(stop_times: DataFrame) -> DataFrame:
    return stop_times.groupBy("trip_id").agg(F.min("arrival_s").alias("first_s"))


def midblock_trips(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """A trip from each trip of a block to its successor by first arrival, ties by trip_id; ids are kept as columns."""
    w = Window.partitionBy("block_id").orderBy("first_s", "trip_id")
    t = trips.filter("block_id IS NOT NULL").join(first_arrivals(stop_times), "trip_id", "left").withColumn("to_trip", F.lead("trip_id").over(w)).filter("to_trip IS NOT NULL")
    name = F.concat("trip_id", F.lit("_to_"), "to_trip")
    null = F.lit(None).cast("string")
    return t.select(
        name.alias("trip_id"), F.col("trip_id").alias("from_trip"), "to_trip", "route_id", "service_id", "block_id", name.alias("shape_id"), null.alias("route_short_name"),
        F.lit(3).alias("route_type"), F.concat(F.lit("Deadhead_from_"), name).alias("route_desc"), null.alias("agency_id"), F.lit("mid_block_deadhead").alias("trip_type"),
    )


def midblock_legs(deadheads: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per mid-block trip: where and when it leaves and arrives, at 30 km/h or as late as scheduled."""
    ends = stop_times.groupBy("trip_id").agg(
        F.max_by(F.struct("stop_id", "departure_s"), "stop_sequence").alias("last"), F.min_by(F.struct("stop_id", "arrival_s"), "stop_sequence").alias("first")
    )
    o = ends.select(F.col("trip_id").alias("from_trip"), F.col("last.stop_id").alias("o_stop"), F.col("last.departure_s").alias("depart_s"))
    d = ends.select(F.col("trip_id").alias("to_trip"), F.col("first.stop_id").alias("d_stop"), F.col("first.arrival_s").alias("due_s"))
    so = stops.select(F.col("stop_id").alias("o_stop"), F.col("stop_lat").alias("o_lat"), F.col("stop_lon").alias("o_lon"))
    sd = stops.select(F.col("stop_id").alias("d_stop"), F.col("stop_lat").alias("d_lat"), F.col("stop_lon").alias("d_lon"))
    legs = deadheads.select("trip_id", "block_id", "from_trip", "to_trip").join(o, "from_trip", "left").join(d, "to_trip", "left").join(so, "o_stop", "left").join(sd, "d_stop", "left")
    travel = clock.travel_seconds(geo.geodesic_m(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon")))
    return legs.withColumn("arrive_s", F.least("due_s", F.col("depart_s") + travel)).filter(~((F.col("o_lat") == F.col("d_lat")) & (F.col("o_lon") == F.col("d_lon"))))


def leg_stops(legs: DataFrame, prefix: str) -> DataFrame:
    """Two stop rows per leg: departure at its origin, arrival at its destination, with ids made from trip and leg."""
    row = lambda seq, time, lat, lon: F.struct(F.lit(seq).alias("stop_sequence"), F.col(time).cast("double").alias("time_s"), F.col(lat).alias("stop_lat"), F.col(lon).alias("stop_lon"))
    rows = legs.select("trip_id", F.explode(F.array(row(1, "depart_s", "o_lat", "o_lon"), row(2, "arrive_s", "d_lat", "d_lon"))).alias("r")).select("trip_id", "r.*")
    return rows.select(
        "trip_id", "stop_sequence", F.concat(F.lit(prefix), F.col("trip_id"), F.lit("_"), F.col("stop_sequence")).alias("stop_id"), F.col("time_s").alias("arrival_s"), F.col("time_s").alias("departure_s"),
        F.lit(0.0).alias("shape_dist_traveled"), "stop_lat", "stop_lon",
    )


def block_ends(trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """First and last stop and trip of each block, in one pass: ordered by arrival, sequence and trip."""
    st = stop_times.filter("arrival_s IS NOT NULL").select("trip_id", "stop_sequence", "stop_id", "arrival_s", "departure_s").join(trips.filter("block_id IS NOT NULL").select("trip_id", "block_id"), "trip_id")
    order = F.struct("arrival_s", "stop_sequence", "trip_id")
    what = F.struct("trip_id", "stop_id", "arrival_s", "departure_s")
    ends = st.groupBy("block_id").agg(F.min_by(what, order).alias("a"), F.max_by(what, order).alias("z"))
    ends = ends.select("block_id", F.col("a.stop_id").alias("a_stop"), F.col("a.arrival_s").alias("a_arrival_s"), F.col("z.stop_id").alias("z_stop"), F.col("z.departure_s").alias("z_departure_s"))
    for side in "az":
        ends = ends.join(stops.select(F.col("stop_id").alias(f"{side}_stop"), F.col("stop_lat").alias(f"{side}_lat"), F.col("stop_lon").alias(f"{side}_lon")), f"{side}_stop", "left")
    return ends


def assign_depots(ends: DataFrame, depots: DataFrame, max_depots: int = 100_000) -> DataFrame:
    """The depot of each block with the least Web-Mercator way out and in; ties go to the lowest index.

    The depots' coordinates are gathered into one array of checked size, so each block finds its depot without a
    row per pair.
    """
    if depots.count() > max_depots:
        raise ValueError(f"more than {max_depots} depots: they are meant to be a small table")
    dx, dy = geo.mercator(F.col("lat"), F.col("lon"))
    listed = depots.agg(F.sort_array(F.collect_list(F.struct("idx", "lat", "lon", dx.alias("x"), dy.alias("y")))).alias("depots"))
    ax, ay = geo.mercator(F.col("a_lat"), F.col("a_lon"))
    zx, zy = geo.mercator(F.col("z_lat"), F.col("z_lon"))
    e = ends.join(F.broadcast(listed))  # at most max_depots depots
    e = e.withColumns({"_ax": ax, "_ay": ay, "_zx": zx, "_zy": zy})

    def total(d: Column) -> Column:
        way = geo.planar(F.col("_ax"), F.col("_ay"), d["x"], d["y"]) + geo.planar(F.col("_zx"), F.col("_zy"), d["x"], d["y"])
        return F.struct(F.round(way, 3).alias("total"), d["idx"].alias("idx"), d["lat"].alias("lat"), d["lon"].alias("lon"), way.alias("way"))

    e = e.withColumn("_best", F.array_min(F.transform("depots", total)))
    return e.select(*ends.columns, F.col("_best.idx").alias("depot_idx"), F.col("_best.lat").alias("depot_lat"), F.col("_best.lon").alias("depot_lon"), F.col("_best.way").alias("depot_way"))


def depot_trips(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """A pull-out before the first and a pull-in after the last service trip of each block."""
    if "from_trip" in trips.columns:
        trips = trips.filter("from_trip IS NULL")
    t = trips.filter("block_id IS NOT NULL").join(first_arrivals(stop_times), "trip_id", "left")
    agency = F.col("agency_id") if "agency_id" in trips.columns else F.lit(None).cast("string").alias("agency_id")
    what, order = F.struct("trip_id", "service_id", agency.alias("agency_id")), F.struct("first_s", "trip_id")
    b = t.groupBy("block_id").agg(F.min_by(what, order).alias("a"), F.max_by(what, order).alias("z"))
    out = F.struct(F.lit("pull-out").alias("trip_type"), F.concat(F.lit("depot_to_"), F.col("a.trip_id")).alias("trip_id"), F.concat(F.lit("from_depot_"), F.col("block_id")).alias("route_id"), F.col("a").alias("t"), F.concat(F.lit("Deadhead from depot to "), F.col("a.trip_id")).alias("route_desc"))
    back = F.struct(F.lit("pull-in").alias("trip_type"), F.concat(F.col("z.trip_id"), F.lit("_to_depot")).alias("trip_id"), F.concat(F.lit("to_depot_"), F.col("block_id")).alias("route_id"), F.col("z").alias("t"), F.concat(F.lit("Deadhead from "), F.col("z.trip_id"), F.lit(" to depot")).alias("route_desc"))
    r = b.select("block_id", F.explode(F.array(out, back)).alias("r"))
    return r.select("r.trip_id", "r.route_id", F.col("r.t.service_id").alias("service_id"), "block_id", F.col("r.route_id").alias("shape_id"), F.col("r.route_id").alias("route_short_name"), F.lit(3).alias("route_type"), "r.route_desc", F.col("r.t.agency_id").alias("agency_id"), "r.trip_type", F.col("r.t.trip_id").alias("service_trip"))


def depot_legs(depot: DataFrame, placed: DataFrame) -> DataFrame:
    """Legs of pull-outs and pull-ins; a pull-out may leave before midnight."""
    p = depot.select("trip_id", "trip_type", "block_id").join(placed, "block_id")
    out = F.col("trip_type") == "pull-out"
    pick = lambda a, b: F.when(out, F.col(a)).otherwise(F.col(b))
    p = p.withColumns({"o_lat": pick("depot_lat", "z_lat"), "o_lon": pick("depot_lon", "z_lon"), "d_lat": pick("a_lat", "depot_lat"), "d_lon": pick("a_lon", "depot_lon")})
    p = p.withColumn("_t", clock.travel_seconds(geo.geodesic_m(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon"))))
    return p.withColumns({"depart_s": F.when(out, F.col("a_arrival_s") - F.col("_t")).otherwise(F.col("z_departure_s")), "arrive_s": F.when(out, F.col("a_arrival_s")).otherwise(F.col("z_departure_s") + F.col("_t"))}).drop("_t")


def leg_times(legs: DataFrame) -> DataFrame:
    """start_time, end_time and minutes (2 decimals) of deadhead trips."""
    return legs.select("trip_id", clock.hms(F.col("depart_s")).alias("start_time"), clock.hms(F.col("arrive_s")).alias("end_time"), F.round((F.col("arrive_s") - F.col("depart_s")) / 60.0, 2).alias("trip_duration_minutes"))


def od_key() -> Column:
    p = lambda c: F.round(c, 3).cast("string")
    return F.concat(p("o_lon"), F.lit(","), p("o_lat"), F.lit("->"), p("d_lon"), F.lit(","), p("d_lat"))


def unique_ods(legs: DataFrame, order: str = "trip_id") -> DataFrame:
    """One representative per key of ends rounded to three decimals, the first by ``order``, with its length."""
    keyed = legs if "od_key" in legs.columns else legs.withColumn("od_key", od_key())
    r = keyed.groupBy("od_key").agg(F.min_by(F.struct("o_lat", "o_lon", "d_lat", "d_lon"), order).alias("r"), F.count("*").alias("n_legs")).select("od_key", "n_legs", "r.*")
    return r.withColumn("distance_m", geo.haversine_km(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon")) * 1000)


def straight_shapes(ods: DataFrame) -> DataFrame:
    """Two-point shapes: for short ways, and for those no route was found for."""
    pt = lambda seq, lat, lon, km: F.struct(F.lit(seq).alias("shape_pt_sequence"), F.col(lat).alias("shape_pt_lat"), F.col(lon).alias("shape_pt_lon"), km.alias("shape_dist_traveled"))
    km = geo.haversine_km(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon"))
    return ods.select(F.col("od_key").alias("shape_id"), F.explode(F.array(pt(1, "o_lat", "o_lon", F.lit(0.0)), pt(2, "d_lat", "d_lon", km))).alias("p")).select("shape_id", "p.*")


def deadhead_shapes(legs: DataFrame, router=None, min_distance_m: float = 200.0) -> tuple[DataFrame, DataFrame]:
    """(shapes, trip_id with shape_id).  ``router`` maps ODs to routed shapes; what it leaves out gets a straight line."""
    if "trip_type" in legs.columns:
        # ways from and to depots have shapes of their own, so that none is shared with a way between trips
        side = F.when(F.col("trip_type") == "pull-out", F.lit("from_depot_")).when(F.col("trip_type") == "pull-in", F.lit("to_depot_")).otherwise(F.lit(""))
        legs = legs.withColumn("od_key", F.concat(side, od_key()))
    else:
        legs = legs.withColumn("od_key", od_key())
    ods = unique_ods(legs)
    mapping = legs.select("trip_id", F.col("od_key").alias("shape_id"))
    if router is None:
        return straight_shapes(ods), mapping
    routed = router(ods.filter(F.col("distance_m") >= min_distance_m))
    rest = ods.join(routed.select(F.col("shape_id").alias("od_key")).distinct(), "od_key", "left_anti")
    return routed.unionByName(straight_shapes(rest)), mapping
