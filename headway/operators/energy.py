"""Energy along matched paths, trip results, stop penalties, charge, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import energy as en
from headway.sources.staging import settle


def path_energy(paths: DataFrame, edges: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(shape_id, vehicle) with energy_used and miles.

    Sums of miles, miles * mph and uphill miles are taken once per shape; each vehicle's linear rate is applied to
    those sums, so further vehicles cost no further pass over the links.
    """
    e = edges.select("edge_id", "miles", (F.col("miles") * F.col("speed_mph")).alias("_ms"), (F.col("miles") * F.greatest(F.col("grade"), F.lit(0.0))).alias("_mg"))
    sums = paths.select("shape_id", "edge_id").join(e, "edge_id").groupBy("shape_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("miles", "_ms", "_mg")])
    used = F.col("rate0") * F.col("miles") + F.col("rate_mph") * F.col("_ms") + F.col("rate_grade") * F.col("_mg")
    return sums.join(F.broadcast(vehicles)).select("shape_id", "vehicle", "energy_unit", "gge_per_unit", used.alias("energy_used"), "miles")


def edge_energy(paths: DataFrame, edges: DataFrame, vehicles: DataFrame, stop_edges: DataFrame | None = None) -> DataFrame:
    """Each link of each path and vehicle with edge_energy; with ``stop_edges`` (trip_id or shape_id, edge_id) stops cost ½mv²."""
    p = paths.join(edges, "edge_id").join(F.broadcast(vehicles))
    used = en.edge_rate(F.col("speed_mph"), F.col("grade")) * F.col("miles")
    if stop_edges is not None:
        key = [c for c in stop_edges.columns if c != "edge_id"]
        flag = stop_edges.select(*key, "edge_id").distinct().withColumn("_stop", F.lit(True))
        p = p.join(flag, [*key, "edge_id"], "left")
        used = used + F.when(F.col("_stop"), en.stop_penalty(F.col("mass_kg"), F.col("speed_mph"), F.col("kind"))).otherwise(F.lit(0.0))
    return p.withColumn("edge_energy", F.coalesce(used, F.lit(0.0))).drop("_stop")


def path_energy_with_stops(paths: DataFrame, edges: DataFrame, vehicles: DataFrame, stop_edges: DataFrame) -> DataFrame:
    """As path_energy, with the energy lost in stops at ``stop_edges`` (shape_id, edge_id)."""
    links = edge_energy(paths.select("shape_id", "edge_id"), edges.select("edge_id", "miles", "speed_mph", "grade"), vehicles, stop_edges)
    return links.groupBy("shape_id", "vehicle", "energy_unit", "gge_per_unit").agg(F.sum("edge_energy").alias("energy_used"), F.coalesce(F.sum("miles"), F.lit(0.0)).alias("miles"))


#: What a rate is made of; an edge table without one of these cannot be rated.
FEATURES = ("edge_id", "miles", "speed_mph", "grade")
#: Bounds of the bins of one vehicle; a larger table of rates is no lookup table.
MAX_BOUNDS = 10_000
#: Bins of a table of rates that is sent to the edges; a larger one is joined by its bins.
MAX_BINS = 200_000


def check_features(edges: DataFrame, features: tuple[str, ...] = FEATURES) -> None:
    missing = [c for c in features if c not in edges.columns]
    if missing:
        raise ValueError(f"edges lack {missing}, which energy rates are made of")


def linear_rates(edges: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(edge_id, vehicle, rate) a mile from each vehicle's coefficients; null where it has none."""
    return edges.select(*FEATURES).join(F.broadcast(vehicles.select("vehicle", "rate0", "rate_mph", "rate_grade"))).select("edge_id", "vehicle", en.edge_rate(F.col("speed_mph"), F.col("grade")).alias("rate"))


def binned_rates(edges: DataFrame, rates: DataFrame) -> DataFrame:
    """(edge_id, vehicle, rate) a mile from a table of bins (vehicle, speed_from, grade_from, rate).

    An edge falls into the bin with the largest bounds not above its speed and grade, or into the lowest one.  The bins
    of a vehicle have to be a full grid; edges without speed or grade get no rate, as do those of a bin that is missing.
    Bins of few distinct values would put all edges into few tasks, so a table of up to MAX_BINS bins goes to the edges.
    """
    by = rates.groupBy("vehicle").agg(F.sort_array(F.collect_set("speed_from")).alias("_s"), F.sort_array(F.collect_set("grade_from")).alias("_g"))
    size, bins = rates.groupBy("vehicle").agg(F.count_distinct("speed_from").alias("s"), F.count_distinct("grade_from").alias("g"), F.count("*").alias("n")).agg(F.max(F.greatest("s", "g")), F.sum("n")).first()
    if size is not None and size > MAX_BOUNDS:
        raise ValueError(f"{size} bounds of bins for one vehicle; at most {MAX_BOUNDS} are a lookup table")
    last = lambda bounds, c: F.when(F.col(c).isNotNull(), F.coalesce(F.array_max(F.filter(bounds, lambda b: b <= F.col(c))), F.get(bounds, F.lit(0))))
    placed = edges.select("edge_id", "speed_mph", "grade").join(F.broadcast(by)).select("edge_id", "vehicle", last("_s", "speed_mph").alias("speed_from"), last("_g", "grade").alias("grade_from"))
    table = rates.select("vehicle", "speed_from", "grade_from", "rate")
    return placed.join(F.broadcast(table) if (bins or 0) <= MAX_BINS else table, ["vehicle", "speed_from", "grade_from"]).select("edge_id", "vehicle", "rate")


#: Rate models by name: (edges, table of the model's parameters) to (edge_id, vehicle, rate).  Others can be added.
RATE_MODELS = {"linear": linear_rates, "binned": binned_rates}


def path_energy_by_rate(paths: DataFrame, edges: DataFrame, vehicles: DataFrame, rates: DataFrame, stop_edges: DataFrame | None = None) -> DataFrame:
    """As path_energy, from rates of edges (edge_id, vehicle, rate) of any model; ``stop_edges`` as in edge_energy.

    Links are counted by (shape, edge) before vehicles multiply them.
    """
    links = paths.groupBy("shape_id", "edge_id").agg(F.count("*").alias("_n"))
    v = vehicles.select("vehicle", "kind", "mass_kg", "energy_unit", "gge_per_unit")
    p = links.join(edges.select("edge_id", "miles", "speed_mph"), "edge_id").join(rates, "edge_id").join(F.broadcast(v), "vehicle")
    used = F.col("rate") * F.col("miles")
    if stop_edges is not None:
        p = p.join(stop_edges.select("shape_id", "edge_id").distinct().withColumn("_stop", F.lit(True)), ["shape_id", "edge_id"], "left")
        used = used + F.when(F.col("_stop"), en.stop_penalty(F.col("mass_kg"), F.col("speed_mph"), F.col("kind"))).otherwise(F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c * F.col("_n")), F.lit(0.0))
    return p.groupBy("shape_id", "vehicle", "energy_unit", "gge_per_unit").agg(total(used).alias("energy_used"), total(F.col("miles")).alias("miles"))


#: Bins into which a range of values is counted on the way to a quantile, and values that are few enough to be put in order.
BINS, FEW = 4_096, 20_000


def _quantiles(rows: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """(by, q, value): of each group of ``rows`` (by, _x) the smallest value that at least the share q of its values does not exceed.

    The values between two bounds are counted by bins; the bin that holds the wanted place has the next bounds, until few values are left
    or all are equal.  So no task sees more than bins or few values of a group, however large it is.
    """
    same = lambda a, b: F.lit(True) if not by else [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    rows = settle(rows.filter("_x IS NOT NULL"), "values")
    finite = F.when(~F.isnan("_x") & (F.abs("_x") < float("inf")), F.col("_x"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    rank = F.greatest(F.ceil(F.col("_q") * F.col("_n")), F.lit(1)).cast("long")
    open_ends = sizes.withColumn("_q", F.explode(F.array(*map(F.lit, at)))).select(*by, "_q", rank.alias("_rank"), "_low", "_high", F.lit(True).alias("_first"), "_n")
    done, step = [], 0
    while True:
        open_ends = settle(open_ends, "ranges")
        if step:
            ended = (F.col("_low").eqNullSafe(F.col("_high"))) & ~F.col("_first")
            done.append(open_ends.filter(ended).select(*by, "_q", F.col("_low").alias("value")))
            few = open_ends.filter(~ended & (F.col("_n") <= FEW))
            open_ends = open_ends.filter(~ended & (F.col("_n") > FEW))
        else:
            few = open_ends.filter(F.col("_n") <= FEW)
            open_ends = open_ends.filter(F.col("_n") > FEW)
        ranges = few.select(*by, "_low", "_high", "_first").distinct()
        held = rows.alias("r").join(_small(ranges).alias("s"), same("r", "s")).filter("_first OR _x BETWEEN _low AND _high")
        w = Window.partitionBy(*[f"s.{c}" for c in by], "_low", "_high").orderBy("_x")
        held = held.select(*[F.col(f"s.{c}") for c in by], "_low", "_high", "_x", F.row_number().over(w).cast("long").alias("_rank"))
        met = few.alias("f").join(held.alias("h"), [*([] if not by else same("f", "h")), F.col("f._low").eqNullSafe(F.col("h._low")), F.col("f._high").eqNullSafe(F.col("h._high")), F.col("f._rank") == F.col("h._rank")])
        done.append(met.select(*[F.col(f"f.{c}") for c in by], "_q", F.col("_x").alias("value")))
        if open_ends.isEmpty():
            break
        ranges = open_ends.select(*by, "_low", "_high", "_first").distinct()
        held = rows.alias("r").join(_small(ranges).alias("s"), same("r", "s")).filter("_first OR _x BETWEEN _low AND _high")
        # halves, as the difference of the bounds may be too large a number
        part = (F.col("_x") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        inside = F.when(F.col("_low") == F.col("_high"), F.lit(0)).otherwise(F.least(F.floor(part * BINS), F.lit(BINS - 1)))
        place = F.when(F.isnan("_x"), BINS + 1).when(F.col("_x") == float("inf"), BINS).when(F.col("_x") == float("-inf"), -1).otherwise(inside)
        counts = held.groupBy(*[F.col(f"s.{c}").alias(c) for c in by], "_low", "_high", place.cast("int").alias("_bin")).agg(F.count("*").alias("_n"), F.min("_x").alias("_from"), F.max("_x").alias("_to"))
        run = Window.partitionBy(*by, "_low", "_high").orderBy("_bin")
        counts = counts.withColumn("_upto", F.sum("_n").over(run))
        met = open_ends.drop("_n").alias("f").join(counts.alias("h"), [*([] if not by else same("f", "h")), F.col("f._low").eqNullSafe(F.col("h._low")), F.col("f._high").eqNullSafe(F.col("h._high")), F.col("_rank") <= F.col("_upto"), F.col("_rank") > F.col("_upto") - F.col("h._n")])
        open_ends = met.select(*[F.col(f"f.{c}") for c in by], "_q", (F.col("_rank") - F.col("_upto") + F.col("h._n")).alias("_rank"), F.col("_from").alias("_low"), F.col("_to").alias("_high"), F.lit(False).alias("_first"), "_n")
        step += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _small(ranges: DataFrame) -> DataFrame:
    """A table that is sent to all tasks where it is small."""
    return F.broadcast(ranges) if ranges.limit(10_001).count() <= 10_000 else ranges


def describe(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """n, avg, std, min, quartiles and max of a column by group; quartiles are exact values of the column."""
    rows = settle(df.select(*by, F.col(column).cast("double").alias("_x")), "values")
    whole = rows.groupBy(*by).agg(F.count("_x").alias("n"), F.avg("_x").alias("avg"), F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"))
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    q = _quantiles(rows, by, list(names)).groupBy(*by).agg(*[F.max(F.when(F.col("_q") == k, F.col("value"))).alias(n) for k, n in names.items()])
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by] or F.lit(True)
    return whole.alias("w").join(q.alias("q"), on, "left").select(*[F.col(f"w.{c}") for c in by], "n", "avg", "std", "min", *names.values(), "max")


def charge_left(shape_energy: DataFrame, vehicles: DataFrame, start_soc: float = 100.0) -> DataFrame:
    """Adds trip_soc, the charge of battery vehicles at the end of a path, and in_reach, whether it stays above zero;
    null and true for others."""
    v = vehicles.select("vehicle", "kind", "battery_kwh")
    left = F.when(F.col("kind") == "bev", en.state_of_charge(F.lit(start_soc), F.col("energy_used"), F.col("battery_kwh")))
    return shape_energy.join(F.broadcast(v), "vehicle").withColumn("trip_soc", left).withColumn("in_reach", F.coalesce(left > 0, F.lit(True))).drop("kind", "battery_kwh")


def charge_trace(links: DataFrame, start_soc: float = 100.0) -> DataFrame:
    """Adds trip_energy (running) and trip_soc to links of battery vehicles (shape_id, seq, vehicle, edge_energy)."""
    w = Window.partitionBy("shape_id", "vehicle").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = links.filter("kind = 'bev'").withColumn("trip_energy", F.sum("edge_energy").over(w))
    return run.withColumn("trip_soc", en.state_of_charge(F.lit(start_soc), F.col("trip_energy"), F.col("battery_kwh")))


def trip_charge(trips: DataFrame, paths: DataFrame, edges: DataFrame, vehicles: DataFrame, stop_edges: DataFrame) -> DataFrame:
    """(trip_id, vehicle, energy_used, end_soc, empty_seq) of battery vehicles, with parameters of each trip.

    ``trips``: trip_id, shape_id, start_soc (null: full) and include_stop_penalty (null: yes).  ``stop_edges`` are (shape_id, edge_id).
    The charge is carried along the path and stops at empty; ``empty_seq`` is the first link that the charge does not last for, null if it lasts.
    Links are rated once a shape and vehicle, with and without the penalty; only their running sums meet the trips.
    """
    bev = vehicles.filter("kind = 'bev'")
    links = edge_energy(paths.select("shape_id", "seq", "edge_id"), edges.select("edge_id", "miles", "speed_mph", "grade"), bev).withColumn("_plain", F.col("edge_energy"))
    flag = stop_edges.select("shape_id", "edge_id").distinct().withColumn("_stop", F.lit(True))
    lost = F.when(F.col("_stop"), en.stop_penalty(F.col("mass_kg"), F.col("speed_mph"), F.col("kind"))).otherwise(F.lit(0.0))
    links = links.join(flag, ["shape_id", "edge_id"], "left").withColumn("_stopping", F.col("_plain") + F.coalesce(lost, F.lit(0.0)))
    w = Window.partitionBy("shape_id", "vehicle").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = links.select("shape_id", "vehicle", "battery_kwh", "seq", F.sum("_plain").over(w).alias("_plain"), F.sum("_stopping").over(w).alias("_stopping"))
    # one row a shape and vehicle: the running sums in order
    ways = runs.groupBy("shape_id", "vehicle", "battery_kwh").agg(F.sort_array(F.collect_list(F.struct("seq", "_plain", "_stopping"))).alias("way"))
    t = trips.select("trip_id", "shape_id", F.coalesce("start_soc", F.lit(100.0)).alias("start_soc"), F.coalesce("include_stop_penalty", F.lit(True)).alias("stops")).join(ways, "shape_id")
    used = lambda x: F.when(F.col("stops"), x["_stopping"]).otherwise(x["_plain"])
    limit = F.col("start_soc") / 100 * F.col("battery_kwh")
    total = used(F.element_at("way", -1))
    end = F.greatest(en.state_of_charge(F.col("start_soc"), total, F.col("battery_kwh")), F.lit(0.0))
    return t.select("trip_id", "vehicle", total.alias("energy_used"), end.alias("end_soc"), F.get(F.filter("way", lambda x: used(x) > limit), F.lit(0))["seq"].alias("empty_seq"))


def turn_delays(path_headings: DataFrame) -> DataFrame:
    """Adds delay_s at the start of each link, from the headings of it and of the link before."""
    w = Window.partitionBy("shape_id").orderBy("seq")
    return path_headings.withColumn("delay_s", en.turn_delay(F.lag("heading").over(w), F.col("heading")))


def trip_results(shape_energy: DataFrame, trips: DataFrame, hvac: DataFrame | None = None) -> DataFrame:
    """Trip rows: energy, miles, unit, mpge; with HVAC three scenario rows, in which kWh rows include HVAC energy."""
    r = shape_energy.join(trips.select("trip_id", "shape_id").distinct(), "shape_id")
    if hvac is not None:
        r = r.join(hvac.select("trip_id", "scenario", "hvac_energy_kwh"), "trip_id", "left")
        r = r.withColumn("energy_used", F.when(F.col("energy_unit") == "kWh", F.col("energy_used") + F.col("hvac_energy_kwh")).otherwise(F.col("energy_used")))
    r = r.withColumn("mpge", en.mpge(F.col("miles"), F.col("energy_used"), F.col("gge_per_unit")))
    more = trips.drop("shape_id", "service_id", "route_short_name", "route_desc", "route_type")
    return r.join(more, "trip_id").drop("gge_per_unit")


def link_results(links: DataFrame, shape_energy: DataFrame) -> DataFrame:
    """Matched links with their whole shape's energy_used; edge_energy, where present, is the link's own."""
    return links.join(shape_energy.select("shape_id", "vehicle", "energy_used", "energy_unit"), "shape_id", "left")
