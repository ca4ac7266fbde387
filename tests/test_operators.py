import numpy as np
import pytest
from headway.functions import energy as en
from headway.operators import deadhead, energy, matching, routing, service, shapes, spatial, thermal
from pyspark.sql import functions as F

TRIPS = "trip_id string, route_id string, service_id string, block_id string, shape_id string, agency_id string"
TIMES = "trip_id string, stop_sequence int, stop_id string, arrival_s long, departure_s long"
STOPS = "stop_id string, stop_lat double, stop_lon double"


@pytest.fixture(scope="module")
def feed(spark):
    trips = spark.createDataFrame([("T1", "R", "S1", "B1", "SH1", "A"), ("T2", "R", "S1", "B1", "SH2", "A"), ("T3", "R", "S1", "B2", "SH3", None), ("T4", "R", "S1", None, "SH4", None)], TRIPS)
    h = 3600
    times = spark.createDataFrame([("T1", 1, "S1", 8 * h, 8 * h), ("T1", 2, "S2", 8 * h + 1800, 8 * h + 1800), ("T2", 1, "S3", 9 * h, 9 * h), ("T2", 2, "S4", 9 * h + 1800, 9 * h + 1800), ("T3", 1, "S5", 10 * h, 10 * h), ("T3", 2, "S6", 10 * h + 1800, 10 * h + 1800)], TIMES)
    stops = spark.createDataFrame([(f"S{i}", 40 + (i - 1) / 10, -105 - (i - 1) / 10) for i in range(1, 7)], STOPS)
    return trips, times, stops


def test_mid_block(feed):
    trips, times, stops = feed
    t = deadhead.midblock_trips(trips, times)
    rows = t.collect()
    assert [(r.trip_id, r.trip_type, r.block_id, r.shape_id) for r in rows] == [("T1_to_T2", "mid_block_deadhead", "B1", "T1_to_T2")]
    legs = deadhead.midblock_legs(t, times, stops)
    out = deadhead.leg_stops(legs, "mid_block_deadhead_").orderBy("stop_sequence").collect()
    assert [(r.stop_sequence, round(r.stop_lat, 6)) for r in out] == [(1, 40.1), (2, 40.2)]
    assert out[0].arrival_s == 30600 and out[1].arrival_s == pytest.approx(30600 + 1679.55, abs=0.1)  # 14 km at 30 km/h
    assert len({r.stop_id for r in out}) == 2


def test_no_blocks_give_no_rows(feed):
    trips, times, _ = feed
    assert deadhead.midblock_trips(trips.filter("block_id IS NULL"), times).count() == 0
    assert deadhead.depot_trips(trips.filter("block_id IS NULL"), times).count() == 0


def test_depot(spark, feed):
    trips, times, stops = feed
    t = deadhead.depot_trips(trips, times)
    ids = {r.trip_id for r in t.collect()}
    assert ids == {"depot_to_T1", "T2_to_depot", "depot_to_T3", "T3_to_depot"} and {r.route_type for r in t.collect()} == {3}
    marked = trips.withColumn("from_trip", F.when(F.col("trip_id") == "T2", F.lit("T1")))
    assert {r.trip_id for r in deadhead.depot_trips(marked, times).collect()} == {"depot_to_T1", "T1_to_depot", "depot_to_T3", "T3_to_depot"}
    depots = spark.createDataFrame([(0, 39.95, -104.95), (1, 40.55, -105.55), (2, 39.95, -104.95)], "idx int, lat double, lon double")
    placed = deadhead.assign_depots(deadhead.block_ends(trips, times, stops), depots)
    assert {(r.block_id, r.depot_idx) for r in placed.collect()} == {("B1", 0), ("B2", 1)}
    legs = deadhead.depot_legs(t, placed)
    out = deadhead.leg_stops(legs, "depot_deadhead_").collect()
    assert len(out) == 8 and {r.stop_sequence for r in out} == {1, 2} and all(r.stop_id.startswith("depot_deadhead_") for r in out)
    with pytest.raises(ValueError):
        deadhead.assign_depots(placed.select("block_id"), depots, max_depots=2)


def test_od_shapes(spark):
    legs = spark.createDataFrame([("a", 39.0, -105.0, 39.1, -104.9), ("b", 39.0, -105.0, 39.1, -104.9), ("c", 39.0, -105.0, 39.0001, -105.0)], "trip_id string, o_lat double, o_lon double, d_lat double, d_lon double")
    lines, mapping = deadhead.deadhead_shapes(legs)
    assert lines.count() == 4 and mapping.count() == 3 and mapping.select("shape_id").distinct().count() == 2
    lines, _ = deadhead.deadhead_shapes(legs, router=lambda ods: deadhead.straight_shapes(ods.filter("false")))
    assert lines.count() == 4  # no route: straight lines


def grid(spark, n=6, step=0.002):
    v = [(i * n + j, 40 + i * step, -105 + j * step) for i in range(n) for j in range(n)]
    e = []
    for i in range(n):
        for j in range(n):
            for di, dj in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= i + di < n and 0 <= j + dj < n:
                    e.append((len(e), i * n + j, (i + di) * n + j + dj, 0.13, 60.0 if i == 0 or dj == 0 else 20.0))
    return spark.createDataFrame(v, "vertex_id long, lat double, lon double"), spark.createDataFrame(e, "edge_id long, src long, dst long, miles double, speed_mph double")


def test_routing_and_matching(spark):
    v, e = grid(spark)
    ods = spark.createDataFrame([("k", 40.0041, -105.0, 40.0041, -104.99), ("same", 40.0, -105.0, 40.0, -105.0)], "od_key string, o_lat double, o_lon double, d_lat double, d_lon double")
    shp = routing.shortest_paths(ods, v, e).orderBy("shape_pt_sequence").collect()
    assert {r.shape_id for r in shp} == {"k"} and [r.shape_pt_sequence for r in shp] == list(range(1, len(shp) + 1))
    assert min(r.shape_pt_lat for r in shp) == 40.0  # down to the fast street and up again
    assert shp[0].shape_dist_traveled == 0 and shp[-1].shape_dist_traveled > 0.8
    line = spark.createDataFrame([("s", i, 40.004 + 1e-5, -105 + i * 0.0005) for i in range(21)], "shape_id string, second int, lat double, lon double")
    path = [r.edge_id for r in matching.match_lcss(line, v, e).orderBy("seq").collect()]
    want = {r.edge_id: (r.src, r.dst) for r in e.collect()}
    assert [want[k] for k in path] == [(12 + j, 13 + j) for j in range(5)]  # the street of the trace, though it is slow
    # the same over tiles of three vertices
    joined = routing.shortest_paths(ods, v, e, tile_vertices=3).orderBy("shape_pt_sequence").collect()
    assert [(r.shape_id, r.shape_pt_lat, r.shape_pt_lon) for r in joined] == [(r.shape_id, r.shape_pt_lat, r.shape_pt_lon) for r in shp]
    assert joined[-1].shape_dist_traveled == pytest.approx(shp[-1].shape_dist_traveled)


def test_fastest_paths_of_random_networks(spark):
    rng = np.random.default_rng(5)
    e = [(i, int(a), int(b), float(m), 30.0) for i, (a, b, m) in enumerate(zip(rng.integers(0, 40, 110), rng.integers(0, 40, 110), rng.random(110) + 0.01))]
    edges = spark.createDataFrame([*e, (900, 0, 1, None, 30.0), (901, 0, 1, 1.0, 0.0)], "edge_id long, src long, dst long, miles double, speed_mph double")
    ods = [(f"k{o}-{d}", o, d) for o in (0, 3, 7) for d in (1, 9, 20, 39)]
    got = {r.od_key: r for r in routing.fastest_paths(spark.createDataFrame([*ods, ("null", None, 1), ("same", 4, 4)], "od_key string, o long, d long"), edges).collect()}
    time = np.full((40, 40), np.inf)
    for _, a, b, m, mph in e:
        time[a, b] = min(time[a, b], 60 * m / mph)
    for k in range(40):
        time = np.minimum(time, time[:, k : k + 1] + time[k : k + 1])
    assert set(got) == {k for k, o, d in ods if np.isfinite(time[o, d])}
    assert all(got[k].minutes == pytest.approx(time[o, d]) and got[k].path[0] == o and got[k].path[-1] == d for k, o, d in ods if k in got)


def test_rates(spark):
    edges = spark.createDataFrame([(1, 2.0, 5.0, 0.0), (2, 1.0, 30.0, 0.02), (3, 1.0, 90.0, -0.5), (4, 1.0, None, 0.0)], "edge_id long, miles double, speed_mph double, grade double")
    bins = spark.createDataFrame([("m", s, g, r) for s, g, r in ((10.0, -0.1, 1.0), (10.0, 0.01, 2.0), (40.0, -0.1, 3.0), (40.0, 0.01, 4.0))], "vehicle string, speed_from double, grade_from double, rate double")
    rates = energy.binned_rates(edges, bins)
    assert {(r.edge_id, r.rate) for r in rates.collect()} == {(1, 1.0), (2, 2.0), (3, 3.0)}
    v = en.vehicle_catalog(spark, [("m", "bev", "trip_energy_electric", "kWh", 1.0, 1000.0, 100.0, None, None, None)])
    paths = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 3, 2), ("s", 4, 4)], "shape_id string, seq int, edge_id long")
    only = v.filter("vehicle = 'm'")
    assert energy.path_energy_by_rate(paths, edges, only, rates).first().energy_used == pytest.approx(2 * 1 + 2 * 2)
    stop = spark.createDataFrame([("s", 2)], "shape_id string, edge_id long")
    lost = 0.5 * 1000 * (30 * 0.44704) ** 2 / 3.6e6
    assert energy.path_energy_by_rate(paths, edges, only, rates, stop).first().energy_used == pytest.approx(6 + 2 * lost)
    by_rate = energy.path_energy_by_rate(paths, edges, v, energy.linear_rates(edges, v)).filter("vehicle <> 'm'")
    plain = {r.vehicle: r.energy_used for r in energy.path_energy(paths.filter("edge_id < 4"), edges, v).collect()}
    assert all(r.energy_used == pytest.approx(plain[r.vehicle]) for r in by_rate.collect())
    with pytest.raises(ValueError, match="grade"):
        energy.check_features(edges.drop("grade"))


def test_upsample(spark):
    pts = spark.createDataFrame([("S1", 1, 40.0, -105.0), ("S1", 2, 40.1, -105.1), ("Z", 1, 40.0, -105.0), ("Z", 2, 40.0, -105.0)], "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double")
    out = shapes.upsample(pts)
    assert out.filter("shape_id = 'S1'").count() > 1000 and out.filter("shape_id = 'Z'").count() == 1
    assert out.filter("shape_id = 'S1'").agg(F.count_distinct("second") == F.count("*")).first()[0]


def test_timestamps_and_flags(spark):
    pts = spark.createDataFrame([("T", 0.0), ("T", 500.0), ("T", 1000.0)], "trip_id string, shape_dist_traveled double").withColumns({"start_s": F.lit(28800), "end_s": F.lit(29400)})
    rows = shapes.point_timestamps(pts).orderBy("shape_dist_traveled").collect()
    assert [r.timestamp_s for r in rows][1] == 29100 and (rows[1].hour, rows[1].minute) == (8, 5)
    coords = spark.createDataFrame([("T1", i, 40 + i * 0.05, -105 - i * 0.05) for i in range(3)], "trip_id string, coordinate_id int, lat double, lon double")
    stops = spark.createDataFrame([("T1", "a", 40.0, -105.0), ("T1", "b", 40.1, -105.1)], "trip_id string, stop_id string, stop_lat double, stop_lon double")
    assert [r.with_stop for r in shapes.stop_flags(coords, stops).orderBy("coordinate_id").collect()] == [1, 0, 1]


def test_counties(spark):
    ring = "county_id string, ring array<struct<x:double,y:double>>"
    c = spark.createDataFrame([("A", [(-105.0, 40.0), (-104.9, 40.0), (-104.9, 40.1), (-105.0, 40.1)]), ("B", [(-104.0, 40.0), (-103.9, 40.0), (-103.9, 40.1), (-104.0, 40.1)])], ring)
    near = spark.createDataFrame([("s", 40.05, -104.95), ("t", 40.05, -104.01)], STOPS)
    assert {r.county_id for r in spatial.counties_of_stops(near, c).collect()} == {"A", "B"}
    far = spark.createDataFrame([("u", 40.05, -104.5)], STOPS)
    with pytest.raises(ValueError):
        spatial.counties_of_stops(far, c)


def test_nearest_edge_reaches_far_points(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 5.0, 10.0, 5.0)], "edge_id long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([("a", 1.0, 1.0), ("b", 5.0, 2.5), ("c", 90_000.0, 0.0)], "point_id string, x double, y double")
    assert {r.point_id: r.edge_id for r in spatial.nearest_edge(p, e, cell_m=2.0).collect()} == {"a": 1, "b": 1, "c": 1}


def test_hvac_scenarios(spark):
    w = spark.sql("SELECT 'G' AS county, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts, 20.0D AS temp_c FROM range(24)").withColumn("ts", F.col("ts").cast("timestamp"))
    power = thermal.hourly_power(w, thermal.extreme_days(w))
    spans = spark.createDataFrame([("t", 28800, 32400)], "trip_id string, start_s long, end_s long")
    rows = thermal.trip_hvac(spans, power).collect()
    assert {r.scenario for r in rows} == {"summer", "winter", "median"} and all(abs(r.hvac_energy_kwh - 1.1 * 0.99) < 1e-6 for r in rows)


def test_services(spark):
    days = ", ".join(f"{d} int" for d in service.DAYS)
    cal = spark.createDataFrame([("S1", 1, 0, 0, 0, 0, 0, 0, "2024-01-01", "2024-01-31"), ("S2", 0, 0, 0, 0, 0, 0, 0, "2024-01-01", "2024-01-31")], f"service_id string, {days}, start_date string, end_date string")
    cal = cal.withColumn("start_date", F.to_date("start_date")).withColumn("end_date", F.to_date("end_date"))
    exc = spark.createDataFrame([("S1", "2024-01-08", 2), ("S2", "2024-01-09", 1), ("S3", "2024-01-09", 1)], "service_id string, date string, exception_type int").withColumn("date", F.to_date("date"))
    assert {r.service_id: r.trip_count for r in service.service_counts(service.service_dates(cal, exc)).collect()} == {"S1": 4, "S2": 1, "S3": 1}


def test_trip_results_columns(spark):
    per_shape = spark.createDataFrame([("SH1", "bus", "kWh", 1 / 33.7, 33.7, 10.0)], "shape_id string, vehicle string, energy_unit string, gge_per_unit double, energy_used double, miles double")
    trips = spark.createDataFrame([("T1", "SH1", "S", "n", 3), ("T2", "SH1", "S", "n", 3)], "trip_id string, shape_id string, service_id string, route_short_name string, route_type int")
    r = energy.trip_results(per_shape, trips)
    assert {round(x.mpge, 6) for x in r.collect()} == {10.0} and r.count() == 2
    assert not {"service_id", "route_short_name", "route_type"} & set(r.columns) and {"trip_id", "energy_used", "miles", "mpge", "energy_unit"} <= set(r.columns)


def test_ways_from_and_to_depots_share_no_shape(spark):
    kind = "trip_id string, trip_type string, o_lat double, o_lon double, d_lat double, d_lon double"
    same = (40.0, -105.0, 40.00001, -105.00001)
    legs = spark.createDataFrame([("a", "pull-out", *same), ("b", "pull-in", *same), ("c", "pull-in", *same)], kind)
    shapes_, mapping = deadhead.deadhead_shapes(legs)
    by_trip = dict(mapping.select("trip_id", "shape_id").collect())
    assert by_trip["a"].startswith("from_depot_") and by_trip["b"] == by_trip["c"] and by_trip["b"].startswith("to_depot_")
    assert sorted((r.shape_id, r.shape_pt_sequence) for r in shapes_.collect()) == sorted((x, k) for x in {*by_trip.values()} for k in (1, 2))
    between, _ = deadhead.deadhead_shapes(legs.drop("trip_type"))
    assert {r.shape_id for r in between.collect()}.isdisjoint(by_trip.values())


def test_energy_lost_in_stops(spark):

    paths = spark.createDataFrame([("s", 1, 10), ("s", 2, 11), ("t", 1, 10)], "shape_id string, seq int, edge_id long")
    edges = spark.createDataFrame([(10, 1.0, 30.0, 0.0), (11, 2.0, 20.0, 0.01)], "edge_id long, miles double, speed_mph double, grade double")
    at = spark.createDataFrame([("s", 11), ("s", 11)], "shape_id string, edge_id long")
    v = en.vehicle_catalog(spark)
    plain = {(r.shape_id, r.vehicle): r for r in energy.path_energy(paths, edges, v).collect()}
    got = {(r.shape_id, r.vehicle): r for r in energy.path_energy_with_stops(paths, edges, v, at).collect()}
    assert got.keys() == plain.keys() and all(abs(got[k].miles - plain[k].miles) < 1e-9 for k in got)
    lost = {k: got[k].energy_used - plain[k].energy_used for k in got}
    kwh = 0.5 * 16_500 * (20 * 0.44704) ** 2 / 3.6e6
    assert abs(lost["s", "Transit_Bus_Battery_Electric"] - kwh) < 1e-9 and lost["s", "Transit_Bus_Diesel"] > 0
    assert all(abs(lost[k]) < 1e-9 for k in lost if k[0] == "t")


def test_quartiles_are_exact_values(spark, monkeypatch):
    monkeypatch.setattr(energy, "FEW", 20)
    monkeypatch.setattr(energy, "BINS", 8)
    rng = np.random.default_rng(3)
    groups = {"a": rng.lognormal(0, 6, 3001), "b": np.array([7.0] * 500 + [8.0]), "c": rng.integers(0, 5, 400) * 1.0, "d": np.array([1e308, -1e308] * 30 + [float("inf")] * 70), None: np.arange(4) / 3}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("e", None)]
    got = {r.g: r for r in energy.describe(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert set(got) == {*groups, "e"} and got["e"].n == 0 and got["e"].p50 is None
    for k, v in groups.items():
        s = np.sort(v)
        assert [got[k].p25, got[k].p50, got[k].p75] == [s[max(int(np.ceil(q * len(s))), 1) - 1] for q in (0.25, 0.5, 0.75)]
        assert got[k].n == len(s) and got[k].min == s[0] and got[k].max == s[-1]


def test_rates_of_few_vehicles_do_not_gather_edges(spark):
    # neither the two vehicles nor their bins may be what links are shuffled by
    spread = lambda df: df.repartition(3)
    edges = spread(spark.range(50).selectExpr("id AS edge_id", "1e0 AS miles", "cast(id AS double) AS speed_mph", "0e0 AS grade"))
    bins = spread(spark.createDataFrame([(m, s, -1.0, 1.0) for m in ("m", "n") for s in (0.0, 20.0)], "vehicle string, speed_from double, grade_from double, rate double"))
    v = spread(spark.createDataFrame([(m, "bev", 1.0, "kWh", 1.0) for m in ("m", "n")], "vehicle string, kind string, mass_kg double, energy_unit string, gge_per_unit double"))
    paths = spread(spark.range(100).selectExpr("id % 9 AS shape_id", "id % 50 AS edge_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = energy.path_energy_by_rate(paths, edges, v, energy.binned_rates(edges, bins))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [vehicle" not in plan and "ShuffledHashJoin [vehicle" not in plan
        assert out.agg(F.sum("energy_used")).first()[0] == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
