import json
import struct
import zipfile

import pytest
from headway.functions import energy as en
from headway.operators import energy
from headway.plans import pipeline
from headway.sources import feeds, files, gtfs
from headway.streaming import positions
from pyspark.sql import functions as F

from test_operators import grid


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("feed")
    put = lambda name, text: (d / f"{name}.txt").write_text(text)
    put("agency", "agency_id,agency_name\n,Agency\n")
    put("routes", "route_id,route_short_name,route_type,route_desc\nR1,1,3,Bus\nR2,2,3,Bus\nT,9,0,Tram\n")
    put("calendar", "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWK,1,1,1,1,1,0,0,20240101,20240131\n")
    put("calendar_dates", "service_id,date,exception_type\nWK,20240101,2\nSA,20240106,1\n")
    put("trips", "trip_id,route_id,service_id,block_id,shape_id\nA,R1,WK,B,S1\nB,R1,WK,B,S2\nC,R2,WK,C,S1\nD,R1,SA,D,S1\nX,T,WK,E,S1\nN,R1,NO,F,S1\n")
    rows = []
    for t, h, stops in (("A", 8, "pq"), ("B", 9, "qp"), ("C", 25, "pq"), ("D", 8, "pq"), ("X", 8, "pq"), ("N", 8, "pq")):
        rows += [f"{t},1,{stops[0]}, {h}:00:00,{h}:00:00", f"{t},2,{stops[1]},{h}:30:00,{h}:30:00"]
    put("stop_times", "trip_id,stop_sequence,stop_id,arrival_time,departure_time\n" + "\n".join(rows) + "\n")
    put("stops", "stop_id,stop_lat,stop_lon\np,40.0,-105.0\nq,40.008,-104.992\n")
    put("shapes", "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\nS1,1,40.0,-105.0\nS1,2,40.0,-104.992\nS1,3,40.008,-104.992\nS2,2,40.0,-105.0\nS2,1,40.008,-104.992\n")
    geo = {"features": [{"geometry": {"type": "Point", "coordinates": [-104.996, 40.002]}}, {"geometry": {"type": "Point", "coordinates": [-104.0, 41.0]}}]}
    (d / "depots.geojson").write_text(json.dumps(geo))
    box = [[-105.1, 39.9], [-104.9, 39.9], [-104.9, 40.1], [-105.1, 40.1], [-105.1, 39.9]]
    (d / "counties.geojson").write_text(json.dumps({"features": [{"properties": {"STATEFP": "08", "COUNTYFP": "013"}, "geometry": {"type": "Polygon", "coordinates": [box]}}]}))
    return d


@pytest.fixture()
def predictor(spark, folder, tmp_path):
    v, e = grid(spark)
    e = e.withColumn("grade", F.lit(0.01))
    weather = spark.range(48).select(F.lit("G080000130").alias("county"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("ts"), (F.col("id") % 7 + 10.0).alias("temp_c"))
    counties = files.read_counties(spark, str(folder / "counties.geojson"))
    assert counties.first().county_id == "G0800130"
    return pipeline.Predictor(spark, str(folder), str(folder / "depots.geojson"), vertices=v, edges=e, weather=weather.withColumn("county", F.lit("G0800130")), counties=counties, output_dir=str(tmp_path))


def test_reader(spark, folder):
    f = gtfs.read_feed(spark, str(folder))
    assert f.stop_times.filter("trip_id = 'C'").agg(F.max("arrival_s")).first()[0] == 25 * 3600 + 1800
    assert f.calendar.first().start_date.isoformat() == "2024-01-01" and f.shapes.first().shape_dist_traveled is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        gtfs.read_feed(spark, str(folder / "nowhere"))


def test_run(predictor):
    out = predictor.run(date="2024-01-03", routes=["1"])
    rows = out.collect()
    trips = {r.trip_id: r for r in rows}
    # no deadhead between A and B: both use stop q
    assert set(trips) == {"A", "B", "depot_to_A", "B_to_depot"} and len(rows) == 4 * 2 * 3
    assert {r.scenario for r in rows} == {"summer", "winter", "median"} and {r.vehicle for r in rows} == {v[0] for v in en.VEHICLES}
    assert all(r.energy_used > 0 and r.mpge > 0 and r.miles > 0 for r in rows)
    assert trips["A"].trip_duration_minutes == 30 and trips["depot_to_A"].trip_type == "pull-out" and trips["A"].trip_count == 22
    assert predictor.link_predictions(en.VEHICLES[0][0]).count() > 0
    with pytest.raises(KeyError):
        predictor.trip_predictions("no such bus")
    saved = predictor.spark.read.option("header", True).csv(f"{predictor.output_dir}/trip_energy_predictions.csv")
    assert saved.count() == len(rows)


def test_link_level_inputs(predictor):
    predictor.load().filter_trips("2024-01-03", ["1"]).add_trip_times()
    rows = predictor.link_level_inputs().collect()
    path = {(r.shape_id, r.edge_id) for r in predictor.match().collect()}
    assert {r.trip_id for r in rows} == {"A", "B"} and all((r.shape_id, r.road_id) in path for r in rows)
    a = sorted((r for r in rows if r.trip_id == "A"), key=lambda r: r.start_timestamp_s)
    assert a[0].start_timestamp_s == 8 * 3600 and a[-1].end_timestamp_s == 8 * 3600 + 1800
    assert all(x.end_timestamp_s <= y.start_timestamp_s for x, y in zip(a, a[1:])) and all(r.kilometers > 0 and r.travel_time_minutes > 0 for r in rows)


def test_stops_cost_energy_and_charge_is_left(predictor):
    p = predictor.load().filter_trips("2024-01-03", ["1"]).add_trip_times()
    key = lambda r: (r.trip_id, r.vehicle)
    plain = {key(r): r for r in p.predict().trip_predictions().collect()}
    stops = {key(r): r for r in p.predict(stop_penalty=True, start_soc=80.0).trip_predictions().collect()}
    assert plain.keys() == stops.keys() and all(stops[k].energy_used >= plain[k].energy_used - 1e-9 for k in plain)
    bus = stops["A", "Transit_Bus_Battery_Electric"]
    assert abs(bus.trip_soc - (80 - 100 * bus.energy_used / 440.0)) < 1e-9 and bus.in_reach
    assert stops["A", "Transit_Bus_Diesel"].trip_soc is None and stops["A", "Transit_Bus_Diesel"].in_reach
    assert not any(r.in_reach for r in p.predict(start_soc=0.0).trip_predictions("Transit_Bus_Battery_Electric").collect())


def test_network_rates_hooks_and_files(spark, predictor, tmp_path):
    far = spark.createDataFrame([(9999, 10.0, 10.0)], "vertex_id long, lat double, lon double")
    predictor.vertices.unionByName(far).write.parquet(str(tmp_path / "net/vertices"))
    predictor.edges.write.parquet(str(tmp_path / "net/edges"))
    bins = [{"speed_from": s, "grade_from": 0.0, "rate": r} for s, r in ((0.0, 2.0), (40.0, 3.0))]
    (tmp_path / "bus.json").write_text(json.dumps({"name": "bus", "type": "bev", "battery_capacity": 300.0, "battery_capacity_unit": "kWh", "rates": bins}))
    steps, path = [], str(tmp_path / "bus.json")
    p = pipeline.Predictor(
        spark, predictor.feed_path, predictor.depot_path, network_path=str(tmp_path / "net"), output_dir=str(tmp_path / "out"), hooks=[lambda step, _: steps.append(step)],
        vehicles=files.read_vehicles(spark, path), rates=lambda edges: energy.binned_rates(edges, files.read_rates(spark, path)),
    )
    p.run(date="2024-01-03", routes=["1"], hvac=False, save=False)
    assert steps == ["load", "filter_trips", "add_deadheads", "predict"]
    assert p.vertices.filter("vertex_id = 9999").isEmpty() and p.vertices.count() == 36
    lon0, lat0, lon1, lat1 = p.box()
    assert lon1 == pytest.approx(-103.95) and lat1 == pytest.approx(41.05) and lon0 == pytest.approx(-105.05) and lat0 == pytest.approx(39.95)  # a depot afar counts
    rows = p.predict(stop_penalty=False).trip_predictions().collect()
    assert {r.vehicle for r in rows} == {"bus"} and all(2 - 1e-9 <= r.energy_used / r.miles <= 3 + 1e-9 for r in rows) and p.unmatched_trips().isEmpty()
    p.predict(stop_penalty=True).save(geometry=True, inputs=False)
    back = lambda name: spark.read.option("header", True).csv(f"{p.output_dir}/{name}")
    assert back("link_geometry.csv").filter("geometry_wkt LIKE 'LINESTRING (-10%'").count() == p.link_predictions().select("edge_id").distinct().count()
    assert {r.trip_id for r in back("gtfs_stops.csv").collect()} == {r.trip_id for r in rows}
    p.edges = p.edges.drop("grade")
    with pytest.raises(ValueError, match="grade"):
        p.predict()


def test_zipped_feeds_and_catalogue(spark, tmp_path):
    for name, text in (("f1", "\ufeffroute_id,route_type\nR1,3\n\"R,2\",0\n"), ("f2", "route_type\n3\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("routes.txt", text)
    with zipfile.ZipFile(tmp_path / "f3.zip", "w") as z:
        z.writestr("trips.txt", "trip_id\n")
    got = files.read_zipped(spark, str(tmp_path), "routes.txt", ["route_id", "route_type"])
    assert {tuple(r) for r in got.collect()} == {("f1", "R1", "3"), ("f1", "R,2", "0"), ("f2", None, "3")}
    f = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 5.0)], "id string, lat double, lon double")
    ds = spark.createDataFrame([("d", ([],))], "id string, report struct<features:array<string>>")
    feeds.save_catalogue(f, ds, str(tmp_path))
    again = feeds.read_catalogue(spark, str(tmp_path / "feeds.csv"))
    assert {tuple(r) for r in again.collect()} == {("a", 1.0, 3.0), ("b", 2.0, 5.0)} and tuple(feeds.map_centre(again).first()) == (1.5, 4.0)
    assert [r.id for r in feeds.missing_feeds(spark.createDataFrame([("b",), ("z",)], "id string"), again).collect()] == ["z"]


def test_weather_files(spark, tmp_path):
    (tmp_path / "G0800130.csv").write_text("date_time,Dry Bulb Temperature [°C],other\n2024-01-01 01:00:00,4.5,1\n")
    r = files.read_weather(spark, str(tmp_path / "*.csv")).first()
    assert (r.county, r.temp_c, r.ts.hour) == ("G0800130", 4.5, 1)


def test_errors(spark, predictor):
    with pytest.raises(RuntimeError):
        predictor.add_trip_times()
    with pytest.raises(RuntimeError):
        predictor.save()
    with pytest.raises(KeyError):
        predictor.trip_predictions()
    predictor.load()
    with pytest.raises(ValueError):
        predictor.filter_trips(date="2030-01-01")
    with pytest.raises(ValueError):
        predictor.filter_trips(routes=["none"])
    predictor.models = ["no such bus"]
    with pytest.raises(ValueError):
        predictor.predict()
    with pytest.raises(FileNotFoundError):
        files.read_depots(spark, "/nowhere/depots.geojson")


def test_shapefile_points(spark, tmp_path):
    body = b"".join(struct.pack(">2i", i + 1, 10) + struct.pack("<i2d", 1, x, y) for i, (x, y) in enumerate([(-105.0, 39.0), (-104.0, 38.5)]))
    (tmp_path / "d.shp").write_bytes(b"\0" * 100 + body)
    assert [(r.idx, r.lat, r.lon) for r in files.read_depots(spark, str(tmp_path / "d.shp")).collect()] == [(0, 39.0, -105.0), (1, 38.5, -104.0)]


def test_vehicles_and_stop_edges(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "a", "type": "BEV", "battery_capacity": 300.0, "battery_capacity_unit": "kilowatt_hours"}))
    assert files.read_vehicles(spark, str(tmp_path / "a.json")).first().kind == "bev"
    (tmp_path / "b.json").write_text(json.dumps({"name": "b", "type": "steam"}))
    with pytest.raises(ValueError):
        files.read_vehicles(spark, str(tmp_path / "b.json"))
    (tmp_path / "s.csv").write_text("trip_id,edge_id\nA,1\n")
    assert files.read_stop_edges(spark, str(tmp_path / "s.csv")).first().edge_id == 1
    (tmp_path / "t.csv").write_text("trip_id,edge_id\nA,x\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_stop_edges(spark, str(tmp_path / "t.csv")).collect()
    assert files.select_models(["v/a.json", "v/b.json"], ["b"]) == ["v/b.json"]


def test_catalogue(spark):
    ds = spark.createDataFrame([(1, (["Shapes"], 0)), (2, (["Fares"], 0)), (3, (["Shapes"], 2)), (4, None)], "id int, validation_report struct<features:array<string>,total_error:int>")
    assert [r.download for r in feeds.dataset_quality(ds).orderBy("id").collect()] == [True, False, False, False]
    trips = spark.createDataFrame([("a", "R"), ("b", "R")], "trip_id string, route_id string")
    routes = spark.createDataFrame([("R", 3)], "route_id string, route_type int")
    assert feeds.trip_quality(trips, routes).first().all_shapes is False


def test_stream(spark, tmp_path):
    rows = [{"id": "1", "vehicle": {"vehicle": {"id": "v"}, "trip": {"tripId": "t"}, "position": {"latitude": 40.0, "longitude": -105.0}, "timestamp": "1700000000"}}, {"id": "2"}, {"id": "3", "vehicle": {"vehicle": {"id": "v"}, "position": {"latitude": 40.01, "longitude": -105.0}, "timestamp": "1700000060"}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    flat = positions.vehicles(positions.read_positions(spark, str(tmp_path / "in")))
    positions.append_daily(flat, str(tmp_path / "out"), str(tmp_path / "state"), every=None).awaitTermination()
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 2 and "log_date" in got.columns
    q = positions.hourly_speeds(flat).writeStream.format("memory").queryName("speeds").outputMode("complete" if False else "update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s2")).start()
    q.awaitTermination()
    assert spark.table("speeds").agg(F.max("km")).first()[0] == pytest.approx(1.112, abs=0.01)
