"""DuckDB statements for the queries, written from the definitions rather than from the plans."""

from __future__ import annotations

import math

from headway.functions import energy as en
from headway.functions.geo import ALBERS
from headway.operators.thermal import CURVE
from headway.plans.projection import COUNTIES, duck

_VEHICLES = "veh AS (SELECT * FROM (VALUES " + ", ".join(f"('{v[0]}', '{v[1]}', '{v[3]}', {v[4]!r}::DOUBLE, {v[5]}::DOUBLE, {v[6] if v[6] else 'NULL'}::DOUBLE, {v[7]}::DOUBLE, {v[8]}::DOUBLE, {v[9]}::DOUBLE)" for v in en.VEHICLES) + ") t(vehicle, kind, energy_unit, gge_per_unit, mass_kg, battery_kwh, rate0, rate_mph, rate_grade))"
_TRIPS = "trips AS (SELECT DISTINCT trip_id, block_id, user_id, doy, user_id::VARCHAR AS service_id, 'R' || ((user_id + doy) % 3) AS route_short_name FROM stop_times)"
_ENERGY = "el AS (SELECT p.*, e.miles, e.speed_mph, e.heading, v.*, (rate0 + rate_mph * speed_mph + rate_grade * greatest(grade, 0)) * miles AS used FROM paths p JOIN edges e USING (edge_id), veh v), en AS (SELECT shape_id, vehicle, energy_unit, gge_per_unit, sum(used) AS energy_used, sum(miles) AS miles FROM el GROUP BY ALL)"
_HMS = lambda c: f"format('{{:02d}}:{{:02d}}:{{:02d}}', ({c}) // 3600, ({c}) % 3600 // 60, ({c}) % 60)"
_KM = lambda a, b, c, d, r="6371.0": f"(2 * {r} * atan2(sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)), sqrt(1 - (pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))"
_X, _Y = (lambda lon: f"(6378137.0 * radians({lon}))"), (lambda lat: f"(6378137.0 * ln(tan(pi() / 4 + radians({lat}) / 2)))")
_DATES = """cal AS (SELECT c_custkey, date '2024-01-01' + (c_custkey % 60)::INT + i::INT AS d FROM customer, range(0, 90) t(i)
  WHERE ((c_custkey % 128) >> (isodow(date '2024-01-01' + (c_custkey % 60)::INT + i::INT) - 1)) & 1 = 1),
exc AS (SELECT o_custkey, date '2024-01-01' + (o_orderkey % 150)::INT AS d, o_orderkey % 2 + 1 AS kind FROM orders),
dates AS ((SELECT * FROM cal UNION SELECT o_custkey, d FROM exc WHERE kind = 1) EXCEPT SELECT o_custkey, d FROM exc WHERE kind = 2)"""


def _vincenty(legs: str) -> str:
    """CTEs that add ``m``, metres on the ellipsoid, to ``legs`` (o_lat, o_lon, d_lat, d_lon): six iterations, spelt out."""
    f = "(1 / 298.257223563)"
    out = [f"v0 AS (SELECT *, atan((1 - {f}) * tan(radians(o_lat))) AS u1, atan((1 - {f}) * tan(radians(d_lat))) AS u2, radians(d_lon - o_lon) AS l, radians(d_lon - o_lon) AS lam FROM {legs})"]
    for i in range(7):
        out.append(f"""a{i} AS (SELECT * EXCLUDE (lam), sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs, lam FROM v{i}),
b{i} AS (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM a{i}),
c{i} AS (SELECT *, 1 - sa * sa AS ca, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS cm FROM b{i})""")
        if i < 6:
            c = f"({f} / 16 * ca * (4 + {f} * (4 - 3 * ca)))"
            out.append(f"v{i + 1} AS (SELECT * EXCLUDE (lam, ss, cs, sg, sa, ca, cm), l + (1 - {c}) * {f} * sa * (sg + {c} * ss * (cm + {c} * cs * (2 * cm * cm - 1))) AS lam FROM c{i})")
    b = f"(6378137.0 * (1 - {f}))"
    out.append(f"uu AS (SELECT *, ca * (6378137.0 * 6378137.0 - {b} * {b}) / ({b} * {b}) AS q FROM c6)")
    out.append("ab AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS fa, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS fb FROM uu)")
    out.append(f"geo AS (SELECT * EXCLUDE (u1, u2, l, lam, ss, cs, sg, sa, ca, cm, q, fa, fb), {b} * fa * (sg - fb * ss * (cm + fb / 4 * (cs * (2 * cm * cm - 1) - fb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS m FROM ab)")
    return ",\n".join(out)


_MID = f"""{_TRIPS}, fa AS (SELECT trip_id, min(arrival_s) AS a FROM stop_times GROUP BY 1),
mid AS (SELECT * FROM (SELECT t.trip_id AS from_trip, lead(t.trip_id) OVER (PARTITION BY block_id ORDER BY a, t.trip_id) AS to_trip, block_id FROM trips t JOIN fa USING (trip_id)) WHERE to_trip IS NOT NULL),
lst AS (SELECT DISTINCT ON (trip_id) trip_id, stop_id, arrival_s FROM stop_times ORDER BY trip_id, stop_sequence DESC),
fst AS (SELECT DISTINCT ON (trip_id) trip_id, stop_id, arrival_s FROM stop_times ORDER BY trip_id, stop_sequence),
legs0 AS (SELECT from_trip || '_to_' || to_trip AS trip_id, block_id, l.arrival_s AS dep, f.arrival_s AS due, so.stop_lat AS o_lat, so.stop_lon AS o_lon, sd.stop_lat AS d_lat, sd.stop_lon AS d_lon
  FROM mid JOIN lst l ON l.trip_id = from_trip JOIN fst f ON f.trip_id = to_trip JOIN stops so ON so.stop_id = l.stop_id JOIN stops sd ON sd.stop_id = f.stop_id
  WHERE so.stop_lat <> sd.stop_lat OR so.stop_lon <> sd.stop_lon)"""
_LEGS = f"{_MID}, {_vincenty('legs0')}, legs AS (SELECT *, least(due, dep + m / 30000 * 3600) AS arr FROM geo)"
_ENDS = f"""{_TRIPS},
ea AS (SELECT DISTINCT ON (block_id) block_id, trip_id, stop_id, arrival_s FROM stop_times ORDER BY block_id, arrival_s, stop_sequence, trip_id),
ez AS (SELECT DISTINCT ON (block_id) block_id, trip_id, stop_id, arrival_s FROM stop_times ORDER BY block_id, arrival_s DESC, stop_sequence DESC, trip_id DESC),
ends AS (SELECT a.block_id, a.arrival_s AS a_s, z.arrival_s AS z_s, sa.stop_lat AS a_lat, sa.stop_lon AS a_lon, sz.stop_lat AS z_lat, sz.stop_lon AS z_lon FROM ea a JOIN ez z USING (block_id) JOIN stops sa ON sa.stop_id = a.stop_id JOIN stops sz ON sz.stop_id = z.stop_id),
placed AS (SELECT e.*, idx, lat, lon, sqrt(pow({_X("a_lon")} - {_X("lon")}, 2) + pow({_Y("a_lat")} - {_Y("lat")}, 2)) + sqrt(pow({_X("z_lon")} - {_X("lon")}, 2) + pow({_Y("z_lat")} - {_Y("lat")}, 2)) AS way FROM ends e, depots
  QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY round(way, 3), idx) = 1)"""
_DEPOT_TRIPS = """fa AS (SELECT trip_id, min(arrival_s) AS a FROM stop_times GROUP BY 1),
bt AS (SELECT block_id, arg_min(trip_id, (a, trip_id)) AS f, arg_max(trip_id, (a, trip_id)) AS l, arg_min(service_id, (a, trip_id)) AS fs, arg_max(service_id, (a, trip_id)) AS ls FROM trips JOIN fa USING (trip_id) GROUP BY 1)"""
_PTS = "pts AS (SELECT trip_id AS shape_id, stop_sequence AS seq, stop_lat AS lat, stop_lon AS lon, stop_id, arrival_s FROM stop_times JOIN stops USING (stop_id))"
_SEG = f"{_PTS}, sg0 AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pts WINDOW w AS (PARTITION BY shape_id ORDER BY seq)), sg AS (SELECT *, coalesce({_KM('plat', 'plon', 'lat', 'lon', '6371.009')}, 0) AS seg FROM sg0), cum AS (SELECT *, sum(seg) OVER (PARTITION BY shape_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS km FROM sg)"
_TIMED = f"""{_SEG}, sp AS (SELECT trip_id AS shape_id, min(arrival_s) AS s, max(arrival_s) AS e FROM stop_times GROUP BY 1),
td AS (SELECT c.*, s + round_even(km / (max(km) OVER (PARTITION BY shape_id) + 0.0001) * (e - s), 0)::BIGINT AS t FROM cum c JOIN sp USING (shape_id)),
tt AS (SELECT *, round_even(t / 300.0::DOUBLE, 0)::BIGINT * 300 AS near FROM td)"""
_EDGE_XY = f"ex AS (SELECT edge_id, {_X('lon1')} AS x1, {_Y('lat1')} AS y1, {_X('lon2')} AS x2, {_Y('lat2')} AS y2 FROM edges), sx AS (SELECT stop_id, {_X('stop_lon')} AS x, {_Y('stop_lat')} AS y FROM stops)"
_NEAR = f"""{_EDGE_XY}, pr AS (SELECT stop_id, edge_id, x, y, x1, y1, x2, y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1) END AS k FROM sx, ex),
nr AS (SELECT stop_id, edge_id, sqrt(pow(x - x1 - k * (x2 - x1), 2) + pow(y - y1 - k * (y2 - y1), 2)) AS dist FROM pr QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY dist, edge_id) = 1)"""
_POWER = "CASE " + " ".join(f"WHEN x < {t1} OR ({t1} = 100 AND x = 100) THEN {p0} + (x - ({t0})) * ({p1} - {p0}) / ({t1} - ({t0}))" for (t0, p0), (t1, p1) in zip(CURVE, CURVE[1:], strict=False)) + " END"
_DAYS = """dm AS (SELECT county, dayofyear(ts) AS day, avg(temp_c) AS t FROM weather GROUP BY ALL), md AS (SELECT county, median(t) AS mid FROM dm GROUP BY 1),
ext AS (SELECT county, 'summer' AS scenario, arg_min(day, (-t, day)) AS day FROM dm GROUP BY 1 UNION ALL SELECT county, 'winter', arg_min(day, (t, day)) FROM dm GROUP BY 1 UNION ALL SELECT county, 'median', arg_min(day, (abs(t - mid), day)) FROM dm JOIN md USING (county) GROUP BY 1)"""
_HOURLY = f"{_DAYS}, hx AS (SELECT scenario, hour(ts) AS hour, round_even(temp_c, 1) AS x FROM weather w JOIN ext e ON e.county = w.county AND e.day = dayofyear(w.ts)), hp AS (SELECT scenario, hour, avg({_POWER}) AS kw FROM hx GROUP BY ALL)"
_HVAC = f"""{_HOURLY}, sp AS (SELECT trip_id, min(arrival_s) / 3600.0::DOUBLE AS s, max(arrival_s) / 3600.0::DOUBLE AS e FROM stop_times GROUP BY 1),
nn AS (SELECT *, greatest(ceil((e - s) / 0.01::DOUBLE), 0)::BIGINT AS n FROM sp),
gr AS (SELECT trip_id, n, i, s + 0.01::DOUBLE * i AS t FROM nn, unnest(range(0, greatest(n, 1))) u(i)),
hh AS (SELECT scenario, hour, kw FROM (SELECT * FROM (SELECT DISTINCT scenario FROM hp) CROSS JOIN range(0, 24) h(hour)) LEFT JOIN hp USING (scenario, hour)),
gv AS (SELECT trip_id, a.scenario, CASE WHEN n < 2 THEN 0 ELSE (a.kw * (1 - (t - floor(t))) + b.kw * (t - floor(t))) * CASE WHEN i IN (0, n - 1) THEN 0.005::DOUBLE ELSE 0.01::DOUBLE END END AS kwh
  FROM gr JOIN hh a ON a.hour = floor(t)::BIGINT % 24 JOIN hh b ON b.hour = (floor(t)::BIGINT + 1) % 24 AND b.scenario = a.scenario),
iv AS (SELECT trip_id, scenario, CASE WHEN count(*) = count(kwh) THEN sum(kwh) END AS kwh FROM gv GROUP BY ALL)"""
#: The keyed recursion keeps one row per (origin, vertex), that of the least time so far.
_FASTEST = duck("roads", "ods", "stops").replace("WITH ", "WITH RECURSIVE ", 1) + """, r(o, v, c, p) USING KEY (o, v) AS (SELECT DISTINCT o, o, 0.0::DOUBLE, o::VARCHAR FROM ods
UNION SELECT n.o, n.v, n.c, n.p FROM (SELECT r.o, dst AS v, min(c + 60 * miles / speed_mph) AS c, arg_min(p || '>' || dst, c + 60 * miles / speed_mph) AS p FROM r JOIN roads ON src = r.v GROUP BY 1, 2) n
LEFT JOIN recurring.r b ON b.o = n.o AND b.v = n.v WHERE b.c IS NULL OR n.c < b.c)"""
_STEPS = "st AS (SELECT od_key, generate_subscripts(l, 1) AS k, unnest(l)::BIGINT AS vertex FROM (SELECT od_key, string_split(p, '>') AS l FROM ods JOIN r ON r.o = ods.o AND v = d))"
_CHOICE = f"{_VEHICLES}, {_ENERGY}, {_TRIPS}, tr AS (SELECT t.*, en.vehicle, energy_unit, gge_per_unit, energy_used, miles FROM trips t JOIN en ON en.shape_id::VARCHAR = t.service_id)"
_MPGE = lambda e: f"CASE WHEN {e} * gge_per_unit > 0 THEN miles / ({e} * gge_per_unit) END"
_INSIDE = " UNION ALL ".join(f"SELECT stop_id, '{i}' AS county_id FROM stops WHERE stop_lon > {x0} AND stop_lon < {x1} AND stop_lat > {y0} AND stop_lat < {y1}" for i, x0, y0, x1, y1 in COUNTIES)


def _albers(lat: str, lon: str) -> tuple[str, str]:
    """Coordinates on the equal-area plane, from the projection's definition."""
    south, north, lat0 = (math.radians(ALBERS[k]) for k in ("south", "north", "lat0"))
    n = (math.sin(south) + math.sin(north)) / 2
    c = math.cos(south) ** 2 + 2 * n * math.sin(south)
    r = f"({ALBERS['radius'] / n!r}::DOUBLE * sqrt({c!r}::DOUBLE - {2 * n!r}::DOUBLE * sin(radians({lat}))))"
    t = f"({n!r}::DOUBLE * radians(({lon}) - ({ALBERS['lon0']})))"
    return f"({r} * sin({t}))", f"({ALBERS['radius'] * math.sqrt(c - 2 * n * math.sin(lat0)) / n!r}::DOUBLE - {r} * cos({t}))"


_CORNERS = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
_SIDES = ", ".join(f"('{i}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, *box in COUNTIES for k in range(4) for a, b in [(_CORNERS(*box)[k], _CORNERS(*box)[(k + 1) % 4])])
_SNAP = f"""inner_stops AS ({_INSIDE}), lone AS (SELECT stop_id, {_albers("stop_lat", "stop_lon")[0]} AS x, {_albers("stop_lat", "stop_lon")[1]} AS y FROM stops WHERE stop_id NOT IN (SELECT stop_id FROM inner_stops)),
sd AS (SELECT county_id, {_albers("a2", "a1")[0]} AS x1, {_albers("a2", "a1")[1]} AS y1, {_albers("b2", "b1")[0]} AS x2, {_albers("b2", "b1")[1]} AS y2 FROM (VALUES {_SIDES}) t(county_id, a1, a2, b1, b2)),
pk AS (SELECT *, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1) AS k FROM lone, sd),
snapped AS (SELECT county_id, sqrt(pow(x - x1 - k * (x2 - x1), 2) + pow(y - y1 - k * (y2 - y1), 2)) AS dist FROM pk QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY dist, county_id) = 1)"""

_SEEN = f"""{duck("positions")}, o AS (SELECT vehicle_id, trip_id, lat, lon, epoch_us(ts) // 1000 AS t FROM positions QUALIFY row_number() OVER (PARTITION BY vehicle_id, epoch_us(ts) // 1000 ORDER BY trip_id, lat, lon) = 1),
b AS (SELECT *, lag(trip_id) OVER v AS pt, lag(t) OVER v AS pms, lag(lat) OVER v AS plat, lag(lon) OVER v AS plon FROM o WINDOW v AS (PARTITION BY vehicle_id ORDER BY t)),
g AS (SELECT *, pt IS NULL OR pt <> trip_id OR t - pms > 43200000 AS fresh FROM b), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY vehicle_id ORDER BY t) AS k FROM g),
m AS (SELECT vehicle_id, any_value(trip_id) AS trip_id, min(t) AS begun_ms, max(t) AS ended_ms, count(*) AS n, round(sum(CASE WHEN fresh THEN 0 ELSE {_KM("plat", "plon", "lat", "lon")} END), 4) AS km FROM s GROUP BY vehicle_id, k)"""

ORACLES = {
    "observed_trips": f"{_SEEN} SELECT * FROM m",
    # a trip has ended when the next one of its vehicle has begun, or when its silence has lasted, both within what the watermark has passed
    "streamed_trips": f"""{_SEEN}, w AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS mark FROM positions), n AS (SELECT *, lead(begun_ms) OVER (PARTITION BY vehicle_id ORDER BY begun_ms) AS next FROM m)
SELECT n.* EXCLUDE (next) FROM n, w WHERE ended_ms <= mark AND (next <= mark OR mark - ended_ms > 43200000 AND (next IS NULL OR next - ended_ms > 43200000))""",
    "path_energy_mpge": f"{duck('paths', 'edges')}, {_VEHICLES}, {_ENERGY} SELECT shape_id, vehicle, round(energy_used, 4) AS energy_used, round(miles, 4) AS miles, round({_MPGE('energy_used')}, 4) AS mpge FROM en",
    "trip_times": f"{duck('stop_times')}, s AS (SELECT trip_id, min(arrival_s) AS a, max(arrival_s) AS z FROM stop_times GROUP BY 1) SELECT trip_id, {_HMS('a')} AS start_time, {_HMS('z')} AS end_time, round((z - a) / 60, 4) AS trip_duration_minutes FROM s",
    "trips_with_counts": f"{duck('stop_times')}, {_TRIPS}, {_DATES}, s AS (SELECT trip_id, min(arrival_s) AS a FROM stop_times GROUP BY 1), n AS (SELECT c_custkey::VARCHAR AS service_id, count(*) AS trip_count FROM dates GROUP BY 1) SELECT trip_id, {_HMS('a')} AS start_time, trip_count FROM trips JOIN s USING (trip_id) JOIN n USING (service_id)",
    "calendar_service_counts": f"WITH {_DATES} SELECT c_custkey::VARCHAR AS service_id, count(*) AS trip_count FROM dates GROUP BY 1",
    "service_on_date": f"{duck('stop_times')}, {_TRIPS}, {_DATES} SELECT trip_id, service_id FROM trips WHERE service_id IN (SELECT c_custkey::VARCHAR FROM dates WHERE d = date '2024-02-07')",
    "block_route_filter_exclusive": f"{duck('stop_times')}, {_TRIPS} SELECT trip_id, block_id FROM trips WHERE block_id NOT IN (SELECT block_id FROM trips WHERE route_short_name NOT IN ('R0', 'R1'))",
    "block_route_filter_inclusive": f"{duck('stop_times')}, {_TRIPS} SELECT trip_id, block_id FROM trips WHERE block_id IN (SELECT block_id FROM trips WHERE route_short_name = 'R0')",
    "midblock_deadhead_trips": f"{duck('stop_times', 'stops')}, {_MID} SELECT from_trip || '_to_' || to_trip AS trip_id, from_trip, to_trip, block_id, 'Deadhead_from_' || from_trip || '_to_' || to_trip AS route_desc FROM mid",
    "midblock_deadhead_stops": f"""{duck("stop_times", "stops")}, {_LEGS}
SELECT trip_id, 1::INT AS stop_sequence, 'mid_block_deadhead_' || trip_id || '_1' AS stop_id, round(dep::DOUBLE, 2) AS arrival_s, round(o_lat, 6) AS stop_lat, round(o_lon, 6) AS stop_lon FROM legs
UNION ALL SELECT trip_id, 2, 'mid_block_deadhead_' || trip_id || '_2', round(arr, 2), round(d_lat, 6), round(d_lon, 6) FROM legs""",
    "deadhead_trip_times": f"{duck('stop_times', 'stops')}, {_LEGS} SELECT trip_id, round((arr - dep) / 60, 2) AS trip_duration_minutes, {_HMS('dep')} AS start_time FROM legs",
    "depot_assignment": f"{duck('stop_times', 'stops', 'depots')}, {_ENDS} SELECT block_id, idx::BIGINT AS depot_idx, round(way, 2) AS depot_way FROM placed",
    "depot_deadhead_trips": f"""{duck("stop_times")}, {_TRIPS}, {_DEPOT_TRIPS}
SELECT 'depot_to_' || f AS trip_id, 'from_depot_' || block_id AS route_id, fs AS service_id, block_id, 'Deadhead from depot to ' || f AS route_desc, 'pull-out' AS trip_type FROM bt
UNION ALL SELECT l || '_to_depot', 'to_depot_' || block_id, ls, block_id, 'Deadhead from ' || l || ' to depot', 'pull-in' FROM bt""",
    "depot_deadhead_stops": f"""{duck("stop_times", "stops", "depots")}, {_ENDS}, {_DEPOT_TRIPS},
dl AS (SELECT 'depot_to_' || f AS trip_id, true AS o, lat AS o_lat, lon AS o_lon, a_lat AS d_lat, a_lon AS d_lon, a_s AS t FROM bt JOIN placed USING (block_id) UNION ALL SELECT l || '_to_depot', false, z_lat, z_lon, lat, lon, z_s FROM bt JOIN placed USING (block_id)),
{_vincenty("dl")}
SELECT trip_id, 1::INT AS stop_sequence, round(CASE WHEN o THEN t - m / 30000 * 3600 ELSE t END, 2) AS arrival_s, round(o_lat, 6) AS stop_lat, round(o_lon, 6) AS stop_lon FROM geo
UNION ALL SELECT trip_id, 2, round(CASE WHEN o THEN t ELSE t + m / 30000 * 3600 END, 2), round(d_lat, 6), round(d_lon, 6) FROM geo""",
    "od_pairs_dedup": f"""{duck("stop_times", "stops")}, {_MID}, k AS (SELECT *, round(o_lon, 3) || ',' || round(o_lat, 3) || '->' || round(d_lon, 3) || ',' || round(d_lat, 3) AS od_key FROM legs0),
u AS (SELECT od_key, count(*) AS n_legs, arg_min(o_lat, trip_id) AS o_lat, arg_min(o_lon, trip_id) AS o_lon, arg_min(d_lat, trip_id) AS d_lat, arg_min(d_lon, trip_id) AS d_lon FROM k GROUP BY 1)
SELECT od_key, n_legs, round(o_lat, 5) AS o_lat, round(d_lon, 5) AS d_lon, round({_KM("o_lat", "o_lon", "d_lat", "d_lon")} * 1000, 2) AS distance_m, {_KM("o_lat", "o_lon", "d_lat", "d_lon")} * 1000 < 200 AS straight FROM u""",
    "straight_line_shapes": f"""{duck("stop_times", "stops")}, {_MID}, k AS (SELECT *, round(o_lon, 3) || ',' || round(o_lat, 3) || '->' || round(d_lon, 3) || ',' || round(d_lat, 3) AS shape_id FROM legs0),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY shape_id ORDER BY trip_id) = 1)
SELECT shape_id, 1::INT AS shape_pt_sequence, round(o_lat, 5) AS lat, round(o_lon, 5) AS lon, 0.0::DOUBLE AS km FROM u
UNION ALL SELECT shape_id, 2, round(d_lat, 5), round(d_lon, 5), round({_KM("o_lat", "o_lon", "d_lat", "d_lon")}, 5) FROM u""",
    "segment_distance_cumulative": f"{duck('stop_times', 'stops')}, {_SEG} SELECT shape_id, seq AS shape_pt_sequence, round(seg, 5) AS seg_km, round(km, 5) AS cum_km FROM cum",
    "upsample_1hz": f"""{duck("stop_times", "stops")}, {_SEG},
o AS (SELECT *, CASE WHEN max(km) OVER q > 0 THEN round_even(km / max(km) OVER q * round_even(sum(seg) OVER q / 30 * 3600, 0), 0)::BIGINT ELSE 0 END AS t FROM cum WINDOW q AS (PARTITION BY shape_id)),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY shape_id, t ORDER BY seq) = 1),
n AS (SELECT *, lead(t) OVER w AS t1, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(km) OVER w AS km1 FROM f WINDOW w AS (PARTITION BY shape_id ORDER BY t)),
g AS (SELECT shape_id, i AS second, lat + coalesce((lat1 - lat) * (i - t) / (t1 - t), 0) AS lat, lon + coalesce((lon1 - lon) * (i - t) / (t1 - t), 0) AS lon, km + coalesce((km1 - km) * (i - t) / (t1 - t), 0) AS km FROM n, unnest(range(t, coalesce(t1, t + 1))) u(i))
SELECT shape_id, count(*) AS n_points, max(second) AS last_second, round(avg(lat), 4) AS avg_lat, round(avg(lon), 4) AS avg_lon, round(max(km), 3) AS km FROM g GROUP BY 1""",
    "trip_point_timestamps": f"{duck('stop_times', 'stops')}, {_TIMED} SELECT shape_id AS trip_id, seq, t AS timestamp_s, (near % 86400 // 3600)::INT AS hour, (near % 3600 // 60)::INT AS minute FROM tt",
    "link_aggregation": f"""{duck("stop_times", "stops")}, {_TIMED} SELECT shape_id AS trip_id, stop_id AS road_id, round(arg_min(lat, seq), 5) AS start_lat, round(arg_max(lon, seq), 5) AS end_lon, arg_min(t, seq) AS start_timestamp_s, arg_max(t, seq) AS end_timestamp_s,
round(avg(seg), 4) AS kilometers, round(avg(seg / 30 * 3600) / 60, 3) AS travel_time_minutes FROM tt GROUP BY 1, 2""",
    "stop_nearest_edge": f"{duck('stops', 'edges')}, {_NEAR} SELECT stop_id, edge_id, round(dist, 2) AS distance FROM nr",
    "trip_stop_edges": f"{duck('stops', 'edges', 'stop_times')}, {_NEAR} SELECT DISTINCT trip_id, edge_id FROM stop_times JOIN nr USING (stop_id)",
    "stop_flags": f"""{duck("stop_times", "stops")}, {_PTS}, m AS (SELECT shape_id, seq AS sid, lat + 1e-4 AS slat, lon AS slon FROM pts),
pr AS (SELECT m.shape_id, sid, seq, (slat - lat) * (slat - lat) + (slon - lon) * (slon - lon) AS d FROM m JOIN pts USING (shape_id)),
h AS (SELECT DISTINCT shape_id, seq FROM (SELECT *, min(d) OVER (PARTITION BY shape_id, sid) AS lo FROM pr) WHERE d = lo)
SELECT p.shape_id AS trip_id, p.seq AS coordinate_id, (h.seq IS NOT NULL)::INT AS with_stop FROM pts p LEFT JOIN h ON h.shape_id = p.shape_id AND h.seq = p.seq""",
    "county_snap_3km": f"{duck('stops')}, {_SNAP} SELECT county_id FROM inner_stops UNION SELECT county_id FROM snapped WHERE dist <= 3000",
    "county_intersect": f"{duck('stops')} {_INSIDE}",
    "bounding_box": f"{duck('stop_times', 'stops')}, {_PTS} SELECT round(min(lon) - 0.05, 6) AS min_lon, round(min(lat) - 0.05, 6) AS min_lat, round(max(lon) + 0.05, 6) AS max_lon, round(max(lat) + 0.05, 6) AS max_lat FROM pts",
    "power_curve": f"{duck('weather')}, k AS (SELECT round_even(temp_c * 10, 0)::BIGINT AS tenths, count(*) AS n FROM weather GROUP BY 1), g AS (SELECT tenths, n, tenths / 10.0::DOUBLE AS x FROM k WHERE tenths BETWEEN -1000 AND 1000) SELECT tenths, n, round({_POWER}, 6) AS power_kw FROM g",
    "extreme_days": f"{duck('weather')}, {_DAYS} SELECT county, scenario, day::BIGINT AS day FROM ext",
    "hourly_power_by_scenario": f"{duck('weather')}, {_HOURLY} SELECT scenario, hour::BIGINT AS hour, round(kw, 5) AS power_kw FROM hp",
    "hvac_energy_by_trip": f"{duck('weather', 'stop_times')}, {_HVAC} SELECT trip_id, scenario, round(kwh, 4) AS hvac_energy_kwh FROM iv",
    "hvac_scenarios_fanout": f"{duck('weather', 'stop_times', 'paths', 'edges')}, {_CHOICE}, {_HVAC}, x AS (SELECT tr.*, scenario, energy_used + CASE WHEN energy_unit = 'kWh' THEN kwh ELSE 0 END AS e2 FROM tr LEFT JOIN iv USING (trip_id)) SELECT trip_id, vehicle, scenario, round(e2, 3) AS energy_used, round({_MPGE('e2')}, 3) AS mpge FROM x",
    "trip_results_without_hvac": f"{duck('stop_times', 'paths', 'edges')}, {_CHOICE} SELECT trip_id, vehicle, block_id, round(energy_used, 4) AS energy_used, round({_MPGE('energy_used')}, 4) AS mpge FROM tr",
    "kwh_per_mile_by_scenario": f"{duck('weather', 'stop_times', 'paths', 'edges')}, {_CHOICE}, {_HVAC} SELECT scenario, round(avg((energy_used + kwh) / miles), 4) AS kwh_per_mile FROM tr LEFT JOIN iv USING (trip_id) WHERE energy_unit = 'kWh' AND miles > 0 GROUP BY 1",
    "stop_penalty_energy": f"""{duck("paths", "edges", "stops")}, {_VEHICLES}, {_ENERGY}, {_NEAR},
k AS (SELECT shape_id, vehicle, used + CASE WHEN edge_id IN (SELECT edge_id FROM nr) THEN 0.5 * mass_kg * pow(speed_mph * 0.44704, 2) / 3.6e6 / CASE WHEN kind = 'bev' THEN 1 ELSE 33.7 * 1.136 END ELSE 0 END AS e FROM el)
SELECT shape_id, vehicle, round(sum(e), 4) AS energy_used FROM k GROUP BY 1, 2""",
    "binned_rate_energy": f"""{duck("paths", "edges", "rates")},
b AS (SELECT edge_id, miles, vehicle, coalesce(max(speed_from) FILTER (speed_from <= speed_mph), min(speed_from)) AS speed_from, coalesce(max(grade_from) FILTER (grade_from <= grade), min(grade_from)) AS grade_from FROM edges, rates GROUP BY 1, 2, 3)
SELECT shape_id, vehicle, round(sum(rate * miles), 4) AS energy_used, round(sum(miles), 4) AS miles FROM paths JOIN b USING (edge_id) JOIN rates USING (vehicle, speed_from, grade_from) GROUP BY 1, 2""",
    "edge_grades": f"""{duck("street_ends", "raster")}, e AS (SELECT *, {_KM("lat1", "lon1", "lat2", "lon2")} * 1000 AS run FROM street_ends),
q AS (SELECT edge_id, run, k, (lon1 + (lon2 - lon1) * k / n + 111.905::DOUBLE) / 0.0008::DOUBLE AS x, (lat1 + (lat2 - lat1) * k / n - 40.295::DOUBLE) / 0.0008::DOUBLE AS y FROM (SELECT *, greatest(ceil(run / 30), 1)::BIGINT AS n FROM e), unnest(range(0, n + 1)) u(k)),
f AS (SELECT *, floor(x)::BIGINT AS i, floor(y)::BIGINT AS j, x - floor(x) AS a, y - floor(y) AS b FROM q),
h AS (SELECT edge_id, run, k, (s00.height * (1 - a) + s10.height * a) * (1 - b) + (s01.height * (1 - a) + s11.height * a) * b AS h FROM f
  LEFT JOIN raster s00 ON s00.i = f.i AND s00.j = f.j LEFT JOIN raster s10 ON s10.i = f.i + 1 AND s10.j = f.j LEFT JOIN raster s01 ON s01.i = f.i AND s01.j = f.j + 1 LEFT JOIN raster s11 ON s11.i = f.i + 1 AND s11.j = f.j + 1),
s AS (SELECT *, avg(h) OVER (PARTITION BY edge_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM h), up AS (SELECT *, greatest(s - lag(s) OVER (PARTITION BY edge_id ORDER BY k), 0) AS u FROM s)
SELECT edge_id, CASE WHEN count(*) = count(h) THEN round((arg_max(s, k) - arg_min(s, k)) / max(run), 6) END AS grade, CASE WHEN count(*) = count(h) THEN round(sum(u), 4) END AS climb_m FROM up GROUP BY 1""",
    "trip_charge": f"""{duck("paths", "edges", "stops", "trip_parameters")}, {_VEHICLES}, {_ENERGY}, {_NEAR},
k AS (SELECT t.trip_id, el.vehicle, el.seq, el.battery_kwh, start_soc, sum(used + CASE WHEN include_stop_penalty AND edge_id IN (SELECT edge_id FROM nr) THEN 0.5 * mass_kg * pow(speed_mph * 0.44704, 2) / 3.6e6 ELSE 0 END) OVER (PARTITION BY t.trip_id, el.vehicle ORDER BY el.seq) AS run
  FROM trip_parameters t JOIN el ON el.shape_id = t.shape_id WHERE kind = 'bev')
SELECT trip_id, vehicle, round(max(run), 4) AS energy_used, round(greatest(max(start_soc) - 100 * max(run) / max(battery_kwh), 0), 4) AS end_soc, coalesce(min(seq) FILTER (run > start_soc / 100 * battery_kwh), 0) AS empty_seq FROM k GROUP BY 1, 2""",
    "soc_limited_paths": f"""{duck("paths", "edges")}, {_VEHICLES}, {_ENERGY}, c AS (SELECT shape_id, vehicle, CASE WHEN kind = 'bev' THEN 3 - 100 * energy_used / battery_kwh END AS soc FROM en JOIN veh USING (vehicle))
SELECT shape_id, vehicle, round(soc, 3) AS trip_soc, coalesce(soc > 0, true) AS in_reach FROM c""",
    "fastest_paths": f"{_FASTEST} SELECT od_key, round(c, 4) AS minutes, p AS path FROM ods JOIN r ON r.o = ods.o AND v = d",
    "routed_shapes": f"""{_FASTEST}, {_STEPS}, pl AS (SELECT st.*, stop_lat AS lat, stop_lon AS lon FROM st JOIN stops ON stop_id = 'S' || vertex),
sg AS (SELECT *, coalesce({_KM("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")}, 0) AS seg FROM pl WINDOW w AS (PARTITION BY od_key ORDER BY k))
SELECT od_key AS shape_id, k::INT AS shape_pt_sequence, round(lat, 5) AS lat, round(lon, 5) AS lon, round(sum(seg) OVER (PARTITION BY od_key ORDER BY k), 4) AS km FROM sg""",
    "match_lcss_paths": f"""{duck("street_edges", "street_lines")}, nx AS (SELECT shape, t, vertex_id, lead(vertex_id) OVER (PARTITION BY shape ORDER BY t) AS after FROM street_lines)
SELECT 'L' || shape AS shape_id, (t + 1)::INT AS seq, edge_id FROM nx JOIN street_edges ON src = vertex_id AND dst = after""",
    "turn_aware_paths": f"""{duck("street_edges", "street_ods").replace("WITH ", "WITH RECURSIVE ", 1)}, h AS (SELECT a.edge_id AS a, b.edge_id AS b, 60 * b.miles / b.speed_mph AS minutes, CASE WHEN b.heading - a.heading >= 180 THEN b.heading - a.heading - 360 WHEN b.heading - a.heading < -180 THEN b.heading - a.heading + 360 ELSE b.heading - a.heading END AS d FROM street_edges a JOIN street_edges b ON b.src = a.dst),
mv AS (SELECT a, b, minutes + CASE WHEN d = 0 THEN 0 WHEN d = -180 THEN 9.5 WHEN d = 90 THEN 1 ELSE 2.5 END::DOUBLE / 60 AS c FROM h),
r(o, e, c, p) USING KEY (o, e) AS (SELECT DISTINCT o, edge_id, 60 * miles / speed_mph, edge_id::VARCHAR FROM street_ods JOIN street_edges ON src = o
UNION SELECT n.o, n.e, n.c, n.p FROM (SELECT r.o, mv.b AS e, min(r.c + mv.c) AS c, arg_min(p || '>' || mv.b, r.c + mv.c) AS p FROM r JOIN mv ON mv.a = r.e GROUP BY 1, 2) n
LEFT JOIN recurring.r b ON b.o = n.o AND b.e = n.e WHERE b.c IS NULL OR n.c < b.c)
SELECT od_key, round(min(c), 4) AS minutes, arg_min(p, c) AS edges FROM street_ods JOIN street_edges ON dst = d JOIN r ON r.o = street_ods.o AND e = edge_id WHERE street_ods.o <> d GROUP BY 1""",
    # energy comes in quarters of a kWh, so the least minutes of each energy spent can be a key
    "charge_limited_paths": f"""{duck("charge_roads", "charge_ods").replace("WITH ", "WITH RECURSIVE ", 1)}, r(k, v, u, c, p) USING KEY (k, v, u) AS (SELECT od_key, o, 0::BIGINT, 0.0::DOUBLE, o::VARCHAR FROM charge_ods
UNION SELECT n.k, n.v, n.u, n.c, n.p FROM (SELECT r.k, dst AS v, r.u + (kwh * 4)::BIGINT AS u, min(c + minutes) AS c, arg_min(p || '>' || dst, c + minutes) AS p FROM r JOIN charge_roads ON src = r.v JOIN charge_ods ON od_key = r.k WHERE r.u + kwh * 4 <= charge_kwh * 4 GROUP BY 1, 2, 3) n
LEFT JOIN recurring.r b ON b.k = n.k AND b.v = n.v AND b.u = n.u WHERE b.c IS NULL OR n.c < b.c)
SELECT od_key, round(min(c), 4) AS minutes, arg_min(u, c) / 4.0::DOUBLE AS kwh, arg_min(p, c) AS path FROM charge_ods JOIN r ON k = od_key AND v = d WHERE o <> d GROUP BY 1""",
    "match_nearest_paths": f"""{duck("stop_times", "stops", "edges")}, {_PTS}, {_NEAR},
m AS (SELECT shape_id, seq, edge_id, lag(edge_id) OVER (PARTITION BY shape_id ORDER BY seq) AS before FROM pts JOIN nr USING (stop_id))
SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY seq)::INT AS seq, edge_id FROM m WHERE before IS NULL OR before <> edge_id""",
    "soc_trace": f"{duck('paths', 'edges')}, {_VEHICLES}, {_ENERGY}, r AS (SELECT *, sum(used) OVER (PARTITION BY shape_id, vehicle ORDER BY seq) AS run FROM el WHERE kind = 'bev') SELECT shape_id, seq, round(run, 3) AS trip_energy, round(100 - 100 * run / battery_kwh, 3) AS trip_soc FROM r",
    "turn_delay": f"""{duck("paths", "edges")}, h AS (SELECT shape_id, seq, heading - lag(heading) OVER (PARTITION BY shape_id ORDER BY seq) AS d FROM paths JOIN edges USING (edge_id)),
k AS (SELECT shape_id, seq, CASE WHEN d >= 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END AS d FROM h)
SELECT shape_id, seq, (CASE WHEN d IS NULL OR abs(d) <= 20 THEN 0 WHEN abs(d) > 160 THEN 9.5 WHEN d > 0 THEN CASE WHEN d <= 45 THEN 0.5 WHEN d <= 135 THEN 1 ELSE 1.5 END ELSE CASE WHEN d >= -45 THEN 1 WHEN d >= -135 THEN 2.5 ELSE 3.5 END END)::DOUBLE AS delay_s FROM k""",
    "route_cost": f"{duck('paths', 'edges')}, {_VEHICLES}, {_ENERGY}, mi AS (SELECT shape_id, sum(60 * miles / speed_mph) AS minutes FROM paths JOIN edges USING (edge_id) GROUP BY 1) SELECT shape_id, vehicle, round(0.655 * miles + 0.333336 * minutes + CASE WHEN energy_unit = 'kWh' THEN 0.5 * energy_used ELSE 3.12 * energy_used * gge_per_unit END, 3) AS cost FROM en JOIN mi USING (shape_id)",
    "link_vehicle_rows": f"{duck('paths', 'edges')}, {_VEHICLES}, {_ENERGY} SELECT shape_id, seq, edge_id, vehicle, energy_unit, round(energy_used, 4) AS energy_used FROM paths LEFT JOIN en USING (shape_id)",
    "path_traversal_summary": f"{duck('paths', 'edges')} SELECT shape_id, round(sum(miles), 4) AS miles, round(avg(speed_mph), 4) AS avg_speed, round(avg(grade), 6) + 0.0::DOUBLE AS avg_grade, arg_max(edge_id, seq) AS last_edge, string_agg(edge_id::VARCHAR, ',' ORDER BY seq) AS edge_list FROM paths JOIN edges USING (edge_id) GROUP BY 1",
    "trips_union_by_name": f"""{duck("stop_times", "stops")}, {_MID}, u AS (SELECT 'service' AS trip_type, block_id FROM trips UNION ALL SELECT 'mid_block_deadhead', block_id FROM mid UNION ALL SELECT 'pull-out', block_id FROM (SELECT DISTINCT block_id FROM trips) UNION ALL SELECT 'pull-in', block_id FROM (SELECT DISTINCT block_id FROM trips))
SELECT trip_type, count(*) AS n_trips, 0::BIGINT AS n_agency, count(DISTINCT block_id) AS n_blocks FROM u GROUP BY 1""",
    "feed_catalog_qa": """WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events) SELECT event_id, CASE WHEN k % 5 > 0 THEN k % 2 = 0 END AS has_shapes, CASE WHEN k % 5 > 0 THEN k % 3 > 0 END AS has_errors, coalesce(k % 5 > 0 AND k % 2 = 0 AND k % 3 = 0, false) AS download FROM e""",
    "feed_centres": "SELECT s_suppkey AS id, round(s_suppkey % 90 + 0.875, 4)::DOUBLE AS lat, round(s_suppkey % 90 - 98.75, 4)::DOUBLE AS lon FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey % 3 > 0",
    "trip_shape_quality": f"{duck('stop_times')}, {_TRIPS} SELECT service_id, count(*) AS bus_trips, bool_and(user_id % 5 > 0) AS all_shapes FROM trips WHERE route_short_name <> 'R2' GROUP BY 1",
    "summary_stats": f"""{duck('paths', 'edges')}, {_VEHICLES}, {_ENERGY} SELECT vehicle, count(*) AS n, round(avg(energy_used), 3) AS avg_energy, round(stddev_samp(energy_used), 3) AS std_energy, round(min(energy_used), 3) AS min_energy,
round(quantile_disc(energy_used, 0.25), 3) AS p25_energy, round(quantile_disc(energy_used, 0.5), 3) AS p50_energy, round(quantile_disc(energy_used, 0.75), 3) AS p75_energy, round(max(energy_used), 3) AS max_energy FROM en GROUP BY 1""",
    "realtime_vehicle_filter": "SELECT event_id::VARCHAR AS id, 'V' || user_id AS vehicle_id, 'T' || user_id AS trip_id, round(40 + user_id / 1000.0::DOUBLE, 4) AS lat FROM events WHERE event_type <> 'error'",
}
