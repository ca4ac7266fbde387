import math

import numpy as np
import pytest
from headway.functions import clock, energy, geo
from headway.operators import thermal
from pyspark.sql import functions as F


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


L = lambda x: F.lit(float(x))


def test_haversine(spark):
    assert value(spark, geo.haversine_km(L(0), L(0), L(1), L(0))) == pytest.approx(111.19, abs=0.01)
    assert value(spark, geo.haversine_km(L(0), L(0), L(0), L(1))) == pytest.approx(111.19, abs=0.01)
    assert value(spark, geo.haversine_km(L(5), L(6), L(5), L(6))) == 0


def test_geodesic_known_distances(spark):
    # one degree of the equator and the meridian arc of the first degree on WGS-84
    assert value(spark, geo.geodesic_m(L(0), L(0), L(0), L(1))) == pytest.approx(111319.4908, abs=1e-3)
    assert value(spark, geo.geodesic_m(L(0), L(0), L(1), L(0))) == pytest.approx(110574.3886, abs=1e-3)
    assert value(spark, geo.geodesic_m(L(40), L(-105), L(40), L(-105))) == 0


def test_mercator_and_polygons(spark):
    x, y = geo.mercator(L(0), L(180))
    assert value(spark, x) == pytest.approx(math.pi * 6378137) and value(spark, y) == pytest.approx(0, abs=1e-6)
    ring = F.array(*[F.struct(L(a).alias("x"), L(b).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    assert value(spark, geo.inside(L(1), L(1), ring)) and not value(spark, geo.inside(L(2), L(3), ring))
    assert value(spark, geo.ring_distance(L(2), L(-3), ring)) == 3
    ax, ay = geo.albers(L(40), L(-111))
    bx, by = geo.albers(L(40.01), L(-111))
    assert value(spark, geo.planar(ax, ay, bx, by)) == pytest.approx(1113, rel=0.02)


@pytest.mark.parametrize(("s", "text"), [(0, "00:00:00"), (90061, "25:01:01"), (-30, "-00:00:30"), (59, "00:00:59"), (360000, "100:00:00")])
def test_hms(spark, s, text):
    assert value(spark, clock.hms(F.lit(s))) == text
    assert value(spark, clock.parse_hms(F.lit(text))) == s


def test_clock(spark):
    assert value(spark, clock.hms(F.lit(None).cast("long"))) == ""
    assert value(spark, clock.parse_hms(F.lit("x"))) is None and value(spark, clock.parse_hms(F.lit(" 8:05:00"))) == 29100
    assert [value(spark, clock.nearest_five_minutes(F.lit(s))) for s in (28950, 29250)] == [28800, 29400]  # half-even
    assert value(spark, clock.hour_of_day(F.lit(90600))) == 1


def test_energy(spark):
    assert value(spark, energy.mpge(L(10), L(33.7), L(1 / 33.7))) == pytest.approx(10)
    assert value(spark, energy.mpge(L(10), L(2), L(1.136))) == pytest.approx(10 / (2 * 1.136))
    assert value(spark, energy.mpge(L(10), L(0), L(1))) is None and value(spark, energy.mpge(L(10), L(-5), L(1))) is None
    assert value(spark, energy.stop_penalty(L(10000), L(10 / 0.44704), F.lit("bev"))) == pytest.approx(0.5 * 10000 * 100 / 3.6e6)
    assert value(spark, energy.state_of_charge(L(100), L(44), L(440))) == 90
    assert value(spark, energy.rate_by_unit(L(2), F.lit("kWh/mi"), L(1.5))) == 3
    delays = [value(spark, energy.turn_delay(L(a), L(b))) for a, b in ((0, 10), (350, 20), (0, 90), (90, 0), (0, 180), (0, 150), (150, 0))]
    assert delays == [0.0, 0.5, 1.0, 2.5, 9.5, 1.5, 3.5]
    assert value(spark, energy.turn_delay(F.lit(None).cast("double"), L(3))) == 0.0


def test_power_curve_and_integral(spark):
    assert value(spark, thermal.power_kw(L(20))) == pytest.approx(1.1) and value(spark, thermal.power_kw(L(-100))) == 197.3
    assert value(spark, thermal.power_kw(L(100))) == pytest.approx(106.6) and value(spark, thermal.power_kw(L(101))) is None
    assert thermal.power_table(spark).count() == 2001
    ten = F.array(*[F.lit(10.0)] * 24)
    assert value(spark, thermal.integral_kwh(L(0), L(1), ten)) == pytest.approx(9.9)
    assert value(spark, thermal.integral_kwh(L(0), L(0.5), ten)) == pytest.approx(4.9)
    assert value(spark, thermal.integral_kwh(L(3), L(3), ten)) == 0
    ramp = F.array(*[F.lit(float(h)) for h in range(24)])
    assert value(spark, thermal.integral_kwh(L(23.5), L(24.5), ramp)) > 0


def test_hvac_of_whole_hours(spark):
    # each grid point by itself, against hours that are passed at once
    kw = [5.0 + 3 * ((h * 7) % 11) for h in range(24)]
    table = F.array(*map(F.lit, kw))
    for start, end in ((0.0, 1.0), (5.25, 5.9), (6.993, 8.004), (7.5, 19.37), (22.2, 51.6), (-3.3, 4.41), (9.0, 12.0), (3.1, 3.105), (1 / 3, 100.0)):
        n = int(np.ceil((end - start) / 0.01))
        t = start + 0.01 * np.arange(n)
        h = np.floor(t).astype(int)
        p = np.array([kw[a % 24] * (1 - b) + kw[(a + 1) % 24] * b for a, b in zip(h, t - h)])
        want = 0.01 * (p.sum() - (p[0] + p[-1]) / 2) if n > 1 else 0.0
        assert value(spark, thermal.integral_kwh(L(start), L(end), table)) == pytest.approx(want, rel=1e-9)
    gap = F.array(*[F.lit(None if h == 9 else 1.0).cast("double") for h in range(24)])
    assert value(spark, thermal.integral_kwh(L(6.5), L(7.895), gap)) == pytest.approx(1.39)
    assert value(spark, thermal.integral_kwh(L(6.5), L(8.2), gap)) is None
    assert "lambda" not in spark.range(1).withColumn("kw", table).select(thermal.integral_kwh(F.col("id") + 1.0, F.col("id") + 9.0, F.col("kw"), F.col("kw"), F.col("kw")))._jdf.queryExecution().optimizedPlan().toString().lower()
