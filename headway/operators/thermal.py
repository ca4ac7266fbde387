"""Heating and cooling energy: power curve, extreme days, scenario power by hour, integral over a trip."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values: °C and kW of the control points, linear between them.
CURVE = [(-100, 197.3), (-10, 29.9), (-5, 20.6), (0, 12.1), (5, 6.8), (10, 4.2), (15, 1.1), (20, 1.1), (25, 3.4), (30, 5.5), (35, 9.1), (40, 16.6), (100, 106.6)]
SCENARIOS = ("summer", "winter", "median")
STEP_H = 0.01


def power_kw(temp_c: Column) -> Column:
    """Closed form of the curve; null outside of it."""
    out = None
    for (t0, p0), (t1, p1) in pairwise(CURVE):
        value = F.lit(float(p0)) + (temp_c - F.lit(float(t0))) * F.lit((p1 - p0) / (t1 - t0))
        inside = (temp_c >= t0) & ((temp_c < t1) if t1 < 100 else (temp_c <= t1))
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out


def power_table(spark: SparkSession) -> DataFrame:
    """The curve at every tenth of a degree, -100.0 to 100.0, keyed by integer tenths."""
    t = spark.range(-1000, 1001).withColumnRenamed("id", "tenths")
    return t.withColumn("power_kw", power_kw(F.col("tenths") / 10.0))


def extreme_days(weather: DataFrame) -> DataFrame:
    """(county, scenario, day): coldest, hottest, and closest to the median of daily means; ties to the earliest day."""
    days = weather.groupBy("county", F.dayofyear("ts").alias("day")).agg(F.avg("temp_c").alias("mean_c"))
    mid = F.percentile("mean_c", F.lit(0.5)).over(Window.partitionBy("county"))
    d = days.withColumn("_off", F.abs(F.col("mean_c") - mid))
    best = d.groupBy("county").agg(
        F.min(F.struct(-F.col("mean_c"), F.col("day").alias("day"))).alias("summer"), F.min(F.struct("mean_c", "day")).alias("winter"), F.min(F.struct("_off", "day")).alias("median")
    )
    return best.select("county", F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(f"{s}.day").alias("day")) for s in SCENARIOS])).alias("r")).select("county", "r.*")


def hourly_power(weather: DataFrame, days: DataFrame) -> DataFrame:
    """(scenario, hour, power_kw): the curve at temperatures of one decimal, averaged over counties."""
    on = weather.withColumn("day", F.dayofyear("ts")).join(F.broadcast(days), ["county", "day"])
    return on.groupBy("scenario", F.hour("ts").alias("hour")).agg(F.avg(power_kw(F.bround(F.col("temp_c"), 1))).alias("power_kw"))


def power_by_scenario(power: DataFrame) -> DataFrame:
    """One row per scenario with its 24 hourly powers as an array, and with their running sums and counts of gaps before each hour of
    a day and at its end; an hour without data is null, and so is the energy of a trip that touches it."""
    m = power.groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct("hour", "power_kw"))).alias("m"))
    m = m.select("scenario", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.element_at("m", h)).alias("kw"))
    kw_before, gaps_before = running(F.col("kw"))
    return m.select("scenario", "kw", kw_before.alias("kw_before"), gaps_before.alias("gaps_before"))


def running(kw: Column) -> tuple[Column, Column]:
    """(sums of the powers, counts of gaps) before each hour of a day and at its end."""
    run = lambda value: F.transform(F.sequence(F.lit(0), F.lit(24)), lambda h: F.aggregate(F.slice(kw, F.lit(1), h), F.lit(0.0), lambda s, x: s + value(x)))
    return run(lambda x: F.coalesce(x, F.lit(0.0))), run(lambda x: F.when(x.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))


def integral_kwh(start_h: Column, end_h: Column, kw: Column, kw_before: Column | None = None, gaps_before: Column | None = None) -> Column:
    """Trapezoids of 0.01 h from start, end excluded, over power that is linear between hours and repeats daily.

    Inside one hour the power of grid point k is a + b * k, so a run of points adds up in closed form.  An hour that is passed
    whole has 100 points, at the same places in each, so all such hours together cost a difference of running sums: a trip costs the
    same however long it is.  Power is continuous, so it does not matter on which side of an hour a rounding puts a point.
    ``kw_before`` and ``gaps_before`` are those of ``running``, which many trips share.
    """
    if kw_before is None or gaps_before is None:
        kw_before, gaps_before = running(kw)
    n = F.greatest(F.ceil((end_h - start_h) / F.lit(STEP_H)).cast("long"), F.lit(0))
    last = n - 1
    first_hour = F.floor(start_h)
    last_hour = F.floor(start_h + F.lit(STEP_H) * last)
    of_day = lambda h: F.pmod(h, F.lit(24)).cast("int")
    power = lambda h: F.coalesce(F.get(kw, of_day(h)), F.lit(0.0))
    before = lambda runs, h: F.floor(h / F.lit(24)) * F.get(runs, F.lit(24)) + F.get(runs, of_day(h))

    def run(h: Column, k0: Column, k1: Column) -> Column:
        """Points k0..k1, which lie in hour h."""
        slope = power(h + 1) - power(h)
        return (k1 - k0 + 1) * (power(h) + slope * (start_h - h) + slope * F.lit(STEP_H) * (k0 + k1) / 2)

    def at(k: Column, h: Column) -> Column:
        return power(h) + (power(h + 1) - power(h)) * (start_h + F.lit(STEP_H) * k - h)

    second = F.ceil((first_hour + 1 - start_h) / F.lit(STEP_H))  # the first point of the second hour
    inner = last_hour - first_hour - 1
    shift = start_h + F.lit(STEP_H) * second - (first_hour + 1)
    whole = 100 * (before(kw_before, last_hour) - before(kw_before, first_hour + 1)) + (power(last_hour) - power(first_hour + 1)) * (100 * shift + 49.5)
    more = run(first_hour, F.lit(0), second - 1) + whole + run(last_hour, second + 100 * inner, last)
    total = F.when(inner < 0, run(first_hour, F.lit(0), last)).otherwise(more)
    kwh = F.lit(STEP_H) * (total - (at(F.lit(0), first_hour) + at(last, last_hour)) / 2)
    known = before(gaps_before, last_hour + 2) == before(gaps_before, first_hour)
    return F.when(n > 1, F.when(known, kwh)).otherwise(F.lit(0.0))


def trip_hvac(spans: DataFrame, power: DataFrame) -> DataFrame:
    """(trip_id, scenario, hvac_energy_kwh) for trips (trip_id, start_s, end_s); three rows a trip."""
    s = spans.join(F.broadcast(power_by_scenario(power)))
    kwh = integral_kwh(F.col("start_s") / 3600.0, F.col("end_s") / 3600.0, F.col("kw"), F.col("kw_before"), F.col("gaps_before"))
    return s.select("trip_id", "scenario", kwh.alias("hvac_energy_kwh"))
