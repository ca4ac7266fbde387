"""Unit constants, the vehicle catalogue, and energy expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Gasoline-gallon equivalents and unit conversions.
KWH_PER_GGE = 33.7
GGE_PER_GAL_DIESEL = 1.136
MI_PER_KM = 0.6213712
M_PER_KM = 1000.0
M_PER_FT = 0.3048
MI_PER_FT = 1 / 5280
MPS_PER_MPH = 0.44704
JOULES_PER_KWH = 3.6e6

#: Name, kind, energy column, unit, gasoline-gallon equivalents of a unit, mass in kg, battery in kWh,
#: linear rate coefficients per mile: constant, per mph, per unit of uphill grade.
VEHICLES = [
    ("Transit_Bus_Battery_Electric", "bev", "trip_energy_electric", "kWh", 1 / KWH_PER_GGE, 16_500.0, 440.0, 1.6 + 1 / 3000, 0.008, 9.0),
    ("Transit_Bus_Diesel", "ice", "trip_energy_liquid", "gallons diesel", GGE_PER_GAL_DIESEL, 14_500.0, None, 0.17 + 1 / 7000, 0.0006, 0.9),
]
SCHEMA = "vehicle string, kind string, energy_field string, energy_unit string, gge_per_unit double, mass_kg double, battery_kwh double, rate0 double, rate_mph double, rate_grade double"

#: Bounds of the absolute change of heading in degrees, then seconds for a right and for a left turn.
TURNS = [("no turn", 20.0, 0.0, 0.0), ("slight", 45.0, 0.5, 1.0), ("turn", 135.0, 1.0, 2.5), ("sharp", 160.0, 1.5, 3.5), ("u turn", 180.0, 9.5, 9.5)]

#: Prices by which routes compete.
COST_RATES = {"miles": 0.655, "minutes": 0.333336, "gge": 3.12, "kwh": 0.5}


def vehicle_catalog(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """One row per vehicle model; further powertrains are further rows."""
    return spark.createDataFrame([*VEHICLES, *extra], SCHEMA).coalesce(1)


def edge_rate(speed_mph: Column, grade: Column) -> Column:
    """Energy a mile; descents cost no less than level road."""
    return F.col("rate0") + F.col("rate_mph") * speed_mph + F.col("rate_grade") * F.greatest(grade, F.lit(0.0))


def stop_penalty(mass_kg: Column, speed_mph: Column, kind: Column) -> Column:
    """Kinetic energy lost in one stop, in kWh or in gallons of diesel at full efficiency."""
    v = speed_mph * F.lit(MPS_PER_MPH)
    kwh = F.lit(0.5) * mass_kg * v * v / F.lit(JOULES_PER_KWH)
    return F.when(kind == "bev", kwh).otherwise(kwh / F.lit(KWH_PER_GGE * GGE_PER_GAL_DIESEL))


def mpge(miles: Column, energy: Column, gge_per_unit: Column) -> Column:
    gge = energy * gge_per_unit
    return F.when(gge > 0, miles / F.when(gge > 0, gge))


def rate_by_unit(distance_miles: Column, unit: Column, rate: Column) -> Column:
    """Least energy of a distance, from a rate given per mile or kilometre, in kWh or gallons of diesel."""
    per_unit = F.when(unit == "kWh/mi", distance_miles).when(unit == "kWh/km", distance_miles / F.lit(MI_PER_KM))
    per_unit = per_unit.when(unit == "gge/mi", distance_miles / F.lit(GGE_PER_GAL_DIESEL)).when(unit == "gal diesel/mi", distance_miles)
    return rate * per_unit


def state_of_charge(start: Column, used_kwh: Column, battery_kwh: Column) -> Column:
    return start - F.lit(100.0) * used_kwh / battery_kwh


def turn_delay(before: Column, after: Column) -> Column:
    """Seconds lost between two headings in degrees; the first edge has no turn."""
    signed = F.pmod(after - before + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
    change = F.abs(signed)
    out = F.lit(TURNS[-1][2])
    for _, bound, right, left in reversed(TURNS[:-1]):
        out = F.when(change <= bound, F.when(signed >= 0, F.lit(right)).otherwise(F.lit(left))).otherwise(out)
    return F.coalesce(F.when(change.isNotNull(), out), F.lit(0.0))


def route_cost(miles: Column, minutes: Column, gge: Column, kwh: Column) -> Column:
    r = COST_RATES
    return F.lit(r["miles"]) * miles + F.lit(r["minutes"]) * minutes + F.lit(r["gge"]) * F.coalesce(gge, F.lit(0.0)) + F.lit(r["kwh"]) * F.coalesce(kwh, F.lit(0.0))
