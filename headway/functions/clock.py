"""Service-day clock arithmetic.  Times are seconds since service midnight: over 24 h and below zero are both valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms(seconds: Column) -> Column:
    """``HH:MM:SS`` with unbounded hours, truncated seconds and a leading minus before midnight; null gives ''."""
    s = F.abs(seconds).cast("long")
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    sign = F.when((seconds < 0) & (s > 0), F.lit("-")).otherwise(F.lit(""))
    return F.when(seconds.isNull(), F.lit("")).otherwise(F.concat(sign, text))


def parse_hms(text: Column) -> Column:
    """Seconds of ``H:MM:SS``; blanks around it are allowed, anything else is null."""
    t = F.trim(text)
    ok = t.rlike(r"^-?\d+:\d{1,2}:\d{1,2}$")
    p = F.split(F.regexp_replace(t, "^-", ""), ":")
    value = F.get(p, F.lit(0)).cast("long") * 3600 + F.get(p, F.lit(1)).cast("long") * 60 + F.get(p, F.lit(2)).cast("long")
    return F.when(ok, F.when(t.startswith("-"), -value).otherwise(value))


def nearest_five_minutes(seconds: Column) -> Column:
    """Half-even rounding to 300 s."""
    return (F.bround(seconds / F.lit(300.0)) * 300).cast("long")


def hour_of_day(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int")


def minute_of_hour(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int")


def travel_seconds(metres: Column, kmh: float = 30.0) -> Column:
    return metres / F.lit(kmh * 1000) * 3600
