"""Physical and numeric column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed constants: gravity, gas constant of dry air, Earth's radius (km), the two Magnus pairs in use.
GRAVITY, GAS, EARTH_KM = 9.80665, 287.058, 6371.0
MAGNUS_NETWORK, MAGNUS_QC = (17.67, 243.5), (17.625, 243.04)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds; null stays null (greatest and least alone would take the bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32.0) * 5.0 / 9.0


def station_pressure(slp: Column, elevation: Column, temp: Column) -> Column:
    kelvin = F.coalesce(temp, F.lit(15.0)) + 273.15
    return slp * F.exp(-GRAVITY * elevation / (GAS * kelvin))


def saturation_pressure(t: Column, magnus: tuple = MAGNUS_NETWORK) -> Column:
    return 6.112 * F.exp(magnus[0] * t / (t + magnus[1]))


def rh_from_dewpoint(t: Column, dew: Column, floor: float = 0.0) -> Column:
    """floor 0 for single readings, 0.5 for gridded series."""
    return clamp(100.0 * saturation_pressure(dew) / saturation_pressure(t), floor, 100.0)


def dewpoint(t: Column, rh: Column, magnus: tuple = MAGNUS_QC) -> Column:
    a, b = magnus
    g = F.ln(clamp(rh, 0.1, 100.0) / 100.0) + a * t / (b + t)
    return b * g / (a - g)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, clamped: bool = True) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2.0 * EARTH_KM * F.asin(F.sqrt(clamp(a) if clamped else a))


def lapse_corrected(temp: Column, z_from: Column, z_to: Column, lapse: float) -> Column:
    return temp + lapse * (z_from - z_to)


def pressure_at(pressure: Column, z_from: Column, z_to: Column, temp: Column) -> Column:
    kelvin = temp + 273.15
    kelvin = F.when(temp.isNull() | F.isnan(temp) | (F.abs(temp) == float("inf")) | (kelvin < 200.0), 288.15).otherwise(kelvin)
    return pressure * F.exp(-GRAVITY * (z_to - z_from) / (GAS * kelvin))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0


def cyclic_time(ts: Column) -> list[Column]:
    h, d = hour_of_day(ts) * (2 * math.pi / 24.0), F.dayofyear(ts) * (2 * math.pi / 365.0)
    return [F.sin(h), F.cos(h), F.sin(d), F.cos(d)]


def duration_minutes(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end) / 60.0


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
