"""Daily insolation from orbital elements, as Column expressions (Berger's closed forms)."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from seasonspark.functions.waveforms import Value, col, floored_mod

#: Solar constant (W/m2), days of the tropical year, day of the March equinox. Fixed values.
SOLAR, TROPICAL_YEAR, EQUINOX = 1365.0, 365.2422, 80


class Insolation(NamedTuple):
    fsw: Column
    longitude: Column


def solar_longitude(day: Value, ecc: Value, perihelion: Value) -> Column:
    """True longitude (radians) on a calendar day: mean longitude since the equinox plus the equation of centre."""
    e, w = col(ecc), col(perihelion)
    e2, e3, root = e * e, e * e * e, F.sqrt(1 - e * e)
    terms = ((e / 2 + e3 / 8) * (1 + root), e2 / 4 * (0.5 + root), e3 / 8 * (F.lit(1.0) / 3 + root))
    signs = (1, -1, 1)
    start = -2 * sum((s * a * F.sin(-n * w) for n, (s, a) in enumerate(zip(signs, terms, strict=True), 1)), F.lit(0.0))
    mean = start + (col(day) - EQUINOX) * (2 * math.pi / TROPICAL_YEAR)
    anomaly = mean - w
    return mean + (2 * e - e3 / 4) * F.sin(anomaly) + 1.25 * e2 * F.sin(2 * anomaly) + F.lit(13.0) / 12 * e3 * F.sin(3 * anomaly)


def daily_insolation(lat: Value, day: Value, ecc: Value, obliquity: Value, perihelion: Value, day_type: int = 1) -> Insolation:
    """Mean flux (W/m2) of a day and the sun's longitude (degrees).

    Angles in radians but ``lat``. ``day_type`` 1: calendar days, 2: degrees of solar longitude. Polar day
    and night are told before the hour angle is taken, so no value is NaN.
    """
    if day_type not in (1, 2):
        raise ValueError("day_type is 1 (calendar day) or 2 (solar longitude)")
    e, w, phi = col(ecc), col(perihelion), F.radians(col(lat))
    sun = solar_longitude(day, e, w) if day_type == 1 else col(day) * (2 * math.pi / 360)
    delta = F.asin(F.sin(col(obliquity)) * F.sin(sun))
    polar = F.abs(phi) >= math.pi / 2 - F.abs(delta)
    hour = F.when(polar & (phi * delta > 0), F.lit(math.pi)).when(polar, F.lit(0.0)).otherwise(F.acos(-F.tan(phi) * F.tan(delta)))
    distance = F.pow(1 + e * F.cos(sun - w), F.lit(2.0)) / F.pow(1 - e * e, F.lit(2.0))
    flux = SOLAR / math.pi * distance * (hour * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(hour))
    return Insolation(flux, floored_mod(F.degrees(sun), 360.0))
