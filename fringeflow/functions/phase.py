"""Phase, line-of-sight and geometry expressions.  Angles in degrees, phases in radians, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi

# Sphere radius, WGS84 axes, and the phase noise of a uniform phase.
EARTH_RADIUS_M = 6371008.8
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
MAX_PHASE_STD = math.pi / math.sqrt(3)


def wrap(x: Column) -> Column:
    """Phase in (-pi, pi]."""
    return F.atan2(F.sin(x), F.cos(x))


def wrap_degrees(a: Column) -> Column:
    """Angle less whole turns, halves rounded to even."""
    return a - F.rint(a / 360.0) * 360.0


def wrap_heading(h: Column) -> Column:
    """Angle in [-180, 180): 180 becomes -180."""
    return F.pmod(h + 180.0, F.lit(360.0)) - 180.0


def cycles(x: Column) -> Column:
    """Whole turns nearest to a phase, halves to even."""
    return F.rint(x / TWO_PI).cast("long")


def look_azimuth(heading: Column, right_looking: bool = True) -> Column:
    """Azimuth from the ground to the sensor."""
    return wrap_degrees(-(heading - 90.0 if right_looking else heading + 90.0))


def los_vector(incidence: Column, azimuth: Column) -> Column:
    """Unit vector to the sensor: struct (east, north, up)."""
    i, a = F.radians(incidence), F.radians(azimuth)
    return F.struct((-F.sin(i) * F.sin(a)).alias("east"), (F.sin(i) * F.cos(a)).alias("north"), F.cos(i).alias("up"))


def project_los(east: Column, north: Column, up: Column, incidence: Column, azimuth: Column) -> Column:
    v = los_vector(incidence, azimuth)
    return east * v["east"] + north * v["north"] + up * v["up"]


def los_to_vertical(los: Column, incidence: Column) -> Column:
    return los / F.cos(F.radians(incidence))


def default_heading(direction: Column) -> Column:
    """Nominal heading of a flight direction; null where unknown."""
    return F.when(direction == "ASCENDING", -12.0).when(direction == "DESCENDING", 192.0)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def planar_distance2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in degrees of latitude, longitudes shortened by the first latitude."""
    return F.pow(lat2 - lat1, 2) + F.pow(F.cos(F.radians(lat1)) * (lon2 - lon1), 2)


def geodetic_to_ecef(lat: Column, lon: Column, height: Column) -> Column:
    e2 = WGS84_F * (2 - WGS84_F)
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(F.radians(lat)), 2))
    flat = (n + height) * F.cos(F.radians(lat))
    return F.struct(
        (flat * F.cos(F.radians(lon))).alias("x"), (flat * F.sin(F.radians(lon))).alias("y"), ((n * (1 - e2) + height) * F.sin(F.radians(lat))).alias("z")
    )


def ground_range(slant: Column, incidence: Column) -> Column:
    return slant / F.sin(F.radians(incidence))


def coherence_phase_std(coherence: Column, looks: float) -> Column:
    g2 = F.pow(coherence, 2)
    bound = F.sqrt((1 - g2) / (2.0 * looks * g2))
    return F.when(coherence <= 0, F.lit(MAX_PHASE_STD)).otherwise(F.least(bound, F.lit(MAX_PHASE_STD)))


def height_to_phase(height: Column, bperp: Column, wavelength: float, slant_range: float, incidence: Column) -> Column:
    return -4 * math.pi / wavelength * bperp * height / (slant_range * F.sin(F.radians(incidence)))


def hermite(t: Column, t0: Column, t1: Column, p0: Column, p1: Column, v0: Column, v1: Column) -> Column:
    """Cubic through two positions with given velocities."""
    h = t1 - t0
    s = (t - t0) / h
    s2, s3 = s * s, s * s * s
    return (2 * s3 - 3 * s2 + 1) * p0 + (s3 - 2 * s2 + s) * h * v0 + (3 * s2 - 2 * s3) * p1 + (s3 - s2) * h * v1


def local_geometry(slope: Column, aspect: Column, azimuth: Column, incidence: Column) -> Column:
    """Struct (incidence_local, range_slope, layover, shadow, foreshortening) of a terrain facet.

    ``azimuth``: from the ground to the sensor, as the aspect clockwise from
    north.  Null slopes or aspects make everything null, masks false.
    """
    s, d, i = F.radians(slope), F.radians(aspect - azimuth), F.radians(incidence)
    cosine = F.cos(s) * F.cos(i) + F.sin(s) * F.sin(i) * F.cos(d)
    local = F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    towards = F.degrees(F.atan(F.tan(s) * F.cos(d)))
    valid = local.isNotNull() & towards.isNotNull()
    layover = valid & (towards > incidence)
    shadow = valid & (towards < incidence - 90.0)
    short = 1 - F.sin(F.radians(F.least(F.greatest(local, F.lit(0.0)), F.lit(90.0)))) / F.sin(i)
    short = F.when(layover, F.lit(1.0)).otherwise(F.least(F.greatest(short, F.lit(0.0)), F.lit(1.0)))
    return F.struct(
        local.alias("incidence_local"), towards.alias("range_slope"), F.coalesce(layover, F.lit(False)).alias("layover"),
        F.coalesce(shadow, F.lit(False)).alias("shadow"), F.when(valid, short).alias("foreshortening"),
    )
