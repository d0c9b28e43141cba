"""Column expressions for places. Latitudes and longitudes in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagos.functions.constants import EARTH_KM, KM_PER_NM


def wrap_lon(lon: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def merc_y(lat: Column) -> Column:
    """Web-mercator ordinate in degrees; latitudes beyond 85.05113 stay there."""
    clamped = F.greatest(F.lit(-85.05113), F.least(F.lit(85.05113), lat))
    return F.degrees(F.log(F.tan(F.pi() / 4 + F.radians(clamped) / 2)))


def merc_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(F.radians(y))) - F.pi() / 2)


def flat_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a flat earth, nautical miles."""
    dx = wrap_lon(lon2 - lon1) * F.cos(F.radians(lat1))
    return 60 * F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(dx, 2))


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment."""
    length2 = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length2))).otherwise(0.0)
    return F.pow(px - ax - t * (bx - ax), 2) + F.pow(py - ay - t * (by - ay), 2)


def nautical(km: Column) -> Column:
    return km / KM_PER_NM


def tile_origin(x: Column, size: float, shift: float) -> Column:
    """South or west edge of the tile that holds x; tiles begin at -shift."""
    return F.floor((x + shift) / size) * size - shift


def tile_id(prefix: str, lat: Column, lon: Column, size: int) -> Column:
    """Waves, currents and cyclones: tiles are counted from the south pole and from 180 W."""
    return F.concat_ws("_", F.lit(prefix), tile_origin(lat, size, 90).cast("int").cast("string"), tile_origin(wrap_lon(lon), size, 180).cast("int").cast("string"))


def joint_block(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Centre of the one-degree block of joint counts."""
    rounded = lambda x: F.floor(x + 0.5).cast("double")
    block_lon = rounded(wrap_lon(lon) + 179.75) - 179.75
    return rounded(lat + 89.25) - 89.25, F.when(block_lon < -179.75, 179.25).otherwise(block_lon)
