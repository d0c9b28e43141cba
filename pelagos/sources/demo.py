"""A closed-form sea state for places without data, as column expressions; used for fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions.constants import MONTH_DAYS, THRESHOLDS
from pelagos.functions.numeric import gamma, half_up, month_days, smoothstep


def mean_height(lat: Column, lon: Column, m: Column) -> Column:
    """Mean wave height of open water: zones by latitude, a yearly cycle, the monsoons, calm near the equator.

    Enclosed basins are not told apart: their factors belong to a table of outlines.
    """
    a = F.abs(lat)
    south = 1.6 + 1.5 * smoothstep(18, 42, a) + 1.3 * smoothstep(42, 58, a)
    north = 1.6 + 0.9 * smoothstep(18, 42, a) + 0.5 * smoothstep(42, 60, a)
    base = F.when(lat <= 0, south).otherwise(north) * (1 - 0.45 * smoothstep(66, 78, a))
    phase = F.cos(2 * F.pi() * (m - 0.25) / 12)
    mean = base + smoothstep(12, 32, lat) * 0.38 * base * phase - smoothstep(12, 32, -lat) * 0.2 * base * phase
    monsoon = F.exp(-F.pow((m - 6) / 1.6, 2))
    inside = lambda s, n, w, e: (lat > s) & (lat < n) & (lon > w) & (lon < e)
    mean = mean + F.when(inside(4, 23, 52, 75), 1.3 * monsoon).otherwise(0.0) + F.when(inside(4, 21, 79, 95), 0.8 * monsoon).otherwise(0.0) + F.when(inside(4, 23, 104, 121), 0.55 * F.greatest(F.lit(0.0), phase)).otherwise(0.0)
    return F.greatest(F.lit(0.35), F.least(F.lit(7.0), mean * (0.88 + 0.12 * smoothstep(2, 9, a))))


def shape(lat: Column) -> Column:
    """Weibull shape of the distribution of heights."""
    return F.greatest(F.lit(1.55), F.least(F.lit(2.35), 2.25 - 0.55 * smoothstep(22, 45, F.abs(lat))))


def climatology(places: DataFrame, by: str = "pt_id") -> DataFrame:
    """(by, m, n, mean, t, exc): a made-up climatology of each place (lat, lon) and month."""
    months = places.select(by, "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("m"))
    rows = months.withColumns({"mean": mean_height(F.col("lat"), F.col("lon"), F.col("m")), "k": shape(F.col("lat")), "n": half_up(46 * 8 * month_days(F.col("m"))).cast("long")})
    scale = F.col("mean") / gamma(1 + 1 / F.col("k"))
    heights = F.explode(F.array(*(F.lit(t) for t in THRESHOLDS))).alias("t")
    return rows.withColumn("scale", scale).select(by, "m", "n", "mean", "k", "scale", heights).select(by, "m", "n", "mean", "t", (100 * F.exp(-F.pow(F.col("t") / F.col("scale"), F.col("k")))).alias("exc"))


def whole_days() -> float:
    return float(sum(MONTH_DAYS))
