"""Rasters in long form (r, c, value): monthly fields, gap filling, contours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions.numeric import month_days, weighted


def field(cells: DataFrame, months: list[int], value: str = "v") -> DataFrame:
    """(r, c, value): mean over the months, weighted by days; missing months are left out."""
    return cells.filter(F.col("m").isin(months)).groupBy("r", "c").agg(weighted(F.col(value), month_days(F.col("m"))).alias(value))


def fill_once(raster: DataFrame, columns: int, value: str = "v") -> DataFrame:
    """Cells without a value take the mean of their neighbours that have one; columns wrap, rows don't.

    Each cell sends its value to its eight neighbours: an aggregate instead of a self join.
    """
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    sent = raster.filter(F.col(value).isNotNull()).select(F.explode(offsets).alias("o"), "r", "c", value).select((F.col("r") + F.col("o.dr")).alias("r"), F.pmod(F.col("c") + F.col("o.dc"), F.lit(columns)).alias("c"), F.lit(None).cast("double").alias("own"), F.col(value).alias("near"), F.lit(0).alias("here"))
    own = raster.select("r", "c", F.col(value).alias("own"), F.lit(None).cast("double").alias("near"), F.lit(1).alias("here"))
    merged = own.unionByName(sent).groupBy("r", "c").agg(F.max("own").alias("own"), F.avg("near").alias("near"), F.max("here").alias("here"))
    return merged.filter("here = 1").select("r", "c", F.coalesce("own", "near").alias(value))


def fill(raster: DataFrame, columns: int, passes: int = 3, value: str = "v") -> DataFrame:
    return reduce(lambda df, _: fill_once(df, columns, value), range(passes), raster)


def corners(raster: DataFrame, value: str = "elev") -> DataFrame:
    """(r, c, sw, se, ne, nw): squares whose four corners have values. Each cell goes to the four squares that it is a corner of."""
    spread = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(k).alias("k")) for k, (dr, dc) in {"sw": (0, 0), "se": (0, 1), "nw": (1, 0), "ne": (1, 1)}.items()))
    sent = raster.filter(F.col(value).isNotNull()).select("r", "c", value, F.explode(spread).alias("o")).select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), F.col("o.k").alias("k"), value)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col(value))).alias(k)
    return sent.groupBy("r", "c").agg(at("sw"), at("se"), at("ne"), at("nw")).dropna()


def contour_segments(raster: DataFrame, levels: list[float], lat0: float, lon0: float, res: float, value: str = "elev") -> DataFrame:
    """(level, r, c, part, lat1, lon1, lat2, lon2): marching squares at depth levels.

    A corner is in if it lies deeper than the level. Squares crossed on all four sides give two segments: left to
    bottom, and right to top.
    """
    squares = corners(raster, value).withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in levels))))
    target = -F.col("level")
    deep = {k: F.col(k) < target for k in ("sw", "se", "ne", "nw")}
    south, west = lat0 + (F.col("r") + 0.5) * res, lon0 + (F.col("c") + 0.5) * res
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    line = lambda a, b, lo: lo + (target - F.col(a)) / (F.col(b) - F.col(a)) * res
    sides = {
        "bottom": ("sw", "se", point(south, line("sw", "se", west))),
        "top": ("nw", "ne", point(south + res, line("nw", "ne", west))),
        "left": ("sw", "nw", point(line("sw", "nw", south), west)),
        "right": ("se", "ne", point(line("se", "ne", south), west + res)),
    }
    crossed = {k: F.when(deep[a] != deep[b], p) for k, (a, b, p) in sides.items()}
    rows = squares.select("level", "r", "c", *(v.alias(k) for k, v in crossed.items()))
    both = F.array(F.struct(F.col("left").alias("a"), F.col("bottom").alias("b")), F.struct(F.col("right").alias("a"), F.col("top").alias("b")))
    ends = F.filter(F.array("bottom", "top", "left", "right"), lambda p: p.isNotNull())
    one = F.array(F.struct(F.get(ends, F.lit(0)).alias("a"), F.get(ends, F.lit(1)).alias("b")))
    found = rows.withColumn("found", F.when(F.size(ends) == 4, both).when(F.size(ends) == 2, one))
    return found.select("level", "r", "c", F.posexplode("found").alias("part", "s")).select("level", "r", "c", "part", F.col("s.a.lat").alias("lat1"), F.col("s.a.lon").alias("lon1"), F.col("s.b.lat").alias("lat2"), F.col("s.b.lon").alias("lon2"))


def cell_of(lat: Column, lon: Column, lat0: float, lon0: float, res: float, rows: int, columns: int) -> tuple[Column, Column]:
    """Row and column of a raster at a place, kept inside."""
    clamp = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x).cast("int")))
    return clamp((lat - lat0) / res, rows), clamp((lon - lon0) / res, columns)
