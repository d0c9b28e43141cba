"""Polylines: delta decoding, antimeridian pieces, boxes, edges that rings share, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import geo


def decode(deltas: DataFrame, by: str = "track_id", scale: float = 100.0, block_days: int = 3650) -> DataFrame:
    """deltas with lat and lon: running sums of (dlat, dlon) over scale, in the order of ts and seq.

    A line is cut into blocks of time; a block sums up its own steps, and begins at the sum of the blocks before it.
    """
    block = F.floor(F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")) / block_days).cast("int")
    cut = deltas.withColumn("_block", block)
    so_far = Window.partitionBy(by, "_block").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(by, "_block").agg(F.sum("dlat").alias("_a"), F.sum("dlon").alias("_o"))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(by, "_block", F.coalesce(F.sum("_a").over(before), F.lit(0.0)).alias("_a"), F.coalesce(F.sum("_o").over(before), F.lit(0.0)).alias("_o"))
    own = cut.withColumns({"lat": F.sum("dlat").over(so_far), "lon": F.sum("dlon").over(so_far)}).join(starts, [by, "_block"])
    return own.withColumns({"lat": (F.col("_a") + F.col("lat")) / scale, "lon": (F.col("_o") + F.col("lon")) / scale}).drop("_block", "_a", "_o")


def pieces(points: DataFrame, by: str = "track_id") -> DataFrame:
    """points with wrapped lon and the number of their piece: a step of over 180 degrees begins a new one. Pieces of one point go."""
    w = Window.partitionBy(by).orderBy("ts", "seq")
    wrapped = points.withColumn("lon", geo.wrap_lon(F.col("lon")))
    jump = F.when(F.abs(F.col("lon") - F.lag("lon").over(w)) > 180, 1).otherwise(0)
    cut = wrapped.withColumn("jump", jump).withColumn("piece", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("jump")
    return cut.withColumn("size", F.count("*").over(Window.partitionBy(by, "piece"))).filter("size >= 2").drop("size")


def boxes(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.count("*").alias("points"))


def edge_counts(points: DataFrame, by: str = "track_id", longest: float = 4.0) -> DataFrame:
    """(a, b, n, cut): how often each undirected edge is drawn. Cut are edges drawn twice, those that run along or across
    the date line or along a pole, and those longer than `longest` degrees."""
    w = Window.partitionBy(by).orderBy("ts", "seq")
    name = F.concat_ws(",", F.floor(F.col("lat") * 100 + 0.5).cast("string"), F.floor(F.col("lon") * 100 + 0.5).cast("string"))
    steps = points.withColumn("here", name).withColumns({"there": F.lag("here").over(w), "lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w)}).filter("there IS NOT NULL")
    dlat, dlon = F.col("lat") - F.col("lat0"), F.col("lon") - F.col("lon0")
    both = lambda a, b, edge: (F.abs(a) >= edge) & (F.abs(b) >= edge)
    odd = (F.abs(dlon) > 180) | both("lon", "lon0", 179.99) | both("lat", "lat0", 89.9) | (dlat * dlat + dlon * dlon > longest * longest)
    counted = steps.groupBy(F.least("here", "there").alias("a"), F.greatest("here", "there").alias("b")).agg(F.count("*").alias("n"), F.bool_or(odd).alias("odd"))
    return counted.select("a", "b", "n", ((F.col("n") > 1) | F.col("odd")).alias("cut"))


def levels_in_view(points: DataFrame, south: float, north: float, west: float, east: float, level: str = "level") -> DataFrame:
    """(level): those of which some line has a vertex in the box."""
    return points.filter(F.col("lat").between(south, north) & geo.wrap_lon(F.col("lon")).between(west, east)).select(level).distinct()


def usable(points: DataFrame, by: str) -> DataFrame:
    """points of lines of two points or more."""
    return points.withColumn("size", F.count("*").over(Window.partitionBy(by))).filter("size >= 2").drop("size")


def nearest_approach(points: DataFrame, lat: float, lon: float, by: str = "track_id") -> DataFrame:
    """(by, nm): least flat-earth distance of a line's points from a place."""
    return points.groupBy(by).agg(F.min(geo.flat_nm(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).alias("nm"))
