"""Lookups in many layers at once: keys first, wide rows of the winners afterwards.

All layers' keys (id, lat, lon) meet the places in one join on tiles, each tagged with its layer; one aggregate finds the
nearest of every layer. The layers' arrays are fetched and decoded for the rows that won, and for no others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.operators import spatial as S


def whole_km(lat: Column, lon: Column, clat: Column, clon: Column) -> Column:
    """Whole kilometres: rounded before they are held against a radius."""
    return F.floor(geo.haversine_km(lat, lon, clat, clon) + 0.5).cast("double")


def block_degrees(lat: Column, lon: Column, clat: Column, clon: Column) -> Column:
    """Squared degrees from the centre of a place's one-degree block."""
    la, lo = geo.joint_block(lat, lon)
    return (clat - la) ** 2 + (clon - lo) ** 2


@dataclass(frozen=True)
class Layer:
    """A layer of cells (id, lat, lon): how distances are measured, up to where they count, and a radius (km) that holds all such cells."""

    name: str
    keys: DataFrame
    reach_km: float
    measure: Callable = S.km_between
    within: Callable = field(default=None)

    def fits(self, d: Column) -> Column:
        return self.within(d) if self.within else d <= self.reach_km


def nearest_of_layers(places: DataFrame, layers: list[Layer], place_id: str, size: float = 5.0) -> DataFrame:
    """(place_id, one column <layer>_id and one <layer>_d a layer): the nearest of each layer, ties to the smaller id, null where none is in reach."""
    reach = max(layer.reach_km for layer in layers)
    near = S.candidate_tiles(places.select("lat", "lon").distinct(), reach, size)
    tagged = reduce(DataFrame.unionByName, [layer.keys.select(F.lit(k).alias("_layer"), F.col("id").cast("long").alias("_id"), "lat", "lon") for k, layer in enumerate(layers)])
    held = S.in_tiles(S.sites(tagged, "_id", "_layer"), size).withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    at = (F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    met = near.join(held, ["ti", "tj"])
    d = reduce(lambda a, kl: F.when(F.col("_layer") == kl[0], kl[1].measure(*at)).otherwise(a), enumerate(layers), F.lit(None).cast("double"))
    met = met.withColumn("_d", d)
    best = [F.min(F.when((F.col("_layer") == k) & layer.fits(F.col("_d")), F.struct("_d", "_id"))).alias(layer.name) for k, layer in enumerate(layers)]
    found = met.groupBy("lat", "lon").agg(*best)
    named = [c for layer in layers for c in (F.col(layer.name)["_id"].alias(f"{layer.name}_id"), F.col(layer.name)["_d"].alias(f"{layer.name}_d"))]
    return places.select(place_id, "lat", "lon").join(found, ["lat", "lon"], "left").select(place_id, *named)


def fetched(found: DataFrame, layer: str, wide: DataFrame) -> DataFrame:
    """found with the columns of the wide rows (id, ..) that won: decode after this join, so that only they are decoded."""
    return found.join(wide.withColumnRenamed("id", f"{layer}_id"), f"{layer}_id", "left")
