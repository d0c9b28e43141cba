"""Tiles: columnar, scaled integers on the wire; one row for a cell, month and key after decoding.

A tile's arrays are month-major. Values below 0 are missing. Lengths are checked: a wrong one is an error of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a wave tile with their scale, and how many values a cell has: a number, and a number for each threshold.
#: Fields whose size a manifest's own lists tell (None) are not held against a length.
FIELDS = {
    "mean": (10.0, 12, 0), "n": (1.0, 12, 0), "tp": (10.0, 12, 0), "exc": (10.0, 0, 12), "wd": (1.0, 12, 0), "wp": (1.0, 12, 0), "wr": (1.0, 144, 0), "hx": (10.0, 24, 0), "hxa": (10.0, 2, 0), "wm": (10.0, 12, 0),
    "w9": (10.0, 12, 0), "wq": (10.0, None, 0), "vr": (1.0, 144, 0), "pw": (10.0, None, 0), "th": (10.0, None, 0), "pn": (1.0, 36, 0), "pm": (10.0, 36, 0), "pe": (10.0, 0, 36), "dh": (10.0, 96, 0), "dw": (10.0, 96, 0),
}
TILE = "lat ARRAY<DOUBLE>, lon ARRAY<DOUBLE>, " + ", ".join(f"{k} ARRAY<ARRAY<INT>>" for k in FIELDS)


def read_tiles(spark: SparkSession, paths: str) -> DataFrame:
    """Tiles as JSON files, one object a file; absent fields are null."""
    return spark.read.schema(TILE).option("multiLine", True).json(paths)


def unscaled(x: Column, scale: float) -> Column:
    return F.when(x >= 0, x / scale)


def cells_of(tiles: DataFrame) -> DataFrame:
    """One row a cell: lat, lon, and that cell's arrays."""
    present = [k for k in FIELDS if k in tiles.columns]
    cell = F.posexplode("lat").alias("cell", "cell_lat")
    rows = tiles.select(cell, "lon", *present)
    return rows.select("cell", F.col("cell_lat").alias("lat"), F.get("lon", F.col("cell")).alias("lon"), *(F.get(k, F.col("cell")).alias(k) for k in present))


def checked(cells: DataFrame, thresholds: int) -> DataFrame:
    """Raises where an array has the wrong length."""
    right = [F.col(k).isNull() | (F.size(k) == size + each * thresholds) for k, (_, size, each) in FIELDS.items() if k in cells.columns and size is not None]
    bad = F.lit(False)
    for ok in right:
        bad = bad | ~ok
    return cells.filter(F.when(bad, F.raise_error(F.lit("The data was just updated: a tile's length does not fit its manifest."))).otherwise(F.lit(True)))


def monthly(cells: DataFrame, field: str, by: tuple = ("cell",), width: int = 1) -> DataFrame:
    """(by, m, k, value): a field in long form; k counts the values of a month."""
    scale = FIELDS[field][0]
    long = cells.select(*by, F.posexplode(field).alias("i", "raw"))
    return long.select(*by, F.floor(F.col("i") / width).cast("int").alias("m"), (F.col("i") % width).alias("k"), unscaled(F.col("raw"), scale).alias("value"))


def valid(cells: DataFrame, thresholds: int) -> DataFrame:
    """Cells of which some month has samples and a first exceedance."""
    return cells.filter(F.exists(F.sequence(F.lit(0), F.lit(11)), lambda m: (F.get("n", m) > 0) & (F.get("exc", m * thresholds) >= 0)))
