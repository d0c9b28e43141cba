"""JSON sources: the catalogue of tiles, assets, storm tracks, and the tile of extremes.

Each takes a table with one JSON text a row, so the same code serves files (`spark.read.text(path, wholetext=True)`) and tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.sources.tiles import unscaled

#: The schemas on the wire and the version that is read.
FORMAT = 1
MANIFEST = (
    "format INT, source STRING, source_label STRING, period STRING, attribution STRING, data_id STRING, tile_deg DOUBLE, max_snap_km DOUBLE, grid STRUCT<res: DOUBLE>, tiles ARRAY<STRING>, thresholds ARRAY<DOUBLE>, enso BOOLEAN,"
    " rv STRUCT<fields: ARRAY<STRING>, years_n: ARRAY<INT>, years_s: ARRAY<INT>, seasons: ARRAY<STRING>, srv_fields: ARRAY<STRING>, min_years: INT, span: STRING>,"
    " wind_q ARRAY<DOUBLE>, persist STRUCT<thresholds: ARRAY<DOUBLE>, edges_h: ARRAY<INT>>, tp_hist STRUCT<t0: DOUBLE, step: DOUBLE, nb: INT>, radii_nm ARRAY<DOUBLE>"
)
ASSETS = "format INT, assets ARRAY<STRUCT<n: STRING, t: STRING, la: DOUBLE, lo: DOUBLE, d: DOUBLE, s: STRING, o: STRING, c: STRING, y: STRING>>, lines ARRAY<STRUCT<n: STRING, s: STRING, c: STRING, o: STRING, src: STRING, e: ARRAY<INT>>>"
TRACKS = "tracks ARRAY<STRUCT<n: STRING, y: INT, w: DOUBLE, e: ARRAY<INT>>>"
#: Return levels that a season may not have higher than the whole year.
LEVELS = ("hs10", "hs50", "hs100")


def _parsed(texts: DataFrame, text: str, schema: str, *keep: str) -> DataFrame:
    return texts.select(*keep, F.from_json(text, schema).alias("x")).select(*keep, "x.*")


def _gated(rows: DataFrame) -> DataFrame:
    """Raises where the version is another."""
    other = F.raise_error(F.concat(F.lit("This data has another format: "), F.coalesce(F.col("format").cast("string"), F.lit("none"))))
    return rows.filter(F.when(F.col("format").eqNullSafe(F.lit(FORMAT)), F.lit(True)).otherwise(other.cast("boolean")))


def manifest(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row a catalogue, of this version; labels read "and" where they have a plus sign."""
    return _gated(_parsed(texts, text, MANIFEST, *keep)).withColumn("source_label", F.replace("source_label", F.lit(" + "), F.lit(" and ")))


def asset_points(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row an asset (n, t, lat, lon, d, s, o, c, y)."""
    rows = _gated(_parsed(texts, text, ASSETS, *keep)).select(*keep, F.explode("assets").alias("a"))
    return rows.select(*keep, "a.n", "a.t", F.col("a.la").alias("lat"), F.col("a.lo").alias("lon"), "a.d", "a.s", "a.o", "a.c", "a.y")


def running(deltas: Column, scale: float) -> Column:
    """array of (lat, lon) of an array of alternating differences."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(deltas) / 2).cast("int") - 1), lambda k: F.struct(F.get(deltas, 2 * k).cast("long").alias("a"), F.get(deltas, 2 * k + 1).cast("long").alias("o")))
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("o"), F.array().cast("array<struct<lat:double,lon:double>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a, o = acc["a"] + p["a"], acc["o"] + p["o"]
        return F.struct(a.alias("a"), o.alias("o"), F.concat(acc["out"], F.array(F.struct((a / scale).alias("lat"), (o / scale).alias("lon")))).alias("out"))

    return F.when(F.size(deltas) >= 2, F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def _points(rows: DataFrame, scale: float, *keep: str) -> DataFrame:
    return rows.withColumn("pts", running(F.col("e"), scale)).filter(F.size("pts") >= 2).select(*keep, F.posexplode("pts").alias("seq", "p")).select(*keep, "seq", "p.lat", "p.lon")


def asset_lines(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row a vertex of lines of assets (n, seq, lat, lon); lines of fewer than two points go."""
    rows = _gated(_parsed(texts, text, ASSETS, *keep)).select(*keep, F.posexplode("lines").alias("line", "l"))
    return _points(rows.select(*keep, "line", "l.n", "l.e"), 1e4, *keep, "line", "n")


def storm_tracks(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row a vertex of storm tracks (track, n, y, w, seq, lat, lon); tracks of fewer than two points go."""
    rows = _parsed(texts, text, TRACKS, *keep).select(*keep, F.posexplode("tracks").alias("track", "t")).select(*keep, "track", "t.*")
    return _points(rows, 1e2, *keep, "track", "n", "y", "w")


def at_exact_cell(cells: DataFrame, extremes: DataFrame, by: str | None = None) -> DataFrame:
    """cells with the row of `extremes` at the same place, to a millionth of a degree; null columns without one.

    Where cells of several records share a place, `by` names the column that tells them apart, in both tables; a place has one row of each.
    """
    place = ["_a", "_o"] + ([by] if by else [])
    key = lambda df: df.withColumns({"_a": F.round(F.col("lat") * 1e6).cast("long"), "_o": F.round(F.col("lon") * 1e6).cast("long")})
    return key(cells).join(key(extremes).drop("lat", "lon").dropDuplicates(place), place, "left").drop("_a", "_o")


def levels(cells: DataFrame, fields: Column, raw: str, by: str) -> DataFrame:
    """(by, field, value): return levels by name; n is a count, the others are tenths, negative ones missing."""
    rows = cells.filter(F.col(raw).isNotNull()).select(by, F.explode(F.arrays_zip(fields.alias("field"), F.col(raw).alias("raw"))).alias("z"))
    return rows.select(by, "z.field", F.when(F.col("z.field") == "n", F.col("z.raw").cast("double")).otherwise(unscaled(F.col("z.raw"), 10.0)).alias("value"))


def season_maxima(cells: DataFrame, north: Column, south: Column, by: str) -> DataFrame:
    """(by, label, hs, day, month, year) of arrays ram (tenths of a metre) and ramd (month times 100 plus day).

    The years are those of the hemisphere; in the north a date before July belongs to the year after the label.
    """
    in_north = F.col("lat") >= -1e-6
    rows = cells.withColumn("years", F.when(in_north, north).otherwise(south)).select(by, in_north.alias("north"), F.explode(F.arrays_zip("years", "ram", "ramd")).alias("z"))
    rows = rows.select(by, "north", F.col("z.years").alias("label"), F.col("z.ram").alias("ram"), F.when(F.col("z.ramd") > 0, F.col("z.ramd")).alias("md")).filter("label IS NOT NULL AND ram >= 0")
    mon = F.floor(F.col("md") / 100).cast("int")
    later = F.when(F.col("north") & (mon < 7), F.col("label") + 1).otherwise(F.col("label"))
    return rows.select(by, "label", (F.col("ram") / 10).alias("hs"), (F.col("md") % 100).alias("day"), (mon - 1).alias("month"), F.when(mon.isNotNull(), later).alias("year"))


def season_levels(cells: DataFrame, whole_year: DataFrame, seasons: Column, fields: Column, raw: str, by: str) -> DataFrame:
    """(by, season, field, value, capped): a season's return levels are cut at those of the whole year (by, field, value)."""
    rows = cells.filter(F.col(raw).isNotNull()).select(by, seasons.alias("seasons"), fields.alias("fields"), F.posexplode(raw).alias("i", "v"))
    width = F.size("fields")
    named = rows.select(by, F.get("seasons", (F.col("i") / width).cast("int")).alias("season"), F.get("fields", F.col("i") % width).alias("field"), "v")
    read = named.select(by, "season", "field", F.when(F.col("field") == "n", F.col("v").cast("double")).otherwise(unscaled(F.col("v"), 10.0)).alias("own"))
    both = read.join(whole_year.select(by, "field", F.col("value").alias("year")), [by, "field"], "left")
    cut = F.coalesce(F.col("field").isin(*LEVELS) & (F.col("own") > F.col("year")), F.lit(False))
    return both.select(by, "season", "field", F.when(cut, F.col("year")).otherwise(F.col("own")).alias("value"), cut.alias("capped"))
