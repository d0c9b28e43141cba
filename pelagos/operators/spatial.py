"""Places: nearest cells, tiles, polygons, land masks.

Nearest-neighbour joins meet on tile keys: cells are bucketed by tile, points ask for the tiles that a radius reaches,
and both sides hash-join on the tile. Ties go to the smaller cell id. Places are searched, not rows: points and cells that
share their coordinates share the search, so that its pairs grow with places alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.sources.shared import kept

#: Widths of tiles, in degrees, that divide the globe.
TILE_SIZES = (0.25, 0.5, 1.0, 2.0, 4.0, 6.0, 10.0, 20.0)


def lat_tiles(lat: Column, km: float, size: float) -> Column:
    reach = km / 111.0
    return F.sequence(F.floor((F.greatest(lat - reach, F.lit(-90.0)) + 90) / size).cast("int"), F.floor((F.least(lat + reach, F.lit(90.0)) + 90) / size).cast("int"))


def lon_tiles(lat: Column, lon: Column, km: float, size: float) -> Column:
    """Numbers of the tiles of longitude that km reach, around the globe. Near a pole all of them."""
    tiles = int(360 / size)
    edge = F.least(F.abs(lat) + km / 111.0, F.lit(90.0))
    reach = F.when(edge > 89.0, 180.0).otherwise(F.least(F.lit(180.0), km / 111.0 / F.cos(F.radians(edge))))
    first, last = F.floor((lon - reach + 180) / size).cast("int"), F.floor((lon + reach + 180) / size).cast("int")
    span = F.sequence(first, F.least(last, first + tiles - 1))
    return F.array_distinct(F.transform(span, lambda k: F.pmod(k, F.lit(tiles))))


def candidate_tiles(points: DataFrame, km: float, size: float) -> DataFrame:
    """points with one row for each tile (ti, tj) that a radius reaches."""
    return points.withColumn("ti", F.explode(lat_tiles(F.col("lat"), km, size))).withColumn("tj", F.explode(lon_tiles(F.col("lat"), F.col("lon"), km, size)))


def in_tiles(cells: DataFrame, size: float) -> DataFrame:
    return cells.withColumns({"ti": F.floor((F.col("lat") + 90) / size).cast("int"), "tj": F.pmod(F.floor((geo.wrap_lon(F.col("lon")) + 180) / size).cast("int"), F.lit(int(360 / size)))})


def sites(cells: DataFrame, cell_id: str = "cell_id", *by: str) -> DataFrame:
    """(by, lat, lon, cell_id): one row a place, with the smallest id there. Of cells at one place no other can be the nearest."""
    return cells.groupBy(*by, "lat", "lon").agg(F.min(cell_id).alias(cell_id))


def km_between(lat: Column, lon: Column, clat: Column, clon: Column) -> Column:
    return F.round(geo.haversine_km(lat, lon, clat, clon), 6)


def _nearest_site(places: DataFrame, held: DataFrame, km: float, size: float, cell_id: str, measure: Callable = km_between, reach: float | None = None) -> DataFrame:
    """(lat, lon, cell_id, km) of places (lat, lon), each there once, and sites."""
    near = candidate_tiles(places.select("lat", "lon"), reach or km, size)
    far = in_tiles(held, size).withColumnsRenamed({"lat": "clat", "lon": "clon"})
    pairs = near.join(far, ["ti", "tj"]).withColumn("km", measure(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))).filter(F.col("km") <= km)
    return _best_of(pairs, cell_id)


def _best_of(pairs: DataFrame, cell_id: str) -> DataFrame:
    best = pairs.groupBy("lat", "lon").agg(F.min(F.struct("km", cell_id)).alias("best"))
    return best.select("lat", "lon", F.col(f"best.{cell_id}").alias(cell_id), F.col("best.km").alias("km"))


def _told(points: DataFrame, found: DataFrame, point_id: str, cell_id: str) -> DataFrame:
    """(point_id, cell_id, km): what was found for places, told to the points there; an id at several places has the nearest of theirs."""
    best = points.select(point_id, "lat", "lon").join(found, ["lat", "lon"]).groupBy(point_id).agg(F.min(F.struct("km", cell_id)).alias("best"))
    return best.select(point_id, F.col(f"best.{cell_id}").alias(cell_id), F.col("best.km").alias("km"))


def nearest(points: DataFrame, cells: DataFrame, km: float, size: float = 10.0, point_id: str = "pt_id", cell_id: str = "cell_id", measure: Callable = km_between, reach: float | None = None) -> DataFrame:
    """(point_id, cell_id, km): the nearest cell of each point within a radius; points without one are missing.

    Places are searched, each once, however many points and cells lie there. A `measure` that rounds gives a `reach` that
    holds all that it lets within the radius.
    """
    return _told(points, _nearest_site(points.select("lat", "lon").distinct(), sites(cells, cell_id), km, size, cell_id, measure, reach), point_id, cell_id)


def nearest_in_rounds(points: DataFrame, cells: DataFrame, radii: tuple, point_id: str = "pt_id", cell_id: str = "cell_id") -> DataFrame:
    """As nearest within the last radius, in rounds of growing radius: a place that finds a cell is settled, since none that
    lies farther than the radius can be nearer. Tiles are as wide as a round's radius, so that a place meets the cells of a
    few tiles of that size and not all that the last radius holds. A round's result is a table in the shared folder."""
    rest, held, done = points.select("lat", "lon").distinct(), sites(cells, cell_id), []
    for k, km in enumerate(radii):
        size = next(s for s in TILE_SIZES if s * 111.0 >= km or s == TILE_SIZES[-1])
        found = rest.join(_nearest_site(rest, held, km, size, cell_id), ["lat", "lon"], "left")
        if k + 1 < len(radii):
            found = kept(found, f"nearest-{k}")
        done.append(found.filter("km IS NOT NULL").select("lat", "lon", cell_id, "km"))
        rest = found.filter("km IS NULL").select("lat", "lon")
    return _told(points, reduce(DataFrame.unionByName, done), point_id, cell_id)


def nearest_or_none(points: DataFrame, cells: DataFrame, km: float, **names) -> DataFrame:
    """As nearest, with a row for every point: `none` marks those without a cell in reach."""
    point_id = names.get("point_id", "pt_id")
    return points.select(point_id).join(nearest(points, cells, km, **names), point_id, "left").withColumn("none", F.col("km").isNull())


def edges(rings: DataFrame, by: tuple = ("level", "ring")) -> DataFrame:
    """Edges (x1, y1, x2, y2) of closed rings; the last vertex joins the first."""
    w = Window.partitionBy(*by).orderBy("seq")
    whole = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rings.select(*by, F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y2"))


def crossings(points: DataFrame, ring_edges: DataFrame, by: str = "level", point_id: str = "pt_id", band: float = 1.0) -> DataFrame:
    """(point_id, by) of the levels that hold a point: even-odd rule with half-open edges.

    Edges are cut to bands of latitude, so that places and edges meet by a hash join on the band, each place once, however
    many points lie there. A ring's box is given to its edges first: where a point lies beside or beyond it, no ray is cast.
    """
    ring = [c for c in ring_edges.columns if c not in ("x1", "y1", "x2", "y2")]
    box = Window.partitionBy(*ring)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    number = lambda y: F.floor(y / band).cast("int")
    boxed = ring_edges.withColumns({"_west": F.min(F.least("x1", "x2")).over(box), "_east": F.max(F.greatest("x1", "x2")).over(box)}).filter("y1 <> y2")
    banded = boxed.withColumn("_band", F.explode(F.sequence(number(low), number(high))))
    y, x = F.col("lat"), F.col("lon")
    half_open = ((F.col("y1") <= y) & (F.col("y2") > y)) | ((F.col("y2") <= y) & (F.col("y1") > y))
    at = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    places = points.select("lat", "lon").distinct().withColumn("_band", number(y))
    met = places.join(banded, "_band").filter((x >= F.col("_west")) & (x <= F.col("_east")) & half_open & (at > x)).groupBy("lat", "lon", by).agg(F.count("*").alias("hits"))
    hits = points.select(point_id, "lat", "lon").join(met, ["lat", "lon"]).groupBy(point_id, by).agg((F.sum("hits") % 2 == 1).alias("inside"))
    return hits.filter("inside").select(point_id, by)


def rings(levels: DataFrame, scale: float = 100.0, by: tuple = ("level", "ring")) -> DataFrame:
    """(by, seq, x, y) of rings in delta codes: one row a step (by, seq, dx, dy), whole numbers."""
    so_far = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return levels.select(*by, "seq", (F.sum("dx").over(so_far) / scale).alias("x"), (F.sum("dy").over(so_far) / scale).alias("y"))


def ring_boxes(vertices: DataFrame, by: tuple = ("level", "ring")) -> DataFrame:
    """(by, points, west, south, east, north) of each ring."""
    return vertices.groupBy(*by).agg(F.count("*").alias("points"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))


def depth_band(points: DataFrame, inside: DataFrame, levels: list[int], point_id: str = "pt_id") -> DataFrame:
    """(point_id, band): by the deepest level that holds a point."""
    deepest = points.select(point_id).join(inside.groupBy(point_id).agg(F.max("level").alias("level")), point_id, "left")
    metres = lambda d: f"{d:,} m"
    band = F.when(F.col("level").isNull(), f"under {metres(levels[0])}").when(F.col("level") == levels[-1], f"deeper than {metres(levels[-1])}")
    for lo, hi in zip(levels, levels[1:]):
        band = band.when(F.col("level") == lo, f"{metres(lo)} to {metres(hi)}")
    return deepest.select(point_id, band.alias("band"))


def land_mask(ring_edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, j) of one-degree cells on land, by scan lines at the cells' centres: crossings in order are filled pair by pair.

    rows has i, the number of a row from the south.
    """
    y = F.col("i") - 89.5
    half_open = ((F.col("y1") <= y) & (F.col("y2") > y)) | ((F.col("y2") <= y) & (F.col("y1") > y))
    at = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hits = rows.join(ring_edges, half_open).select("i", at.alias("x"))
    w = Window.partitionBy("i").orderBy("x")
    pairs = hits.withColumns({"k": F.row_number().over(w), "to": F.lead("x").over(w)}).filter((F.col("k") % 2 == 1) & F.col("to").isNotNull())
    first, last = F.ceil(F.col("x") + 179.5 - 1e-9).cast("int"), F.floor(F.col("to") + 179.5 + 1e-9).cast("int")
    spans = pairs.select("i", F.greatest(first, F.lit(0)).alias("a"), F.least(last, F.lit(359)).alias("b")).filter("a <= b")
    return spans.select("i", F.explode(F.sequence("a", "b")).alias("j")).distinct()


def mask_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and column of the mask's cell at a place."""
    return F.greatest(F.lit(0), F.least(F.lit(179), F.floor(lat + 90).cast("int"))), F.greatest(F.lit(0), F.least(F.lit(359), F.floor(geo.wrap_lon(lon) + 180).cast("int")))


def nearest_ocean(points: DataFrame, land: DataFrame, rings: int = 40, point_id: str = "pt_id") -> DataFrame:
    """(point_id, i, j, km): the point's own cell if it is sea, else the nearest sea cell in the first ring that has one or
    in the next; ties to the lower row, then column. Points without sea in so many rings have no row.

    Rings are sought once for each cell of the mask that holds a point, of which there are at most 64,800, and distances
    once for each place.
    """
    spark = points.sparkSession
    i, j = mask_cell(F.col("lat"), F.col("lon"))
    placed = points.select("lat", "lon").distinct().select("lat", "lon", i.alias("pi"), j.alias("pj"))
    is_land = land.select(F.col("i").alias("pi"), F.col("j").alias("pj")).distinct()
    cells = spark.range(180 * 360).select(F.floor(F.col("id") / 360).cast("int").alias("pi"), (F.col("id") % 360).cast("int").alias("pj")).join(is_land.withColumn("land", F.lit(True)), ["pi", "pj"], "left")
    # columns to the next sea cell of the row on either side, around the globe
    row, sea = Window.partitionBy("pi"), F.when(F.col("land").isNull(), F.col("pj"))
    back, ahead = row.orderBy("pj").rowsBetween(Window.unboundedPreceding, 0), row.orderBy("pj").rowsBetween(0, Window.unboundedFollowing)
    west = F.col("pj") - F.coalesce(F.last(sea, True).over(back), F.max(sea).over(row) - 360)
    east = F.coalesce(F.first(sea, True).over(ahead), F.min(sea).over(row) + 360) - F.col("pj")
    gaps = cells.select(F.col("pi").alias("i"), "pj", F.least(west, east).alias("gap")).filter("gap IS NOT NULL")
    inland = placed.select("pi", "pj").distinct().join(is_land, ["pi", "pj"], "left_semi")
    rows = inland.select("pi", "pj", F.explode(F.sequence(F.lit(-rings), F.lit(rings))).alias("di")).withColumn("i", F.col("pi") + F.col("di"))
    first = rows.join(gaps, ["i", "pj"]).groupBy("pi", "pj").agg(F.min(F.greatest(F.abs("di"), F.col("gap"))).alias("first")).filter(F.col("first") <= rings)
    last = F.col("first") + 1
    lines = first.select("*", F.explode(F.sequence(-last, last)).alias("di"))
    full = F.abs("di") >= F.col("first")
    around = lines.select("*", F.explode(F.when(full, F.sequence(-last, last)).otherwise(F.array(-last, -F.col("first"), F.col("first"), last))).alias("dj"))
    near = around.filter(F.greatest(F.abs("di"), F.abs("dj")).between(F.col("first"), F.least(last, F.lit(rings)))).select("pi", "pj", (F.col("pi") + F.col("di")).alias("i"), F.pmod(F.col("pj") + F.col("dj"), F.lit(360)).alias("j")).filter("i BETWEEN 0 AND 179")
    choices = near.join(land.select("i", "j"), ["i", "j"], "left_anti")
    km = F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("i") - 89.5, F.col("j") - 179.5), 6).alias("km")
    best = placed.join(choices, ["pi", "pj"]).groupBy("lat", "lon").agg(F.min(F.struct(km, F.col("i"), F.col("j"))).alias("b")).select("lat", "lon", "b")
    at_sea = placed.join(is_land, ["pi", "pj"], "left_anti").select("lat", "lon", F.col("pi").alias("i"), F.col("pj").alias("j")).select("lat", "lon", F.struct(km, "i", "j").alias("b"))
    found = points.select(point_id, "lat", "lon").join(at_sea.unionByName(best), ["lat", "lon"]).groupBy(point_id).agg(F.min("b").alias("b"))
    return found.select(point_id, "b.i", "b.j", "b.km")


def nearest_home_first(points: DataFrame, cells: DataFrame, km: float, size: float = 10.0, point_id: str = "pt_id", cell_id: str = "cell_id") -> DataFrame:
    """As nearest, in two steps: a place is done if its own tile has a cell nearer than 0.99 of the way to the tile's edge;
    the others ask all tiles that the radius reaches. Pays where cells are dense and most places lie well inside a tile."""
    lat, lon = F.col("lat"), geo.wrap_lon(F.col("lon"))
    north, east = F.pmod(lat + 90, F.lit(size)), F.pmod(lon + 180, F.lit(size))
    # the sides of a tile are meridians: nearest where they come closest to the pole
    narrow = F.cos(F.radians(F.least(F.abs(lat) + size, F.lit(90.0))))
    edge = F.least(north, size - north, F.least(east, size - east) * narrow) * 111.0
    places, held = points.select("lat", "lon").distinct(), sites(cells, cell_id)
    home = in_tiles(places.withColumn("edge", edge), size)
    far = in_tiles(held, size).withColumnsRenamed({"lat": "clat", "lon": "clon"})
    pairs = home.join(far, ["ti", "tj"]).withColumn("km", km_between(lat, F.col("lon"), F.col("clat"), F.col("clon"))).filter((F.col("km") <= 0.99 * F.col("edge")) & (F.col("km") <= km))
    done = _best_of(pairs, cell_id)
    rest = places.join(done.select("lat", "lon"), ["lat", "lon"], "left_anti")
    return _told(points, done.unionByName(_nearest_site(rest, held, km, size, cell_id)), point_id, cell_id)
