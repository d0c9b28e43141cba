"""What panels and charts need beside the statistics: axes, labels, view filters, tiles of a box."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.functions import text as X
from pelagos.functions.numeric import first_cap

#: Where the axes of each chart may end, and the steps of the graticule in degrees.
PERIOD_CAPS = (4, 8, 12, 20, 30, 40, 60, 100)
ROSE_CAPS = (10, 20, 30, 40, 60, 80, 100)
STORM_CAPS = (0.5, 1, 2, 4, 8, 16, 31)
WINDOW_CAPS = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
GRATICULE = (0.25, 0.5, 1, 2, 5, 10, 15, 30)


def axis(top: Column, caps: tuple, factor: float) -> Column:
    """Where an axis ends whose highest value is `top`."""
    return first_cap(top, caps, factor)


def windows_axis(top: Column, most: Column) -> Column:
    """The end of the weather windows' axis: for the largest possible number if it is known (and not 0), else a little over the top."""
    target = F.when(most > 0, F.greatest(most, top)).otherwise(top * 1.06)
    caps = F.filter(F.array(*(F.lit(float(c)) for c in WINDOW_CAPS)), lambda c: c >= target)
    return F.coalesce(F.get(caps, F.lit(0)), F.ceil(1.1 * target).cast("double"))


def period_range(months: DataFrame, by: str, value: str) -> DataFrame:
    """(by, low, high): whole seconds around all months' periods, one to spare on either side, four apart at least."""
    ends = months.groupBy(by).agg(F.greatest(F.lit(0.0), F.floor(F.min(value) - 1).cast("double")).alias("low"), F.ceil(F.max(value) + 1).cast("double").alias("high"))
    return ends.filter("high IS NOT NULL").select(by, "low", F.greatest("high", F.col("low") + 4).alias("high"))


def limit_percent(p: Column, floor: Column) -> Column:
    """A share of time beyond a limit; "<" where the limit lies over the highest threshold."""
    s = X.percent(p)
    return F.replace(F.when(floor & ~s.startswith("<"), F.concat(F.lit("<"), s)).otherwise(s), F.lit("<"), F.lit("< "))


def slot_label(slot: Column) -> Column:
    """The hour at which a three-hour slot begins."""
    return F.concat(F.lpad((slot * 3).cast("string"), 2, "0"), F.lit(":00"))


def track_tip(name: Column, year: Column, wind: Column) -> list[Column]:
    """name, detail (year or season, category) and peak (knots and km/h) of a storm's label."""
    shown = X.track_name(name)
    when = F.when(shown.contains(year.cast("string")), F.concat(F.lit("season "), year.cast("string"))).otherwise(year.cast("string"))
    peak = F.when(wind > 0, F.concat(F.lit("Peak "), X.fixed(wind, 0), F.lit(" kt ("), X.fixed(wind * 1.852, 0), F.lit(" km/h) over its life"))).otherwise("")
    return [shown.alias("name"), F.concat_ws(" · ", when, X.storm_category(wind)).alias("detail"), peak.alias("peak")]


def has_kinds(assets: DataFrame, kind: str, wanted: dict[str, str]) -> DataFrame:
    """One row: whether there are assets of each kind."""
    return assets.agg(*(F.coalesce(F.bool_or(F.col(kind) == k), F.lit(False)).alias(name) for name, k in wanted.items()))


def graticule_step(scale: Column) -> Column:
    """The smallest step that is 55 pixels wide or more, else the largest."""
    fits = F.filter(F.array(*(F.lit(float(s)) for s in GRATICULE)), lambda s: s * scale >= 55)
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(30.0))


def grid_read(points: DataFrame, grid: DataFrame, lat0: float, lon0: float, res: float, rows: int, cols: int) -> DataFrame:
    """points with the nearest value of a grid whose first value lies at (lat0, lon0); those beside the grid go."""
    r = F.floor((F.col("lat") - lat0) / res + 0.5).cast("int")
    c = F.floor((geo.wrap_lon(F.col("lon")) - lon0) / res + 0.5).cast("int")
    return points.withColumns({"r": r, "c": c}).filter(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1)).join(grid, ["r", "c"])


def track_radius(radii: Column, chosen: Column) -> Column:
    """The chosen radius (by number, from 0), the last one by default, 1000 nautical miles where there are none."""
    last = F.size(radii) - 1
    at = F.least(F.coalesce(chosen, last), last)
    return F.when(F.coalesce(F.size(radii), F.lit(0)) > 0, F.get(radii, at)).otherwise(1000.0)


def tiles_of_box(boxes: DataFrame, step: int, by: str) -> DataFrame:
    """(by, la, lo, tile): corners and names of the tiles that boxes (lat0 .. lat1, lon0 .. lon1) touch; longitudes wrap in names."""
    corners = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / step).cast("int"), F.floor(F.col(high) / step).cast("int")))
    out = boxes.withColumn("la", corners("lat0", "lat1")).withColumn("lo", corners("lon0", "lon1"))
    out = out.withColumns({"la": F.col("la") * step, "lo": F.col("lo") * step})
    return out.select(by, "la", "lo", F.concat_ws("_", F.lit("d"), F.col("la").cast("string"), (F.pmod(F.col("lo") + 180, F.lit(360)) - 180).cast("string")).alias("tile"))


def nearest_joint(points: DataFrame, joint: DataFrame, reach: float = 0.75) -> DataFrame:
    """(pt_id, cell_id): the joint table nearest to the centre of a point's block, by squared degrees under reach squared.

    Blocks are one degree wide: a block meets the tables of the nine whole degrees around its centre.
    """
    la, lo = geo.joint_block(F.col("lat"), F.col("lon"))
    at = points.select("pt_id", la.alias("la"), lo.alias("lo"))
    near = at.select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("a")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("b"))
    near = near.select("pt_id", "la", "lo", (F.floor("la") + F.col("a")).alias("ka"), (F.floor("lo") + F.col("b")).alias("kb"))
    tables = joint.select("cell_id", F.col("lat").alias("tla"), F.col("lon").alias("tlo"), F.floor("lat").alias("ka"), F.floor("lon").alias("kb"))
    d = (F.col("tla") - F.col("la")) ** 2 + (F.col("tlo") - F.col("lo")) ** 2
    met = near.join(tables, ["ka", "kb"]).withColumn("d", d).filter(F.col("d") < reach**2)
    return met.groupBy("pt_id").agg(F.min(F.struct("d", "cell_id"))["cell_id"].alias("cell_id"))


def in_view(points: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    return points.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def places_at_zoom(places: DataFrame, scale: float) -> DataFrame:
    """Places that show at a scale (pixels a degree): zoom levels beyond six count for 1.8."""
    z = F.log2(F.lit(scale * 360 / 256)) + 1
    return places.filter(F.col("min_zoom") <= z + 0.8 * F.greatest(F.lit(0.0), z - 6))


@dataclass(frozen=True)
class AssetChoice:
    """A user's choice of assets; by default all of them."""

    wells: bool = True
    platforms: bool = True
    lng: bool = True
    fields: bool = True
    active_only: bool = False
    low: float | None = None
    high: float | None = None
    text: str = ""


def chosen_assets(assets: DataFrame, choice: AssetChoice) -> DataFrame:
    """assets (t, s, d, n, o) of a choice. Where a depth is asked for, one of 0 counts as missing and fails; the text is
    sought in name, status and operator, in any case."""
    if choice == AssetChoice():
        return assets
    kind = F.coalesce("t", F.lit(""))
    well, platform, lng = kind == "well", kind.contains("platform"), kind == "lng terminal"
    wanted = F.lit(True)
    for is_kind, on in ((well, choice.wells), (platform, choice.platforms), (lng, choice.lng), (~well & ~platform & ~lng, choice.fields)):
        wanted = wanted if on else wanted & ~is_kind
    if choice.active_only:
        wanted = wanted & (~well | X.in_service(F.col("s")))
    if choice.low is not None or choice.high is not None:
        wanted = wanted & F.coalesce(F.col("d") != 0, F.lit(False))
        wanted = wanted & (F.col("d") >= choice.low) if choice.low is not None else wanted
        wanted = wanted & (F.col("d") <= choice.high) if choice.high is not None else wanted
    if text := choice.text.strip().lower():
        empty = F.lit("")
        wanted = wanted & F.lower(F.concat_ws(" ", F.coalesce("n", empty), F.coalesce("s", empty), F.coalesce("o", empty))).contains(text)
    return assets.filter(wanted)


def window_defaults(limit: Column, limits: tuple, edges: tuple) -> list[Column]:
    """The window shown first: the limit nearest to the user's (the lower of equals), 24 hours if there are such windows,
    and how many of them a month holds at most."""
    hours = 24 if 24 in edges else edges[0]
    near = F.array_min(F.array(*(F.struct(F.abs(limit - t).alias("d"), F.lit(float(t)).alias("t")) for t in limits)))["t"]
    return [near.alias("window_limit"), F.lit(hours).alias("hours"), F.lit(31 * 24 // hours).alias("most")]


def scatter_cells(table: DataFrame) -> DataFrame:
    """(hs_bin, tp_bin, permille, txt, top): a joint table's cells that hold something, as whole thousandths or "<1"; top is the highest row with any."""
    sums = table.filter("cnt > 0").crossJoin(F.broadcast(table.agg(F.sum("cnt").alias("total"), F.max(F.when(F.col("cnt") > 0, F.col("hs_bin"))).alias("top"))))
    v = F.lit(1000.0) * F.col("cnt") / F.col("total")
    return sums.select("hs_bin", "tp_bin", v.alias("permille"), F.when(v >= 1, F.floor(v + 0.5).cast("string")).otherwise("<1").alias("txt"), "top")


def view_key(south: Column, north: Column, west: Column, east: Column, step: float = 0.25) -> list[Column]:
    """A view's box, widened to whole steps."""
    down, up = (lambda x: F.floor(x / step).cast("double") * step), (lambda x: F.ceil(x / step).cast("double") * step)
    return [down(south).alias("s"), up(north).alias("n"), down(west).alias("w"), up(east).alias("e")]


def few_tiles(box_tiles: DataFrame, by: str, most: int = 12) -> DataFrame:
    """box_tiles of boxes that touch few tiles; a box with more has no row at all (a limit of the feature)."""
    return box_tiles.withColumn("k", F.count("*").over(Window.partitionBy(by))).filter(F.col("k") <= most).drop("k")


def contours_of_boxes(boxes: DataFrame, there: DataFrame, segments: DataFrame, by: str, step: int, most: int = 12) -> DataFrame:
    """(by, level, segments..): the contours (tile, level, ..) in the tiles of each box, of those tiles that there are."""
    tiles = tiles_of_box(boxes, step, by).select(by, "tile").distinct().join(there.select("tile"), "tile", "left_semi")
    return few_tiles(tiles, by, most).join(segments, "tile")


#: How deep the water may be for each set of contour levels; the last set serves all that is deeper.
LADDERS = ((60, (10, 20, 30, 40, 50)), (150, (20, 50, 75, 100, 125, 150)), (400, (50, 100, 150, 200, 300, 400)), (1200, (100, 200, 400, 600, 800, 1000)), (3000, (200, 500, 1000, 1500, 2000, 2500, 3000)), (99999, (500, 1000, 2000, 3000, 4000, 5000, 6000)))
#: Fixed value: the depth that counts where none is known.
ANY_DEPTH = 3000.0


def ladder(depth: Column) -> Column:
    """The contour levels for a depth: those of the first ladder that reaches it."""
    levels = lambda of: F.array(*(F.lit(float(x)) for x in of))
    d = F.coalesce(depth, F.lit(ANY_DEPTH))
    out = levels(LADDERS[-1][1])
    for bound, of in reversed(LADDERS[:-1]):
        out = F.when(d <= bound, levels(of)).otherwise(out)
    return out


def contours_of_views(views: DataFrame, there: DataFrame, segments: DataFrame, by: str, step: int, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(by, key) of views (lat0, lat1, lon0, lon1, depth), and (key, level, segments..) of each distinct key.

    A key is a view's box widened to quarters of a degree with its ladder of levels: views that share it share its contours,
    which are found once.
    """
    boxed = views.select(by, *view_key(F.col("lat0"), F.col("lat1"), F.col("lon0"), F.col("lon1")), ladder(F.col("depth")).alias("levels"))
    keyed = boxed.withColumn("key", F.concat_ws(",", "s", "n", "w", "e", F.get("levels", F.lit(0)), F.get("levels", F.lit(1))))
    keys = keyed.groupBy("key").agg(*(F.first(c).alias(c) for c in ("s", "n", "w", "e", "levels")))
    boxes = keys.select("key", F.col("s").alias("lat0"), F.col("n").alias("lat1"), F.col("w").alias("lon0"), F.col("e").alias("lon1"))
    tiles = few_tiles(tiles_of_box(boxes, step, "key").select("key", "tile").distinct().join(there.select("tile"), "tile", "left_semi"), "key", most)
    wanted = tiles.join(keys.select("key", F.explode("levels").alias("level")), "key")
    return keyed.select(by, "key"), wanted.join(segments, ["tile", "level"])


def report_axis(top: Column, percent: Column, most: Column) -> Column:
    """Where the report's bar axis ends: over shares, over counts, or up to a month's largest possible number where it is given."""
    end = lambda caps, target: F.coalesce(F.get(F.filter(F.array(*(F.lit(float(c)) for c in caps)), lambda c: c >= target), F.lit(0)), F.lit(float(caps[-1])))
    return F.when(most > 0, end(WINDOW_CAPS, F.greatest(most, top))).when(percent, end(SHARE_CAPS, top * 1.06)).otherwise(end(COUNT_CAPS, top * 1.06))


#: Ends of the report's axes.
SHARE_CAPS = (4, 8, 12, 20, 40, 60, 80, 100)
COUNT_CAPS = (1, 2, 4, 8, 12, 16, 20, 40, 60, 80, 100)


def line_tip(name: Column, operator: Column, status: Column, country: Column) -> list[Column]:
    """head, detail and note of a line's label; its words are fixed values."""
    some = lambda c: F.when(c != "", c)
    named = F.coalesce((name != "") & (F.lower(name) != "pipeline"), F.lit(False))
    bits = F.concat_ws(" · ", F.when(named, some(operator)), some(status), some(country))
    detail = F.when(bits == "", "Pipeline").otherwise(F.concat(F.lit("Pipeline, "), bits))
    bare = ~named & some(operator).isNull() & some(status).isNull()
    return [F.when(named, name).otherwise(F.coalesce(some(operator), F.lit("Pipeline"))).alias("head"), detail.alias("detail"), F.when(bare, "No further detail in the register").otherwise("").alias("note")]


def day_cycle(slots: DataFrame, by: str) -> DataFrame:
    """(by, hour, hs): the chart of a day's eight slots, closed at hour 24 by the first slot's value; those without a value at all go."""
    hours = slots.filter("hs IS NOT NULL").select(by, F.explode(F.when(F.col("slot") == 0, F.array(F.lit(0), F.lit(24))).otherwise(F.array(F.col("slot") * 3))).alias("hour"), "hs")
    return hours.select(by, F.col("hour").cast("int").alias("hour"), "hs")
