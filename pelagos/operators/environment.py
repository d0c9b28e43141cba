"""Currents, cyclones and daylight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions.constants import TIDE_POWER, WIND_DEPTH, WIND_SHARE
from pelagos.functions.numeric import half_up, month_days, weighted
from pelagos.functions.text import speed, storm_category

PROFILE_DEPTHS = (5.0, 10.0, 25.0, 50.0, 100.0, 200.0)
SURFACE_FACTOR = 8 / 7


def current_summary(monthly: DataFrame, months: list[int], names: tuple, by: str = "cell_id") -> DataFrame:
    """Means of monthly currents, weighted by days, each with its own denominator; places without any value go."""
    out = monthly.filter(F.col("m").isin(months)).groupBy(by).agg(*(weighted(F.col(n), month_days(F.col("m"))).alias(n) for n in names))
    return out.filter(F.coalesce(*names).isNotNull())


def current_profile(places: DataFrame, by: str = "cell_id") -> DataFrame:
    """(by, z, tidal, wind, background, total) down to one metre above the bed.

    places has depth (m), spring (m/s, depth mean), wind (m/s), surf and bot (background, m/s) and bot_depth (m); parts
    that are null are left out of the sum.
    """
    d = F.when(F.col("depth") > 2, F.col("depth"))
    levels = F.when(d.isNull(), F.array(F.lit(0.0))).otherwise(F.concat(F.array(F.lit(0.0)), F.filter(F.array(*map(F.lit, PROFILE_DEPTHS)), lambda z: z < d - 1), F.array(d - 1)))
    rows = places.filter(F.coalesce("spring", "wind", "surf").isNotNull()).withColumn("z", F.explode(levels))
    z, surface = F.col("z"), F.col("spring") * SURFACE_FACTOR
    tidal = F.when(d.isNotNull(), surface * F.pow((d - z) / d, F.lit(TIDE_POWER))).when(z == 0, surface)
    wind = F.col("wind") * WIND_SHARE * F.greatest(F.lit(0.0), 1 - z / WIND_DEPTH)
    has_bed = F.col("bot").isNotNull() & (F.col("bot_depth") >= 1)
    background = F.when(F.col("surf").isNotNull(), F.when(has_bed & (z >= F.col("bot_depth")), F.col("bot")).when(has_bed, F.col("surf") + (F.col("bot") - F.col("surf")) * z / F.col("bot_depth")).otherwise(F.col("surf")))
    zero = F.lit(0.0)
    return rows.select(by, "z", tidal.alias("tidal"), wind.alias("wind"), background.alias("background"), (F.coalesce(tidal, zero) + F.coalesce(wind, zero) + F.coalesce(background, zero)).alias("total"))


def cyclone_summary(monthly: DataFrame, whole_year: DataFrame, peaks: DataFrame, months: list[int], by: str = "cell_id") -> DataFrame:
    """(by, storms, days, happens, exact, wmax, category): sums over months. Sums of storms are exact for a single month; for all
    twelve the year's own count is taken if there is one. peaks has (by, wmax): the strongest wind on record in knots."""
    sums = monthly.filter(F.col("m").isin(months)).groupBy(by).agg(F.sum("storms").alias("storms"), F.sum("days").alias("days"), F.bool_or((F.col("storms") > 0) | (F.col("days") > 0)).alias("happens"))
    if len(months) < 12:
        sums = sums.withColumn("exact", F.lit(len(months) <= 1))
    else:
        sums = sums.join(whole_year, by, "left").select(by, F.coalesce("storms_all", "storms").alias("storms"), "days", "happens", F.col("storms_all").isNotNull().alias("exact"))
    return sums.join(peaks.select(by, "wmax"), by, "left").withColumn("category", storm_category(F.col("wmax")))


def in_cyclone_area(monthly: DataFrame, by: str = "cell_id") -> DataFrame:
    return monthly.groupBy(by).agg((F.sum("storms") >= 0.1).alias("in_area"))


def cyclones_by_phase(monthly: DataFrame, phase_years: DataFrame, months: list[int], by: str = "cell_id") -> DataFrame:
    """(by, phase, days, years): sums to one decimal, null for a phase without data, where two phases or more have data.

    phase_years has (phase, m, n): the years of each phase and month, three phases in all, so it is sent to every task.
    """
    chosen = F.col("m").isin(months)
    sums = monthly.filter(chosen).groupBy(by, "phase").agg(half_up(F.round(F.sum("days"), 6), 1).alias("days"))
    known = sums.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("phase", "days"))).alias("found")).filter(F.size("found") >= 2)
    years = phase_years.filter(chosen).groupBy("phase").agg(half_up(F.sum("n") / len(months)).cast("int").alias("years"))
    rows = known.select(by, "found", F.explode(F.array(*map(F.lit, range(3)))).alias("phase"))
    return rows.join(F.broadcast(years), "phase", "left").select(by, "phase", F.try_element_at("found", F.col("phase")).alias("days"), F.coalesce("years", F.lit(0)).alias("years"))


def near_bed(spring: Column, depth: Column) -> tuple[Column, Column]:
    """Tidal stream at the surface and near the bed, of its mean over depth; the bed's only in more than 2 m of water."""
    return spring * SURFACE_FACTOR, F.when(depth > 2, spring * SURFACE_FACTOR * F.pow(F.lit(1.0) / depth, F.lit(TIDE_POWER)))


def stream_headline(spring: Column) -> Column:
    """One line on the tide; its words are fixed values."""
    surface = spring * SURFACE_FACTOR
    strong = F.concat(F.lit("Tidal stream up to "), speed(surface), F.lit(" at springs."))
    return F.when(surface > 0.5, strong).when(surface.isNotNull(), "Weak tide: under 0.5 m/s (1 kn) even at springs.")


def daylight(places: DataFrame, lat: str = "lat") -> DataFrame:
    """places with m, hours of daylight, and rise and set (null by polar day or night) on the fifteenth of each month."""
    before = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
    month = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(float(b + 15)).alias("day")) for m, b in enumerate(before)))).alias("d")
    rows = places.select("*", month)
    decl = F.radians(F.lit(-23.44) * F.cos(2 * F.pi() / 365 * (F.col("d.day") + 10)))
    x = -F.tan(F.radians(F.col(lat))) * F.tan(decl)
    hours = F.when(x <= -1, 24.0).when(x >= 1, 0.0).otherwise(2 * F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))) / 15)
    out = rows.withColumns({"m": F.col("d.m"), "hours": hours}).drop("d")
    some = (F.col("hours") > 0) & (F.col("hours") < 24)
    return out.withColumns({"rise": F.when(some, 12 - F.col("hours") / 2), "set": F.when(some, 12 + F.col("hours") / 2)})


#: The words of the tables of currents.
SURFACE, NEAR_BED, DEEPEST, NO_DEPTH = "Surface", "Near seabed (~%s m)", "At %s m (deepest model level)", "about 2/3 of surface"
#: A model's deepest level counts as the bed's unless the water is deeper by more than this factor.
BED_FACTOR = 1.25


def background_table(places: DataFrame, by: str = "cell_id") -> DataFrame:
    """(by, place, label, typical, top): background currents at the surface and at the deepest level, which is named as such where the bed lies well below.

    places has surf50, surf90, bot50, bot90 (m/s), bot_depth and depth (m).
    """
    metres = format_metres(half_up(F.col("bot_depth")))
    deep = F.coalesce(F.col("depth") > F.col("bot_depth") * BED_FACTOR, F.lit(False))
    rows = F.array(
        F.when(F.col("surf50").isNotNull(), F.struct(F.lit(0).alias("place"), F.lit(SURFACE).alias("label"), F.col("surf50").alias("typical"), F.col("surf90").alias("top"))),
        F.when(F.col("bot50").isNotNull() & (F.col("bot_depth") >= 1), F.struct(F.lit(1).alias("place"), F.when(deep, F.format_string(DEEPEST, metres)).otherwise(F.format_string(NEAR_BED, metres)).alias("label"), F.col("bot50").alias("typical"), F.col("bot90").alias("top"))),
    )
    return places.select(by, F.explode(F.array_compact(rows)).alias("row")).select(by, "row.*")


def tide_table(places: DataFrame, by: str = "cell_id") -> DataFrame:
    """(by, place, label, springs, neaps, note): peak streams at the surface and near the bed; without a depth the bed has a note only.

    places has spring, neap (m/s, means over depth) and depth (m).
    """
    factor = F.when(F.col("depth") > 2, SURFACE_FACTOR * F.pow(F.lit(1.0) / F.col("depth"), F.lit(TIDE_POWER)))
    none = F.lit(None).cast("double")
    shallow = F.struct(F.lit(1).alias("place"), F.lit("Near seabed").alias("label"), none.alias("springs"), none.alias("neaps"), F.lit(NO_DEPTH).alias("note"))
    bed = F.struct(F.lit(1).alias("place"), F.format_string(NEAR_BED, format_metres(half_up(F.col("depth")))).alias("label"), (F.col("spring") * factor).alias("springs"), (F.col("neap") * factor).alias("neaps"), F.lit(None).cast("string").alias("note"))
    surface = F.struct(F.lit(0).alias("place"), F.lit(SURFACE).alias("label"), (F.col("spring") * SURFACE_FACTOR).alias("springs"), (F.col("neap") * SURFACE_FACTOR).alias("neaps"), F.lit(None).cast("string").alias("note"))
    rows = places.filter("spring IS NOT NULL").select(by, F.explode(F.array(surface, F.when(factor.isNotNull(), bed).otherwise(shallow))).alias("row"))
    return rows.select(by, "row.*")


def format_metres(metres: Column) -> Column:
    """Whole metres with commas at thousands."""
    return F.format_number(metres, 0)
