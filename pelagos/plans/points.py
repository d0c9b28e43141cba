"""A place and all that its panels show: keys of all layers first, wide rows of the winners afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions import text as X
from pelagos.functions.constants import MONTH_DAYS, SNAP_KM
from pelagos.operators import environment as E
from pelagos.operators import extremes as M
from pelagos.operators import lookup as K
from pelagos.operators import persistence as P
from pelagos.operators import raster as G
from pelagos.operators import rollup as R
from pelagos.operators import spatial as S
from pelagos.operators.quantile import quantiles
from pelagos.plans import layers as Y
from pelagos.plans.places import _hav
from pelagos.plans.registry import ASSETS, CELLS, GRID, ORACLES, query
from pelagos.plans.rollups import SUMMER, SWELL_T, H
from pelagos.sources import bindings as B
from pelagos.sources import nested as N
from pelagos.sources.shared import kept


def r(col, digits: int = 6):
    return F.round(col, digits)


_AT_SEA = "pts AS (SELECT c_custkey AS pt_id, ((k * 53) % 170 - 85)::DOUBLE + c_custkey % 9 * 0.5 AS lat, ((k * 77) % 360 - 180)::DOUBLE + 0.5 AS lon FROM (SELECT c_custkey, c_custkey % 97 + 1 AS k FROM customer))"
_NEAR = f"""{CELLS}, {ASSETS}, {GRID}, {_AT_SEA},
    wv AS (SELECT pt_id, arg_min(cell_id, (km, cell_id)) AS cell_id, min(km) AS km FROM (SELECT pt_id, cell_id, round({_hav('p.lat', 'p.lon', 'c.lat', 'c.lon')}, 6) AS km FROM pts p, cells c WHERE cell_id % 4 IN (1, 2)) WHERE km <= 350 GROUP BY pt_id),
    won AS (SELECT cell_id, lat, lon FROM cells WHERE cell_id IN (SELECT cell_id FROM wv)),
    cu AS (SELECT w.cell_id, arg_min(c.cell_id, (round({_hav('w.lat', 'w.lon', 'c.lat', 'c.lon')}, 6), c.cell_id)) AS current_id FROM won w, cells c WHERE c.cell_id % 3 <> 0 AND round({_hav('w.lat', 'w.lon', 'c.lat', 'c.lon')}, 6) <= 120 GROUP BY w.cell_id),
    cy AS (SELECT w.cell_id, arg_min(c.cell_id, (round({_hav('w.lat', 'w.lon', 'c.lat', 'c.lon')}, 6), c.cell_id)) AS cyclone_id FROM won w, cells c WHERE c.cell_id % 5 <> 0 AND round({_hav('w.lat', 'w.lon', 'c.lat', 'c.lon')}, 6) <= 170 GROUP BY w.cell_id),
    ast AS (SELECT w.cell_id, arg_min(a.asset_id, (floor({_hav('w.lat', 'w.lon', 'a.lat', 'a.lon')} + 0.5), a.asset_id)) AS asset_id, min(floor({_hav('w.lat', 'w.lon', 'a.lat', 'a.lon')} + 0.5)) AS asset_km FROM won w, assets a WHERE floor({_hav('w.lat', 'w.lon', 'a.lat', 'a.lon')} + 0.5) <= 400 GROUP BY w.cell_id),
    bl AS (SELECT cell_id, floor(lat + 89.25 + 0.5) - 89.25 AS la, CASE WHEN floor(lon + 179.75 + 0.5) - 179.75 < -179.75 THEN 179.25 ELSE floor(lon + 179.75 + 0.5) - 179.75 END AS lo FROM won),
    jo AS (SELECT b.cell_id, arg_min(c.cell_id, (pow(c.lat + 0.25 - la, 2) + pow(c.lon - 0.25 - lo, 2), c.cell_id)) AS joint_id FROM bl b, cells c WHERE c.cell_id % 2 = 1 AND pow(c.lat + 0.25 - la, 2) + pow(c.lon - 0.25 - lo, 2) < 0.5625 GROUP BY b.cell_id),
    dp AS (SELECT cell_id, CASE WHEN elev < 0 THEN -elev END AS depth FROM (SELECT cell_id, greatest(0, least(19, floor((lat + 90) / 9)))::INT AS r, greatest(0, least(39, floor((lon + 180) / 9)))::INT AS c FROM won) LEFT JOIN grid USING (r, c))"""


def at_sea(spark, sf_dir) -> DataFrame:
    """Points some 60 to 450 km from cells."""
    k = F.col("c_custkey") % 97 + 1
    return B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pt_id"), (((k * 53) % 170 - 85).cast("double") + F.col("c_custkey") % 9 * 0.5).alias("lat"), (((k * 77) % 360 - 180).cast("double") + 0.5).alias("lon"))


def nearest_keys(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(pt_id, cell_id, km) of points, and (cell_id, <layer>_id, ..) of the cells that some point has: five layers in two joins on tiles."""
    cells = B.cells(spark, sf_dir).select("cell_id", "lat", "lon")
    waves = kept(S.nearest(at_sea(spark, sf_dir), cells.filter("cell_id % 4 IN (1, 2)"), SNAP_KM["waves"], 5.0), "nearest-cells")
    won = cells.join(waves.select("cell_id").distinct(), "cell_id", "left_semi")
    keys = lambda df, i="cell_id": df.select(F.col(i).alias("id"), "lat", "lon")
    joint = cells.filter("cell_id % 2 = 1").select("cell_id", (F.col("lat") + 0.25).alias("lat"), (F.col("lon") - 0.25).alias("lon"))
    found = K.nearest_of_layers(
        won,
        [
            K.Layer("current", keys(cells.filter("cell_id % 3 <> 0")), SNAP_KM["currents"]),
            K.Layer("cyclone", keys(cells.filter("cell_id % 5 <> 0")), SNAP_KM["cyclones"]),
            K.Layer("asset", keys(B.assets(spark, sf_dir), "asset_id"), SNAP_KM["assets"] + 1, K.whole_km, lambda d: d <= SNAP_KM["assets"]),
            K.Layer("joint", keys(joint), 200.0, K.block_degrees, lambda d: d < 0.75**2),
        ],
        "cell_id",
    )
    row, col = G.cell_of(F.col("lat"), F.col("lon"), -90.0, -180.0, 9.0, 20, 40)
    depth = won.select("cell_id", row.alias("r"), col.alias("c")).join(B.grid(spark, sf_dir), ["r", "c"], "left").select("cell_id", F.when(F.col("elev") < 0, -F.col("elev")).alias("depth"))
    return waves, found.join(depth, "cell_id", "left")


@query(f"WITH {_NEAR} SELECT pt_id, cell_id, km, current_id, cyclone_id, asset_id, asset_km::DOUBLE AS asset_km, joint_id, depth, cell_id IS NULL AS none FROM pts LEFT JOIN wv USING (pt_id) LEFT JOIN cu USING (cell_id) LEFT JOIN cy USING (cell_id) LEFT JOIN ast USING (cell_id) LEFT JOIN jo USING (cell_id) LEFT JOIN dp USING (cell_id)")
def layers_at(spark, sf_dir):
    """The nearest cell of each of five layers, with the depth, for every point; null where a layer has none."""
    waves, found = nearest_keys(spark, sf_dir)
    return at_sea(spark, sf_dir).select("pt_id").join(waves.join(found, "cell_id", "left"), "pt_id", "left").select("pt_id", "cell_id", "km", "current_id", "cyclone_id", "asset_id", F.col("asset_d").alias("asset_km"), "joint_id", "depth", F.col("cell_id").isNull().alias("none"))


_NAMED = (
    ("waves", "cell_id", "cell_id IS NOT NULL"),
    ("wind", "cell_id", "cell_id % 4 = 1"),
    ("depth", None, "true"),
    ("coastline", None, "true"),
    ("tidal streams", "current_id", "current_id IS NOT NULL"),
    ("background currents", "current_id", "current_id IS NOT NULL"),
    ("cyclones", "cyclone_id", "cyclone_id IS NOT NULL"),
    ("assets", "asset_id", "asset_id IS NOT NULL"),
)


@query(f"WITH found AS ({ORACLES['layers_at']}) " + " UNION ALL ".join(f"SELECT pt_id, {k}::INT AS nth, '{name}' AS layer, {key or 'NULL'}::BIGINT AS origin FROM found WHERE {shown}" for k, (name, key, shown) in enumerate(_NAMED)))
def point_sources(spark, sf_dir):
    """The sources that a point's report has to name, in order: only those of layers that reach it; cells of one of the two wave catalogues carry wind too."""
    origin = lambda key: (F.col(key) if key else F.lit(None)).cast("long")
    rows = F.array(*(F.struct(F.lit(k).alias("nth"), F.lit(name).alias("layer"), origin(key).alias("origin"), F.coalesce(F.expr(shown), F.lit(False)).alias("shown")) for k, (name, key, shown) in enumerate(_NAMED)))
    return layers_at(spark, sf_dir).select("pt_id", F.explode(F.filter(rows, lambda x: x["shown"])).alias("x")).select("pt_id", "x.nth", "x.layer", "x.origin")


def over_days(months: Column, chosen: list[int]) -> Column:
    """Mean of an array of twelve over some months, weighted by days; missing months count nowhere."""
    value = {m: F.get(months, F.lit(m)) for m in chosen}
    days = reduce(lambda a, b: a + b, (F.when(v.isNotNull(), MONTH_DAYS[m]).otherwise(0.0) for m, v in value.items()))
    return F.try_divide(reduce(lambda a, b: a + b, (F.coalesce(v * MONTH_DAYS[m], F.lit(0.0)) for m, v in value.items())), days)


def _mean_sql(code: int, name: str) -> str:
    part = lambda m: f"(CASE WHEN {Y.raw(code, m)} >= 0 THEN {Y.raw(code, m)} / 100.0::DOUBLE END)"
    top = " + ".join(f"coalesce({part(m)} * {MONTH_DAYS[m]}, 0)" for m in SUMMER)
    return f"({top}) / nullif({' + '.join(f'(CASE WHEN {part(m)} IS NOT NULL THEN {MONTH_DAYS[m]} ELSE 0 END)' for m in SUMMER)}, 0) AS {name}"


_SUMS = " + ".join(f"{Y.raw(13, m * 3 + 2)} / 100.0::DOUBLE" for m in SUMMER), " + ".join(f"{Y.raw(14, m * 3 + 2)} / 10.0::DOUBLE" for m in SUMMER)
_WIDE = f"""cud AS (SELECT cell_id AS current_id, {_mean_sql(1, 'surf50')}, {_mean_sql(3, 'bot50')}, {Y.unscaled(5, '0', 100)} AS spring FROM cells),
    cyd AS (SELECT cell_id AS cyclone_id, {_SUMS[0]} AS storms, {_SUMS[1]} AS days, ({Y.raw(17, '2')})::DOUBLE AS wmax FROM cells)"""
_PANELS = f"""o_e AS ({ORACLES['exceed_at_limit']}), o_h AS ({ORACLES['mean_hs_day_weighted']}), o_d AS ({ORACLES['prevailing_direction']}), o_m AS ({ORACLES['roughest_month']}), o_w AS ({ORACLES['wind_summary']}),
    o_p AS ({ORACLES['worst_window_month']}), o_l AS ({ORACLES['return_levels']}), o_b AS ({ORACLES['biggest_sea']}), o_s AS ({ORACLES['swell_at']}), o_q AS ({ORACLES['wind_pooled_p90']})"""


@query(
    f"""WITH {_NEAR}, {_WIDE}, {_PANELS}
    SELECT pt_id, w.cell_id, km, o_e.p AS over_limit, o_e.floor, o_h.hs AS mean, o_d.sector, o_d.share, o_d.tp, o_m.max_p99, o_m.roughest, o_w.mean AS wind_mean, o_q.q AS wind_p90, o_p.mean AS windows, o_p.worst AS worst_windows,
      o_b.season AS record_season, o_b.hs AS record, o_l.hs AS hs100, round(greatest(0, o_l.hs - 1.645 * o_l.se), 4) AS hs100_low, round(o_l.hs + 1.645 * o_l.se, 4) AS hs100_high, o_s.at_1_5 AS swell, depth, asset_id, asset_km::DOUBLE AS asset_km, joint_id,
      current_id, round(surf50, 6) AS surf50, round(bot50, 6) AS bot50, round(spring * 8.0::DOUBLE / 7, 6) AS tide, cyclone_id IS NULL AS no_cyclones, round(storms, 6) AS storms, round(days, 6) AS storm_days,
      CASE WHEN wmax < 34 THEN NULL WHEN wmax < 64 THEN 'tropical storm strength' WHEN wmax < 83 THEN 'Category 1' WHEN wmax < 96 THEN 'Category 2' WHEN wmax < 113 THEN 'Category 3' END AS category
    FROM wv w LEFT JOIN cu USING (cell_id) LEFT JOIN cy USING (cell_id) LEFT JOIN ast USING (cell_id) LEFT JOIN jo USING (cell_id) LEFT JOIN dp USING (cell_id) LEFT JOIN cud USING (current_id) LEFT JOIN cyd USING (cyclone_id)
      LEFT JOIN o_e ON o_e.cell_id = w.cell_id LEFT JOIN o_h ON o_h.cell_id = w.cell_id LEFT JOIN o_d ON o_d.cell_id = w.cell_id LEFT JOIN o_m ON o_m.cell_id = w.cell_id LEFT JOIN o_w ON o_w.cell_id = w.cell_id LEFT JOIN o_q ON o_q.cell_id = w.cell_id
      LEFT JOIN o_p ON o_p.cell_id = w.cell_id LEFT JOIN o_l ON o_l.cell_id = w.cell_id AND o_l.rp = 100 LEFT JOIN o_b ON o_b.cell_id = w.cell_id LEFT JOIN o_s ON o_s.cell_id = w.cell_id AND o_s.floor = 0"""
)
def point_full(spark, sf_dir):
    """All panels of each point that has a wave cell within 350 km.

    Points meet cells once; further layers are looked up once for each cell that won, in one join; samples are read for
    winning cells only, and wide arrays are decoded after the join.
    """
    waves, found = nearest_keys(spark, sf_dir)
    won = waves.select("cell_id").distinct()
    obs = B.obs(spark, sf_dir).join(won, "cell_id", "left_semi")
    return waves.join(cell_panels(spark, sf_dir, obs, found), "cell_id", "left")


def cell_panels(spark, sf_dir, obs: DataFrame, found: DataFrame) -> DataFrame:
    """One row a cell of found: panels of waves, wind, windows and extremes from its samples, of currents and cyclones from their wide rows."""
    # small tables (a row a winning cell, and a month of it), written so that what follows is planned apart
    months = kept(R.climatology(obs, swells=SWELL_T), "climatology")
    ahead = R.swell_over(R.headline(months, SUMMER, H), SUMMER, 1.5, SWELL_T)
    periods = P.worst_month(R.monthly_periods(months, H, 2, P.periods), "cell_id").select("cell_id", r(F.col("mean")).alias("windows"), F.col("worst").alias("worst_windows"))
    waves = ahead.select("cell_id", "floor", "sector", *(r(F.col(c), 4).alias(c) for c in ("over_limit", "share", "swell")), *(r(F.col(c)).alias(c) for c in ("mean", "tp"))).join(periods, "cell_id")
    probs = {"q0": 0.1, "q1": 0.5, "q2": 0.9, "q3": 0.99}
    both = obs.select("cell_id", "m", F.explode(F.array(F.struct(F.lit("hs").alias("of"), F.col("hs").alias("x")), F.struct(F.lit("wind").alias("of"), F.col("wind").alias("x")))).alias("v")).select("cell_id", "m", "v.*")
    ranks = kept(quantiles(both, ["cell_id", "m", "of"], "x", probs, mean="mean"), "quantiles")
    p99 = R.extremes_summary(ranks.filter("of = 'hs'").select("cell_id", "m", F.col("q3").alias("p99")), SUMMER).select("cell_id", r(F.col("max_p99")).alias("max_p99"), "roughest")
    wind = R.selected(ranks.filter("of = 'wind'"), SUMMER)
    pooled = R.pooled_quantile(wind.select("cell_id", "m", F.array(*probs).alias("q"), F.array(*map(F.lit, probs.values())).alias("qp")), SUMMER, 0.9)
    means = wind.groupBy("cell_id").agg(r(R.weighted(F.col("mean"), R.month_days(F.col("m")))).alias("wind_mean"))
    maxima = M.annual_maxima(obs, B.cells(spark, sf_dir))
    low, high = M.confidence(r(F.col("hs")), r(F.col("se")))
    levels = M.return_levels(maxima, (100,)).select("cell_id", r(F.col("hs")).alias("hs100"), r(low, 4).alias("hs100_low"), r(high, 4).alias("hs100_high"))
    record = M.record(maxima).select("cell_id", F.col("season").alias("record_season"), F.col("hs").alias("record"))
    own = reduce(lambda a, b: a.join(b, "cell_id", "left"), (p99, means, pooled.select("cell_id", r(F.col("q")).alias("wind_p90")), levels, record), waves)
    return decoded_layers(spark, sf_dir, found).join(own, "cell_id", "left")


def decoded_layers(spark, sf_dir, found: DataFrame) -> DataFrame:
    """found with what its currents and cyclones say, decoded for the rows that won."""
    code = {**Y.current_wire(), "ts": Y.tide_wire()["ts"]}
    currents = B.cells(spark, sf_dir).select(F.col("cell_id").alias("id"), *(code[f].alias(f) for f in ("s5", "b5", "ts")))
    cyclones = B.cells(spark, sf_dir).select(F.col("cell_id").alias("id"), Y.wire(13, 36).alias("s"), Y.wire(14, 36).alias("d"), Y.wire(17, 3).alias("w"))
    wide = K.fetched(K.fetched(found, "current", currents), "cyclone", cyclones).crossJoin(F.broadcast(Y.manifest(spark, sf_dir)))
    wide = wide.withColumns({f: N.nested(f) for f in ("s5", "b5", "s", "d")})
    storms, days = (reduce(lambda a, b: a + b, (F.get(F.get(f, F.lit(m)), F.lit(len(Y.RADII) - 1)) for m in SUMMER)) for f in ("s", "d"))
    spring = N.tide({"ts": F.col("ts")})[0]
    return wide.select(
        "cell_id", "depth", "asset_id", F.col("asset_d").alias("asset_km"), "joint_id", "current_id", r(over_days(F.col("s5"), SUMMER)).alias("surf50"), r(over_days(F.col("b5"), SUMMER)).alias("bot50"), r(E.near_bed(spring, F.lit(None).cast("double"))[0]).alias("tide"),
        F.col("cyclone_id").isNull().alias("no_cyclones"), r(storms).alias("storms"), r(days).alias("storm_days"), X.storm_category(F.get("w", F.lit(len(Y.RADII) - 1))).alias("category"),
    )
