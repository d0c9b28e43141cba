"""Queries on places: nearest cells, tiles, polygons, rasters, contours, tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.functions.constants import RULER_KM
from pelagos.operators import lookup as K
from pelagos.operators import polyline as L
from pelagos.operators import raster as G
from pelagos.operators import rollup as R
from pelagos.operators import spatial as S
from pelagos.plans.registry import ASSETS, CELLS, DAYS, GRID, OBS, POINTS, TRACKS, query
from pelagos.sources import bindings as B


def r(col, digits: int = 6):
    return F.round(col, digits)


def _hav(a: str, b: str, c: str, d: str, radius: float = 6371.0) -> str:
    return f"2 * {radius} * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_NEAR = f"{POINTS}, {CELLS}, near AS (SELECT pt_id, cell_id, round({_hav('p.lat', 'p.lon', 'c.lat', 'c.lon')}, 6) AS km FROM points p, cells c)"


@query(f"WITH {_NEAR} SELECT pt_id, arg_min(cell_id, (km, cell_id)) AS cell_id, min(km) AS km FROM near WHERE km <= 2500 GROUP BY pt_id")
def nearest_cell(spark, sf_dir):
    return S.nearest_in_rounds(B.points(spark, sf_dir), B.cells(spark, sf_dir), (600.0, 2500.0))


@query(f"WITH {_NEAR}, b AS (SELECT pt_id, arg_min(cell_id, (km, cell_id)) AS cell_id, min(km) AS km FROM near WHERE km <= 350 GROUP BY pt_id) SELECT pt_id, cell_id, km, km IS NULL AS none FROM points LEFT JOIN b USING (pt_id)")
def nearest_cell_snap(spark, sf_dir):
    return S.nearest_or_none(B.points(spark, sf_dir), B.cells(spark, sf_dir), 350.0)


@query(f"WITH {CELLS}, {ASSETS}, n AS (SELECT cell_id, asset_id, floor({_hav('c.lat', 'c.lon', 'a.lat', 'a.lon')} + 0.5) AS km FROM cells c, assets a) SELECT cell_id, arg_min(asset_id, (km, asset_id)) AS asset_id, min(km)::DOUBLE AS km FROM n WHERE km <= 400 GROUP BY cell_id")
def nearest_asset(spark, sf_dir):
    """Distances are rounded to whole kilometres before they are held against the radius."""
    return S.nearest(B.cells(spark, sf_dir), B.assets(spark, sf_dir), 400.0, point_id="cell_id", cell_id="asset_id", measure=K.whole_km, reach=401.0).select("cell_id", "asset_id", "km")


@query(f"WITH {POINTS} SELECT pt_id, floor(lat + 89.25 + 0.5) - 89.25 AS block_lat, CASE WHEN floor(lon + 179.75 + 0.5) - 179.75 < -179.75 THEN 179.25 ELSE floor(lon + 179.75 + 0.5) - 179.75 END AS block_lon FROM points")
def nearest_joint_block(spark, sf_dir):
    lat, lon = geo.joint_block(F.col("lat"), F.col("lon"))
    return B.points(spark, sf_dir).select("pt_id", lat.alias("block_lat"), lon.alias("block_lon"))


@query(f"WITH {POINTS} SELECT pt_id, 't_' || (floor((lat + 90) / 10) * 10 - 90)::INT || '_' || (floor((lon + 180) / 10) * 10 - 180)::INT AS tile, 'd_' || (floor(lat / 7) * 7)::INT || '_' || (floor(lon / 7) * 7)::INT AS depth_tile FROM points")
def tile_id(spark, sf_dir):
    depth = F.concat_ws("_", F.lit("d"), geo.tile_origin(F.col("lat"), 7, 0).cast("int").cast("string"), geo.tile_origin(F.col("lon"), 7, 0).cast("int").cast("string"))
    return B.points(spark, sf_dir).select("pt_id", geo.tile_id("t", F.col("lat"), F.col("lon"), 10).alias("tile"), depth.alias("depth_tile"))


_REACH = "CASE WHEN least(abs(lat) + 350 / 111.0::DOUBLE, 90) > 89 THEN 180.0 ELSE least(180.0, 350 / 111.0::DOUBLE / cos(radians(least(abs(lat) + 350 / 111.0::DOUBLE, 90)))) END"
_CAND = f"""{POINTS}, e AS (SELECT pt_id, lat, lon, {_REACH} AS reach FROM points),
    ti AS (SELECT pt_id, unnest(range(floor((greatest(lat - 350 / 111.0::DOUBLE, -90) + 90) / 10)::INT, floor((least(lat + 350 / 111.0::DOUBLE, 90) + 90) / 10)::INT + 1))::INT AS ti FROM e),
    tj AS (SELECT DISTINCT pt_id, ((unnest(range(floor((lon - reach + 180) / 10)::INT, least(floor((lon + reach + 180) / 10)::INT, floor((lon - reach + 180) / 10)::INT + 35) + 1)) % 36 + 36) % 36)::INT AS tj FROM e),
    cand AS (SELECT pt_id, ti, tj FROM ti JOIN tj USING (pt_id))"""
_HELD = f"{CELLS}, held AS (SELECT DISTINCT floor((lat + 90) / 10)::INT AS ti, (floor((lon + 180) / 10)::INT % 36)::INT AS tj FROM cells)"


def _candidates(spark, sf_dir):
    return S.candidate_tiles(B.points(spark, sf_dir), 350.0, 10.0).select("pt_id", "ti", "tj")


@query(f"WITH {_CAND} SELECT pt_id, ti, tj FROM cand")
def tile_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(f"WITH {_CAND}, {_HELD} SELECT pt_id, ti, tj FROM cand SEMI JOIN held USING (ti, tj)")
def tile_semi(spark, sf_dir):
    return _candidates(spark, sf_dir).join(S.in_tiles(B.cells(spark, sf_dir), 10.0).select("ti", "tj").distinct(), ["ti", "tj"], "left_semi").select("pt_id", "ti", "tj")


@query(f"WITH {_CAND} SELECT c.pt_id, ti, tj FROM cand c JOIN points p USING (pt_id) WHERE NOT (ti = floor((lat + 90) / 10)::INT AND tj = (floor((lon + 180) / 10)::INT % 36))")
def tile_anti(spark, sf_dir):
    return _candidates(spark, sf_dir).join(S.in_tiles(B.points(spark, sf_dir), 10.0).select("pt_id", "ti", "tj"), ["pt_id", "ti", "tj"], "left_anti").select("pt_id", "ti", "tj")


#: Outlines for the tests: nested rings of two levels, one with a hole, and an island.
RINGS = [(200, 1, [(-100.0, -60.0), (120.0, -50.0), (140.0, 55.0), (10.0, 70.0), (-110.0, 40.0)]), (1000, 2, [(-60.0, -40.0), (80.0, -30.0), (60.0, 45.0), (-50.0, 30.0)]), (1000, 3, [(-10.0, -10.0), (20.0, -5.0), (5.0, 20.0)]), (2000, 4, [(-30.0, -20.0), (-12.0, -20.0), (-12.0, 10.0), (-30.0, 12.0)])]
_RING_ROWS = [(lv, k, seq, x, y) for lv, k, pts in RINGS for seq, (x, y) in enumerate(pts)]
_EDGES = (
    "rings(level, ring, seq, x, y) AS (VALUES " + ", ".join(f"({a}, {b}, {c}, {d}::DOUBLE, {e}::DOUBLE)" for a, b, c, d, e in _RING_ROWS) + "), "
    "edges AS (SELECT a.level, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM rings a JOIN rings b ON a.ring = b.ring AND b.seq = (a.seq + 1) % (SELECT count(*) FROM rings z WHERE z.ring = a.ring))"
)
_INSIDE = f"""{POINTS}, {_EDGES}, inside AS (SELECT pt_id, level FROM points JOIN edges ON ((y1 <= lat AND y2 > lat) OR (y2 <= lat AND y1 > lat)) AND x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon GROUP BY pt_id, level HAVING count(*) % 2 = 1)"""


def _edges(spark):
    return S.edges(spark.createDataFrame(_RING_ROWS, "level int, ring int, seq int, x double, y double"))


@query(f"WITH {_INSIDE} SELECT pt_id, level FROM inside")
def point_in_polygon(spark, sf_dir):
    return S.crossings(B.points(spark, sf_dir), _edges(spark))


@query(f"WITH {_INSIDE} SELECT pt_id, CASE max(level) WHEN 200 THEN '200 m to 1,000 m' WHEN 1000 THEN '1,000 m to 2,000 m' WHEN 2000 THEN 'deeper than 2,000 m' ELSE 'under 200 m' END AS band FROM points LEFT JOIN inside USING (pt_id) GROUP BY pt_id")
def depth_band(spark, sf_dir):
    points = B.points(spark, sf_dir)
    return S.depth_band(points, S.crossings(points, _edges(spark)), [200, 1000, 2000])


_MASK = f"""{_EDGES}, hits AS (SELECT i, x1 + (i - 89.5 - y1) / (y2 - y1) * (x2 - x1) AS x FROM range(180) t(i) JOIN edges ON level = 200 AND ((y1 <= i - 89.5 AND y2 > i - 89.5) OR (y2 <= i - 89.5 AND y1 > i - 89.5))),
    pr AS (SELECT i, x, lead(x) OVER (PARTITION BY i ORDER BY x) AS e, row_number() OVER (PARTITION BY i ORDER BY x) AS k FROM hits),
    mask AS (SELECT DISTINCT i::INT AS i, j::INT AS j FROM pr, range(360) g(j) WHERE k % 2 = 1 AND e IS NOT NULL AND j >= ceil(x + 179.5 - 1e-9) AND j <= floor(e + 179.5 + 1e-9))"""


def _mask(spark):
    return S.land_mask(_edges(spark).filter("level = 200"), spark.range(180).select(F.col("id").cast("int").alias("i")))


@query(f"WITH {_MASK} SELECT i, j FROM mask")
def land_mask(spark, sf_dir):
    return _mask(spark)


@query(
    f"""WITH {POINTS}, {_MASK}, p AS (SELECT pt_id, lat, lon, greatest(0, least(179, floor(lat + 90)))::INT AS pi, greatest(0, least(359, floor(lon + 180)))::INT AS pj FROM points),
    o AS (SELECT pt_id, lat, lon, (pi + di)::INT AS i, ((pj + dj + 360) % 360)::INT AS j, greatest(abs(di), abs(dj)) AS ring FROM p, range(-40, 41) a(di), range(-40, 41) b(dj) WHERE pi + di BETWEEN 0 AND 179),
    sea AS (SELECT * FROM o ANTI JOIN mask USING (i, j)), f AS (SELECT *, min(ring) OVER (PARTITION BY pt_id) AS first FROM sea),
    d AS (SELECT pt_id, i, j, round({_hav('lat', 'lon', '(i - 89.5)', '(j - 179.5)')}, 6) AS km FROM f WHERE ring <= least(40, first + (first > 0)::INT))
    SELECT pt_id, arg_min(i, (km, i, j)) AS i, arg_min(j, (km, i, j)) AS j, min(km) AS km FROM d GROUP BY pt_id"""
)
def nearest_ocean(spark, sf_dir):
    return S.nearest_ocean(B.points(spark, sf_dir), _mask(spark))


def _place(spark, sf_dir):
    row, col = G.cell_of(F.col("lat"), F.col("lon"), -90.0, -180.0, 9.0, 20, 40)
    return B.points(spark, sf_dir).select("pt_id", row.alias("r"), col.alias("c"))


_AT = f"{POINTS}, {GRID}, at_cell AS (SELECT pt_id, greatest(0, least(19, floor((lat + 90) / 9)))::INT AS r, greatest(0, least(39, floor((lon + 180) / 9)))::INT AS c FROM points), dep AS (SELECT pt_id, CASE WHEN elev < 0 THEN -elev END AS depth FROM at_cell LEFT JOIN grid USING (r, c))"


def _depths(spark, sf_dir):
    return _place(spark, sf_dir).join(B.grid(spark, sf_dir), ["r", "c"], "left").select("pt_id", F.when(F.col("elev") < 0, -F.col("elev")).alias("depth"))


@query(f"WITH {_AT} SELECT pt_id, depth FROM dep")
def depth_at_point(spark, sf_dir):
    return _depths(spark, sf_dir)


LADDER = [(100, 20), (400, 100), (800, 200)]


@query(f"WITH {_AT} SELECT pt_id, CASE WHEN depth <= 100 THEN 20 WHEN depth <= 400 THEN 100 ELSE 200 END AS step FROM dep WHERE depth IS NOT NULL")
def depth_ladder(spark, sf_dir):
    step = F.lit(LADDER[-1][1])
    for bound, by in reversed(LADDER[:-1]):
        step = F.when(F.col("depth") <= bound, by).otherwise(step)
    return _depths(spark, sf_dir).filter("depth IS NOT NULL").select("pt_id", step.alias("step"))


@query(
    f"""WITH {_AT}, {CELLS}, near AS (SELECT pt_id, cell_id, round({_hav('p.lat', 'p.lon', 'c.lat', 'c.lon')}, 6) AS km FROM points p, cells c),
    b AS (SELECT pt_id, arg_min(cell_id, (km, cell_id)) AS cell_id, min(km) AS km FROM near WHERE km <= 350 GROUP BY pt_id)
    SELECT pt_id, depth, cell_id, km, CASE WHEN km IS NULL THEN 'No data cell within range of that point.' END AS problem FROM points LEFT JOIN dep USING (pt_id) LEFT JOIN b USING (pt_id)"""
)
def optional_enrichment(spark, sf_dir):
    points = B.points(spark, sf_dir)
    found = points.select("pt_id").join(_depths(spark, sf_dir), "pt_id", "left").join(S.nearest(points, B.cells(spark, sf_dir), 350.0), "pt_id", "left")
    return found.withColumn("problem", F.when(F.col("km").isNull(), "No data cell within range of that point."))


@query(f"WITH {POINTS} SELECT pt_id, round({_hav('lat', 'lon', '51.5', '0.0')}, 6) AS km, round({_hav('lat', 'lon', '51.5', '0.0', RULER_KM)}, 6) AS ruler_km, round({_hav('lat', 'lon', '51.5', '0.0', RULER_KM)} / 1.852, 6) AS nm FROM points")
def geo_distance(spark, sf_dir):
    at = (F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(0.0))
    ruler = geo.haversine_km(*at, radius=RULER_KM)
    return B.points(spark, sf_dir).select("pt_id", r(geo.haversine_km(*at)).alias("km"), r(ruler).alias("ruler_km"), r(geo.nautical(ruler)).alias("nm"))


@query(
    f"""WITH {POINTS} SELECT pt_id, round((degrees(atan2(sin(radians(0.0 - lon)) * cos(radians(51.5)), cos(radians(lat)) * sin(radians(51.5)) - sin(radians(lat)) * cos(radians(51.5)) * cos(radians(0.0 - lon)))) + 360) % 360, 6) AS bearing FROM points"""
)
def geo_bearing(spark, sf_dir):
    return B.points(spark, sf_dir).select("pt_id", r(geo.bearing(F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(0.0))).alias("bearing"))


@query(f"WITH {POINTS} SELECT pt_id, (((lon * 3 + 180) % 360) + 360) % 360 - 180 AS lon3 FROM points")
def wrap_lon(spark, sf_dir):
    return B.points(spark, sf_dir).select("pt_id", geo.wrap_lon(F.col("lon") * 3).alias("lon3"))


@query(f"WITH {POINTS}, y AS (SELECT pt_id, degrees(ln(tan(pi() / 4 + radians(greatest(-85.05113, least(85.05113, lat))) / 2))) AS y FROM points) SELECT pt_id, round(y, 6) AS y, round(degrees(2 * atan(exp(radians(y))) - pi() / 2), 6) AS lat_back FROM y")
def mercator(spark, sf_dir):
    y = geo.merc_y(F.col("lat"))
    return B.points(spark, sf_dir).select("pt_id", r(y).alias("y"), r(geo.merc_lat(y)).alias("lat_back"))


@query(
    f"""WITH {POINTS}, t AS (SELECT pt_id, lon, lat, greatest(0.0, least(1.0, ((lon + 50) * 100 + (lat + 20) * 60) / (100 * 100 + 60 * 60.0::DOUBLE))) AS t FROM points)
    SELECT pt_id, round(pow(lon + 50 - t * 100, 2) + pow(lat + 20 - t * 60, 2), 6) AS d2 FROM t"""
)
def segment_distance(spark, sf_dir):
    ends = [F.lit(v) for v in (-50.0, -20.0, 50.0, 40.0)]
    return B.points(spark, sf_dir).select("pt_id", r(geo.segment_distance2(F.col("lon"), F.col("lat"), *ends)).alias("d2"))


_FIELD = f"{OBS}, {DAYS}, mm AS (SELECT (cell_id // 12)::INT AS r, (cell_id % 12)::INT AS c, m, avg(hs) AS v FROM obs GROUP BY ALL), heat AS (SELECT r, c, sum(w * v) / sum(w) AS v FROM mm JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY r, c)"


def _field(spark, sf_dir):
    rows = B.obs(spark, sf_dir).groupBy(F.expr("CAST(cell_id DIV 12 AS INT)").alias("r"), F.expr("CAST(cell_id % 12 AS INT)").alias("c"), "m").agg(F.avg("hs").alias("v"))
    return G.field(rows, [5, 6, 7])


@query(f"WITH {_FIELD} SELECT r, c, round(v, 6) AS v FROM heat")
def heat_field(spark, sf_dir):
    return _field(spark, sf_dir).withColumn("v", r(F.col("v")))


def _fill_sql(source: str, name: str) -> str:
    return f"{name} AS (SELECT a.r, a.c, coalesce(any_value(a.v), avg(b.v)) AS v FROM {source} a LEFT JOIN {source} b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND ((b.c - a.c + 12) % 12) IN (0, 1, 11) AND (b.r <> a.r OR b.c <> a.c) GROUP BY a.r, a.c)"


@query(f"WITH {_FIELD}, g0 AS (SELECT r, c, CASE WHEN (r * 12 + c) % 3 = 0 OR c BETWEEN 4 AND 7 THEN NULL ELSE v END AS v FROM heat), {_fill_sql('g0', 'g1')}, {_fill_sql('g1', 'g2')}, {_fill_sql('g2', 'g3')} SELECT r, c, round(v, 6) AS v FROM g3")
def heat_fill(spark, sf_dir):
    holes = _field(spark, sf_dir).withColumn("v", F.when(((F.col("r") * 12 + F.col("c")) % 3 == 0) | F.col("c").between(4, 7), None).otherwise(F.col("v")))
    return G.fill(holes, 12).withColumn("v", r(F.col("v")))


def _contour_sql(levels: str, where: str = "true") -> str:
    return f"""{GRID}, sq AS (SELECT a.r, a.c, a.elev AS sw, b.elev AS se, d.elev AS ne, e.elev AS nw FROM grid a JOIN grid b ON b.r = a.r AND b.c = a.c + 1 JOIN grid d ON d.r = a.r + 1 AND d.c = a.c + 1 JOIN grid e ON e.r = a.r + 1 AND e.c = a.c
      WHERE a.elev IS NOT NULL AND b.elev IS NOT NULL AND d.elev IS NOT NULL AND e.elev IS NOT NULL AND {where}),
    s AS (SELECT *, -level AS tg, 10.0 + (r + 0.5::DOUBLE) * 0.25 AS la, -5.0 + (c + 0.5::DOUBLE) * 0.25 AS lo FROM sq, (VALUES {levels}) v(level)),
    x AS (SELECT *, CASE WHEN (sw < tg) <> (se < tg) THEN [la, lo + (tg - sw) / (se - sw) * 0.25] END AS bot, CASE WHEN (nw < tg) <> (ne < tg) THEN [la + 0.25, lo + (tg - nw) / (ne - nw) * 0.25] END AS top,
      CASE WHEN (sw < tg) <> (nw < tg) THEN [la + (tg - sw) / (nw - sw) * 0.25, lo] END AS lft, CASE WHEN (se < tg) <> (ne < tg) THEN [la + (tg - se) / (ne - se) * 0.25, lo + 0.25] END AS rgt FROM s),
    y AS (SELECT level, r, c, 0 AS part, CASE WHEN bot IS NOT NULL AND top IS NOT NULL AND lft IS NOT NULL THEN [lft, bot] ELSE list_filter([bot, top, lft, rgt], lambda z: z IS NOT NULL) END AS e FROM x WHERE coalesce(bot, top, lft, rgt) IS NOT NULL
      UNION ALL SELECT level, r, c, 1, [rgt, top] FROM x WHERE bot IS NOT NULL AND top IS NOT NULL AND lft IS NOT NULL)"""


_SEGMENTS = "SELECT level, r, c, part::INT AS part, round(e[1][1], 6) AS lat1, round(e[1][2], 6) AS lon1, round(e[2][1], 6) AS lat2, round(e[2][2], 6) AS lon2 FROM y"


def _contours(raster, levels):
    return G.contour_segments(raster, levels, 10.0, -5.0, 0.25).withColumns({k: r(F.col(k)) for k in ("lat1", "lon1", "lat2", "lon2")})


@query(f"WITH {_contour_sql('(400.0::DOUBLE)', 'a.c % 20 < 19')} {_SEGMENTS}")
def contour_segments(spark, sf_dir):
    """Within tiles of 20 columns: the squares between tiles are left to contour_with_seams."""
    return _contours(B.grid(spark, sf_dir), [400.0]).filter("c % 20 < 19")


@query(f"WITH {_contour_sql('(400.0::DOUBLE)')} {_SEGMENTS}")
def contour_with_seams(spark, sf_dir):
    """In long form neighbours meet whichever tile they are from: seams need no strips of their own."""
    return _contours(B.grid(spark, sf_dir), [400.0])


@query(f"WITH {_contour_sql('(200.0::DOUBLE), (400.0), (600.0), (5000.0)')} SELECT level, count(*)::BIGINT AS segments FROM y GROUP BY level")
def contour_levels(spark, sf_dir):
    return G.contour_segments(B.grid(spark, sf_dir), [200.0, 400.0, 600.0, 5000.0], 10.0, -5.0, 0.25).groupBy("level").agg(F.count("*").alias("segments"))


_DEC = f"{TRACKS}, dec AS (SELECT track_id, ts, seq, y, w, sum(dlat) OVER (PARTITION BY track_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS lat, sum(dlon) OVER (PARTITION BY track_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS lon FROM tracks)"
_PIECES = f"""{_DEC}, wr AS (SELECT * REPLACE (((lon + 180) % 360 + 360) % 360 - 180 AS lon) FROM dec), j AS (SELECT *, CASE WHEN abs(lon - lag(lon) OVER (PARTITION BY track_id ORDER BY ts, seq)) > 180 THEN 1 ELSE 0 END AS jump FROM wr),
    pc AS (SELECT *, (sum(jump) OVER (PARTITION BY track_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::INT AS piece FROM j), pieces AS (SELECT * FROM pc QUALIFY count(*) OVER (PARTITION BY track_id, piece) >= 2)"""


def _decoded(spark, sf_dir, scale=1.0):
    return L.decode(B.tracks(spark, sf_dir), scale=scale)


@query(f"WITH {_DEC} SELECT track_id, seq, round(lat / 100, 6) AS lat, round(lon / 100, 6) AS lon FROM dec")
def delta_decode(spark, sf_dir):
    return _decoded(spark, sf_dir, 100.0).select("track_id", "seq", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"))


@query(f"WITH {_PIECES} SELECT track_id, seq, piece, lon FROM pieces")
def antimeridian_split(spark, sf_dir):
    return L.pieces(_decoded(spark, sf_dir)).select("track_id", "seq", "piece", "lon")


@query(f"WITH {_PIECES} SELECT track_id, piece, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e, count(*)::BIGINT AS points FROM pieces GROUP BY track_id, piece")
def polyline_bbox(spark, sf_dir):
    return L.boxes(L.pieces(_decoded(spark, sf_dir)), "track_id", "piece")


@query(
    f"""WITH {_DEC}, nm AS (SELECT *, floor(lat * 100 + 0.5)::BIGINT || ',' || floor(lon * 100 + 0.5)::BIGINT AS here FROM dec),
    st AS (SELECT here, lag(here) OVER w AS there, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM nm WINDOW w AS (PARTITION BY track_id ORDER BY ts, seq))
    SELECT least(here, there) AS a, greatest(here, there) AS b, count(*)::BIGINT AS n,
      count(*) > 1 OR bool_or(abs(lon - lo) > 180 OR (abs(lon) >= 179.99 AND abs(lo) >= 179.99) OR (abs(lat) >= 89.9 AND abs(la) >= 89.9) OR pow(lat - la, 2) + pow(lon - lo, 2) > 16) AS cut
    FROM st WHERE there IS NOT NULL GROUP BY ALL"""
)
def edge_multiplicity(spark, sf_dir):
    return L.edge_counts(_decoded(spark, sf_dir))


_FLAT = "60 * sqrt(pow(lat - (12.0), 2) + pow((((lon - (40.0) + 180) % 360 + 360) % 360 - 180) * cos(radians(12.0)), 2))"


@query(f"WITH {_DEC}, nr AS (SELECT track_id, min({_FLAT}) AS nm FROM dec GROUP BY track_id) SELECT track_id, round(nm, 6) AS nm FROM nr WHERE nm <= 1000")
def track_near(spark, sf_dir):
    return L.nearest_approach(_decoded(spark, sf_dir), 12.0, 40.0).filter("nm <= 1000").withColumn("nm", r(F.col("nm")))


@query(f"WITH {_DEC}, t AS (SELECT track_id, min(y) AS y0, max(y) AS y1, max(w) AS w, min({_FLAT}) AS nm, count(*) AS k FROM dec GROUP BY track_id) SELECT track_id, y0, y1, w >= 96 AS major FROM t WHERE y1 >= 1996 AND y0 <= 1998 AND w >= 64 AND nm <= 2000 AND k >= 2")
def track_filter(spark, sf_dir):
    """Named years, a peak of at least 64 kt, near a place, two points or more; storms of 96 kt count as major."""
    near = L.nearest_approach(_decoded(spark, sf_dir), 12.0, 40.0)
    tracks = B.tracks(spark, sf_dir).groupBy("track_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("w").alias("w"), F.count("*").alias("k"))
    kept = tracks.join(near, "track_id").filter("y1 >= 1996 AND y0 <= 1998 AND w >= 64 AND nm <= 2000 AND k >= 2")
    return kept.select("track_id", "y0", "y1", (F.col("w") >= 96).alias("major"))


@query(f"WITH {TRACKS} SELECT min(y) AS first, max(y) AS last FROM tracks")
def track_year_range(spark, sf_dir):
    return B.tracks(spark, sf_dir).agg(F.min("y").alias("first"), F.max("y").alias("last"))
