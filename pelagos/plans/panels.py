"""Queries behind panels and charts: axes, labels, choices of the view, and lookups of tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.functions import text as X
from pelagos.functions.constants import KNOTS_PER_MS
from pelagos.operators import panels as V
from pelagos.operators import raster as G
from pelagos.plans.places import _contour_sql
from pelagos.plans.registry import ASSETS, CELLS, GRID, OBS, POINTS, SEQ, TRACKS, query
from pelagos.plans.texts import _fixed, r
from pelagos.sources import bindings as B
from pelagos.streaming import sink

_PEAK = f"{OBS}, peak AS (SELECT cell_id, 100.0::DOUBLE * max(n) / sum(n) AS top FROM (SELECT cell_id, tp_bin, count(*) AS n FROM obs GROUP BY ALL) GROUP BY cell_id)"


def _peak(spark, sf_dir):
    counts = B.obs(spark, sf_dir).groupBy("cell_id", "tp_bin").agg(F.count("*").alias("n"))
    return counts.groupBy("cell_id").agg((F.lit(100.0) * F.max("n") / F.sum("n")).alias("top"))


def _first_sql(caps: tuple, target: str) -> str:
    return "CASE " + " ".join(f"WHEN {c}::DOUBLE >= {target} THEN {c}::DOUBLE" for c in caps) + f" ELSE {caps[-1]}::DOUBLE END"


def _cap_sql(x: str, caps: tuple, factor: float) -> str:
    return "CASE " + " ".join(f"WHEN {c}::DOUBLE >= {x} * {factor}::DOUBLE THEN {c}::DOUBLE" for c in caps) + f" ELSE {caps[-1]}::DOUBLE END"


@query(f"WITH {_PEAK} SELECT cell_id, {_cap_sql('top', V.PERIOD_CAPS, 1.08)} AS period_axis, {_cap_sql('top', V.ROSE_CAPS, 1.05)} AS rose_axis, {_cap_sql('top / 10', V.STORM_CAPS, 1.06)} AS storm_axis FROM peak")
def percent_axes(spark, sf_dir):
    top = F.col("top")
    return _peak(spark, sf_dir).select("cell_id", V.axis(top, V.PERIOD_CAPS, 1.08).alias("period_axis"), V.axis(top, V.ROSE_CAPS, 1.05).alias("rose_axis"), V.axis(top / 10, V.STORM_CAPS, 1.06).alias("storm_axis"))


@query(
    f"""WITH {_PEAK}, t AS (SELECT cell_id, top * 3 AS top, CASE WHEN cell_id % 2 = 0 THEN greatest(top * 3, cell_id * 1.5::DOUBLE) ELSE top * 3 * 1.06::DOUBLE END AS target FROM peak)
    SELECT cell_id, CASE {" ".join(f"WHEN {c} >= target THEN {c}::DOUBLE" for c in V.WINDOW_CAPS)} ELSE ceil(1.1::DOUBLE * target) END AS axis FROM t"""
)
def windows_axis(spark, sf_dir):
    most = F.when(F.col("cell_id") % 2 == 0, F.col("cell_id") * 1.5)
    return _peak(spark, sf_dir).select("cell_id", V.windows_axis(F.col("top") * 3, most).alias("axis"))


@query(
    f"""WITH {OBS}, mm AS (SELECT cell_id, m, avg(tp_bin) AS v FROM obs GROUP BY cell_id, m), x AS (SELECT cell_id, greatest(0, floor(min(v) - 1)) AS low, ceil(max(v) + 1) AS high FROM mm GROUP BY cell_id)
    SELECT cell_id, low, CASE WHEN high - low < 4 THEN low + 4 ELSE high END AS high FROM x"""
)
def period_range(spark, sf_dir):
    months = B.obs(spark, sf_dir).groupBy("cell_id", "m").agg(F.avg("tp_bin").alias("v"))
    return V.period_range(months, "cell_id", "v")


_SPEED = f"{OBS}, s AS (SELECT cell_id, m, round(avg(wind), 6) AS v FROM obs GROUP BY cell_id, m)"


@query(f"WITH {_SPEED} SELECT cell_id, m, regexp_replace({_fixed('v', 2)}, '0$', '') || ' m/s (' || {_fixed(f'(v * {KNOTS_PER_MS}::DOUBLE)', 1)} || ' kn)' AS txt FROM s")
def fmt_speed(spark, sf_dir):
    return B.obs(spark, sf_dir).groupBy("cell_id", "m").agg(r(F.avg("wind")).alias("v")).select("cell_id", "m", X.speed(F.col("v")).alias("txt"))


@query(f"WITH h AS (SELECT p_partkey AS id, p_size * 0.125::DOUBLE AS h FROM part) SELECT id, h, CASE WHEN h * 2 = floor(h * 2) THEN {_fixed('h', 1)} ELSE {_fixed('h', 2)} END AS txt FROM h")
def fmt_height(spark, sf_dir):
    heights = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * F.lit(0.125)).alias("h"))
    return heights.select("id", "h", X.height(F.col("h")).alias("txt"))


@query(
    f"""WITH {POINTS}, d AS (SELECT pt_id, pt_id * pt_id / 977.0::DOUBLE AS km FROM points), x AS (SELECT *, km / 1.852::DOUBLE AS nm FROM d)
    SELECT pt_id, CASE WHEN km < 1 THEN {_fixed('(km * 1000)', 0)} || ' m  ·  ' || {_fixed('nm', 2)} || ' nm' WHEN km < 100 THEN {_fixed('km', 2)} || ' km  ·  ' || {_fixed('nm', 2)} || ' nm'
      ELSE format('{{:,}}', floor(km + 0.5)::BIGINT) || ' km  ·  ' || format('{{:,}}', floor(nm + 0.5)::BIGINT) || ' nm' END AS txt FROM x"""
)
def fmt_measure(spark, sf_dir):
    return B.points(spark, sf_dir).select("pt_id", X.distance(F.col("pt_id") * F.col("pt_id") / 977.0).alias("txt"))


_LIFE = f"{TRACKS}, life AS (SELECT track_id, min(y) AS y, max(w) AS w, CASE track_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NOT_NAMED' WHEN 2 THEN 'Ada ' || min(y) ELSE 'Bo' END AS n FROM tracks GROUP BY track_id)"


@query(
    f"""WITH {_LIFE}, c AS (SELECT *, CASE WHEN n IS NULL OR upper(n) = 'NOT_NAMED' OR n = '' THEN 'Unnamed storm' ELSE n END AS name,
      CASE WHEN w < 34 THEN NULL WHEN w < 64 THEN 'tropical storm strength' WHEN w < 83 THEN 'Category 1' WHEN w < 96 THEN 'Category 2' WHEN w < 113 THEN 'Category 3' WHEN w < 137 THEN 'Category 4' ELSE 'Category 5' END AS cat FROM life)
    SELECT track_id, name, concat_ws(' · ', CASE WHEN contains(name, y::VARCHAR) THEN 'season ' || y ELSE y::VARCHAR END, cat) AS detail,
      CASE WHEN w > 0 THEN 'Peak ' || {_fixed('w', 0)} || ' kt (' || {_fixed('(w * 1.852::DOUBLE)', 0)} || ' km/h) over its life' ELSE '' END AS peak FROM c"""
)
def track_tip(spark, sf_dir):
    life = B.tracks(spark, sf_dir).groupBy("track_id").agg(F.min("y").alias("y"), F.max("w").alias("w"))
    kind = F.col("track_id") % 4
    named = life.withColumn("n", F.when(kind == 1, "NOT_NAMED").when(kind == 2, F.concat(F.lit("Ada "), F.col("y").cast("string"))).when(kind == 3, "Bo"))
    return named.select("track_id", *V.track_tip(F.col("n"), F.col("y"), F.col("w")))


_AT6 = f"{OBS}, p AS (SELECT cell_id, round(100.0::DOUBLE * count(*) FILTER (WHERE hs > 9) / count(*), 6) AS p, cell_id % 3 = 0 AS floor FROM obs GROUP BY cell_id)"


@query(
    f"""WITH {_AT6}, t AS (SELECT cell_id, floor, CASE WHEN p < 0.05 THEN '<0.1%' WHEN p < 10 THEN {_fixed('p', 1)} || '%' ELSE {_fixed('p', 0)} || '%' END AS s FROM p)
    SELECT cell_id, replace(CASE WHEN floor AND s[1] <> '<' THEN '<' || s ELSE s END, '<', '< ') AS txt FROM t"""
)
def fmt_limit_pct(spark, sf_dir):
    p = r(F.lit(100.0) * F.count_if(F.col("hs") > 9) / F.count("*"))
    return B.obs(spark, sf_dir).groupBy("cell_id").agg(p.alias("p")).select("cell_id", V.limit_percent(F.col("p"), F.col("cell_id") % 3 == 0).alias("txt"))


@query("SELECT DISTINCT (hour(ts) // 3)::INT AS slot, lpad(((hour(ts) // 3) * 3)::VARCHAR, 2, '0') || ':00' AS txt FROM events")
def slot_label(spark, sf_dir):
    return B.seq(spark, sf_dir).select("slot").distinct().select("slot", V.slot_label(F.col("slot")).alias("txt"))


@query(f"WITH {ASSETS} SELECT coalesce(bool_or(t = 'well'), false) AS wells, coalesce(bool_or(t = 'lng terminal'), false) AS lng FROM assets")
def asset_kinds(spark, sf_dir):
    return V.has_kinds(B.assets(spark, sf_dir), "t", {"wells": "well", "lng": "lng terminal"})


@query(f"WITH {POINTS}, s AS (SELECT pt_id, 1.0::DOUBLE + pt_id % 500 AS scale FROM points) SELECT pt_id, coalesce((SELECT min(v) FROM (VALUES {', '.join(f'({v}::DOUBLE)' for v in V.GRATICULE)}) g(v) WHERE v * scale >= 55), 30.0) AS step FROM s")
def graticule_step(spark, sf_dir):
    return B.points(spark, sf_dir).select("pt_id", V.graticule_step(F.lit(1.0) + F.col("pt_id") % 500).alias("step"))


@query(
    f"""WITH {POINTS}, {GRID}, at_ AS (SELECT pt_id, floor((lat + 60) / 5 + 0.5)::INT AS r, floor((lon + 90) / 5 + 0.5)::INT AS c FROM points)
    SELECT pt_id, elev FROM at_ JOIN grid USING (r, c) WHERE r BETWEEN 0 AND 11 AND c BETWEEN 0 AND 39"""
)
def grid_read(spark, sf_dir):
    return V.grid_read(B.points(spark, sf_dir), B.grid(spark, sf_dir), -60.0, -90.0, 5.0, 12, 40).select("pt_id", "elev")


@query(f"WITH {CELLS} SELECT cell_id, CASE WHEN cell_id % 3 = 0 THEN [50.0, 100.0, 150.0][CASE WHEN cell_id % 5 = 0 THEN 3 ELSE least(cell_id % 5, 3) END]::DOUBLE ELSE 1000.0 END AS nm FROM cells")
def track_radius(spark, sf_dir):
    radii = F.when(F.col("cell_id") % 3 == 0, F.array(F.lit(50.0), F.lit(100.0), F.lit(150.0)))
    chosen = F.when(F.col("cell_id") % 5 != 0, (F.col("cell_id") % 5 - 1).cast("int"))
    return B.cells(spark, sf_dir).select("cell_id", V.track_radius(radii, chosen).alias("nm"))


@query(
    f"""WITH {CELLS}, b AS (SELECT cell_id, lat AS lat0, lat + 7.5 AS lat1, lon AS lon0, lon + 12 AS lon1 FROM cells)
    SELECT DISTINCT cell_id, 'd_' || (a * 5) || '_' || ((((o * 5 + 180) % 360) + 360) % 360 - 180) AS tile FROM b, range(-18, 24) t(a), range(-36, 60) u(o)
    WHERE a * 5 BETWEEN floor(lat0 / 5) * 5 AND lat1 AND o * 5 BETWEEN floor(lon0 / 5) * 5 AND lon1 AND (a + o) % 3 <> 0"""
)
def tiles_of_box(spark, sf_dir):
    """Of the tiles that there are: here two in three."""
    boxes = B.cells(spark, sf_dir).select("cell_id", F.col("lat").alias("lat0"), (F.col("lat") + 7.5).alias("lat1"), F.col("lon").alias("lon0"), (F.col("lon") + 12).alias("lon1"))
    found = V.tiles_of_box(boxes, 5, "cell_id")
    return found.filter((F.col("la") / 5 + F.col("lo") / 5) % 3 != 0).select("cell_id", "tile").distinct()


@query(
    f"""WITH {POINTS}, {CELLS}, k AS (SELECT pt_id, floor(lat + 89.25 + 0.5) - 89.25 AS la, CASE WHEN floor(lon + 179.75 + 0.5) - 179.75 < -179.75 THEN 179.25 ELSE floor(lon + 179.75 + 0.5) - 179.75 END AS lo FROM points),
    j AS (SELECT cell_id, lat - 0.25 AS la, lon + 0.5 AS lo FROM cells),
    d AS (SELECT pt_id, cell_id, (j.la - k.la) * (j.la - k.la) + (j.lo - k.lo) * (j.lo - k.lo) AS d FROM k JOIN j ON abs(j.la - k.la) < 1 AND abs(j.lo - k.lo) < 1)
    SELECT pt_id, arg_min(cell_id, (d, cell_id)) AS cell_id FROM d WHERE d < 0.5625 GROUP BY pt_id"""
)
def nearest_joint(spark, sf_dir):
    joint = B.cells(spark, sf_dir).select("cell_id", (F.col("lat") - 0.25).alias("lat"), (F.col("lon") + 0.5).alias("lon"))
    return V.nearest_joint(B.points(spark, sf_dir), joint)


@query(f"WITH {POINTS} SELECT pt_id FROM points WHERE lat BETWEEN -20 AND 35 AND lon BETWEEN -60 AND 75")
def view_box(spark, sf_dir):
    return V.in_view(B.points(spark, sf_dir), -20.0, 35.0, -60.0, 75.0).select("pt_id")


@query(f"WITH {POINTS}, p AS (SELECT pt_id, 1.7::DOUBLE + pt_id % 74 / 10.0::DOUBLE AS min_zoom FROM points), z AS (SELECT log2(40.0::DOUBLE * 360 / 256) + 1 AS z) SELECT pt_id FROM p, z WHERE min_zoom <= z + 0.8::DOUBLE * greatest(0, z - 6)")
def places_at_zoom(spark, sf_dir):
    places = B.points(spark, sf_dir).select("pt_id", (F.lit(1.7) + F.col("pt_id") % 74 / 10.0).alias("min_zoom"))
    return V.places_at_zoom(places, 40.0).select("pt_id")


@query(f"WITH {ASSETS} SELECT asset_id, o || CASE WHEN contains(o, '?') THEN '&' ELSE '?' END || 'utm_source=site&utm_medium=referral&utm_content=' || t AS link FROM (SELECT asset_id, t, CASE WHEN asset_id % 2 = 0 THEN o || '?a=1' ELSE o END AS o FROM assets)")
def campaign_link(spark, sf_dir):
    base = F.when(F.col("asset_id") % 2 == 0, F.concat("o", F.lit("?a=1"))).otherwise(F.col("o"))
    return B.assets(spark, sf_dir).select("asset_id", X.campaign_link(base, F.col("t"), "referral", "site").alias("link"))


@query(
    f"""WITH {_PEAK}, x AS (SELECT cell_id, top, cell_id % 3 = 0 AS pct, CASE WHEN cell_id % 4 = 0 THEN (cell_id % 40)::DOUBLE END AS most FROM peak)
    SELECT cell_id, CASE WHEN most > 0 THEN {_first_sql(V.WINDOW_CAPS, 'greatest(most, top)')} WHEN pct THEN {_first_sql(V.SHARE_CAPS, 'top * 1.06::DOUBLE')} ELSE {_first_sql(V.COUNT_CAPS, 'top * 1.06::DOUBLE')} END AS axis FROM x"""
)
def report_axis(spark, sf_dir):
    k = F.col("cell_id")
    return _peak(spark, sf_dir).select("cell_id", V.report_axis(F.col("top"), k % 3 == 0, F.when(k % 4 == 0, (k % 40).cast("double"))).alias("axis"))


_LINES = "ln AS (SELECT p_partkey AS line_id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Pipeline' WHEN 2 THEN '' ELSE p_name END AS n, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS o, CASE WHEN p_partkey % 5 <> 0 THEN lower(trim(p_type)) ELSE '' END AS s, CASE WHEN p_partkey % 7 = 0 THEN 'NO' END AS c FROM part)"


@query(
    f"""WITH {_LINES}, x AS (SELECT *, coalesce(n <> '' AND lower(n) <> 'pipeline', false) AS named, concat_ws(' · ', CASE WHEN coalesce(n <> '' AND lower(n) <> 'pipeline', false) THEN nullif(o, '') END, nullif(s, ''), nullif(c, '')) AS bits FROM ln)
    SELECT line_id, CASE WHEN named THEN n ELSE coalesce(nullif(o, ''), 'Pipeline') END AS head, CASE WHEN bits = '' THEN 'Pipeline' ELSE 'Pipeline, ' || bits END AS detail, CASE WHEN NOT named AND nullif(o, '') IS NULL AND nullif(s, '') IS NULL THEN 'No further detail in the register' ELSE '' END AS note FROM x"""
)
def line_tip(spark, sf_dir):
    k = F.col("p_partkey")
    rows = B.read(spark, sf_dir, "part").select(
        k.alias("line_id"), F.when(k % 4 == 0, None).when(k % 4 == 1, "Pipeline").when(k % 4 == 2, "").otherwise(F.col("p_name")).alias("n"), F.when(k % 3 != 0, F.col("p_brand")).alias("o"), F.when(k % 5 != 0, F.lower(F.trim("p_type"))).otherwise("").alias("s"), F.when(k % 7 == 0, "NO").alias("c")
    )
    return rows.select("line_id", *V.line_tip(F.col("n"), F.col("o"), F.col("s"), F.col("c")))


@query(f"WITH {SEQ}, s AS (SELECT site, slot, avg(hs) AS hs FROM seq GROUP BY site, slot) SELECT site, h::INT AS hour, round(hs, 6) AS hs FROM s, LATERAL (SELECT unnest(CASE WHEN slot = 0 THEN [0, 24] ELSE [slot * 3] END) AS h) WHERE hs IS NOT NULL")
def day_cycle(spark, sf_dir):
    return V.day_cycle(B.seq(spark, sf_dir).groupBy("site", "slot").agg(F.avg("hs").alias("hs")), "site").withColumn("hs", F.round("hs", 6))


# ---- contours of many views: those that share a key share its contours

_VIEWS = "vw AS (SELECT c_custkey AS view_id, 8 + c_custkey % 20 * 0.6::DOUBLE AS lat0, 9 + c_custkey % 20 * 0.6::DOUBLE + c_custkey % 3 AS lat1, -6 + c_custkey % 14 * 0.7::DOUBLE AS lon0, -4 + c_custkey % 14 * 0.7::DOUBLE + c_custkey % 4 AS lon1, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 10 * 150)::DOUBLE END AS depth FROM customer)"
_LADDER_SQL = "CASE " + " ".join(f"WHEN coalesce(depth, 3000) <= {b} THEN [{', '.join(f'{x}::DOUBLE' for x in of)}]" for b, of in V.LADDERS) + " END"
_ALL_LEVELS = sorted({float(x) for _, of in V.LADDERS for x in of})


@query(
    f"""WITH {_contour_sql(', '.join(f'({x}::DOUBLE)' for x in _ALL_LEVELS))}, {_VIEWS}, sg AS (SELECT level, (floor((10 + r * 0.25) / 5) * 5)::INT AS la, (floor((-5 + c * 0.25) / 5) * 5)::INT AS lo FROM y),
    k AS (SELECT view_id, floor(lat0 * 4) / 4 AS s, ceil(lat1 * 4) / 4 AS n, floor(lon0 * 4) / 4 AS w, ceil(lon1 * 4) / 4 AS e, {_LADDER_SQL} AS levels FROM vw),
    tl AS (SELECT view_id, levels, a * 5 AS la, o * 5 AS lo FROM k, range(-1, 12) u(a), range(-6, 12) v(o) WHERE a * 5 BETWEEN floor(s / 5) * 5 AND n AND o * 5 BETWEEN floor(w / 5) * 5 AND e AND (a + o) % 4 <> 1)
    SELECT view_id, level, count(*)::BIGINT AS segments FROM tl JOIN sg USING (la, lo) WHERE list_contains(levels, level) GROUP BY view_id, level"""
)
def view_contours(spark, sf_dir):
    k = F.col("c_custkey")
    views = B.read(spark, sf_dir, "customer").select(
        k.alias("view_id"), (8 + k % 20 * F.lit(0.6)).alias("lat0"), (9 + k % 20 * F.lit(0.6) + k % 3).alias("lat1"), (-6 + k % 14 * F.lit(0.7)).alias("lon0"), (-4 + k % 14 * F.lit(0.7) + k % 4).alias("lon1"), F.when(k % 5 != 0, (k % 10 * 150).cast("double")).alias("depth")
    )
    every = spark.range(13 * 18).select((F.floor(F.col("id") / 18).cast("int") - 1).alias("a"), ((F.col("id") % 18).cast("int") - 6).alias("o")).filter("(a + o) % 4 <> 1")
    there = every.select(F.concat_ws("_", F.lit("d"), (F.col("a") * 5).cast("string"), (F.col("o") * 5).cast("string")).alias("tile"))
    origin = lambda x: (F.floor(x / 5) * 5).cast("int").cast("string")
    segments = G.contour_segments(B.grid(spark, sf_dir), _ALL_LEVELS, 10.0, -5.0, 0.25).select("level", F.concat_ws("_", F.lit("d"), origin(10 + F.col("r") * 0.25), origin(-5 + F.col("c") * 0.25)).alias("tile"))
    keyed, found = V.contours_of_views(views, there, segments, "view_id", 5, 40)
    return keyed.join(found.groupBy("key", "level").agg(F.count("*").alias("segments")), "key").select("view_id", "level", "segments")


# ---- events as lines


@query(
    """WITH x AS (SELECT event_id, event_type, value, CASE WHEN event_id % 3 = 0 THEN 'loc:bass strait' ELSE 'home' END AS p, CASE WHEN event_id % 4 = 0 THEN 'direct' ELSE 'search & more' END AS s FROM events)
    SELECT event_id, 'e=' || url_encode(event_type) || '&p=' || url_encode(p) || '&s=' || url_encode(s) || CASE WHEN event_id % 5 = 0 THEN '&t=1' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN '&h=' || url_encode(event_type || '=' || (event_id % 7)) ELSE '' END AS line FROM x"""
)
def event_lines(spark, sf_dir):
    k = F.col("event_id")
    page, source = F.when(k % 3 == 0, "loc:bass strait").otherwise("home"), F.when(k % 4 == 0, "direct").otherwise("search & more")
    extra = {"h": F.when(k % 2 == 0, F.concat(F.col("event_type"), F.lit("="), (k % 7).cast("string"))), "none": F.lit(None).cast("string")}
    return B.read(spark, sf_dir, "events").select("event_id", sink.event_line(F.col("event_type"), page, source, k % 5 == 0, extra).alias("line"))
