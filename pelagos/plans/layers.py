"""Queries on tiles as a source, nested layouts read by their manifest, and outlines made from delta codes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.operators import environment as E
from pelagos.operators import spatial as S
from pelagos.plans.registry import CELLS, POINTS, query
from pelagos.sources import bindings as B
from pelagos.sources import catalogue as C
from pelagos.sources import nested as N
from pelagos.sources import tile_source as T
from pelagos.sources.shared import shared_folder


def r(col, digits: int = 6):
    return F.round(col, digits)


# ---- fields on the wire, made from the suppliers: a number for each field tells them apart


def wire(code: int, length) -> F.Column:
    k = F.col("cell_id")
    return F.transform(F.sequence(F.lit(0), F.lit(length) - 1), lambda i: F.when((k + i + code) % 7 == 0, -1).otherwise((k * (code + 3) + i * 5) % 97).cast("int"))


def raw(code: int, i: str) -> str:
    return f"(CASE WHEN (cell_id + {i} + {code}) % 7 = 0 THEN -1 ELSE (cell_id * {code + 3} + {i} * 5) % 97 END)"


def unscaled(code: int, i: str, scale: float) -> str:
    return f"CASE WHEN {raw(code, i)} >= 0 THEN {raw(code, i)} / {scale}::DOUBLE END"


RADII, LIMITS, EDGES, PERIODS, QUANTILES = (50.0, 100.0, 200.0), (1.0, 2.0), (6, 12, 24), 5, (0.1, 0.5, 0.9, 0.99)


def manifest(spark, sf_dir) -> DataFrame:
    """One row: the manifest that the wire's sizes come from, read from the table of regions."""
    text = F.to_json(
        F.struct(
            F.lit(1).alias("format"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0) + F.col("r_regionkey")).alias("thresholds"), F.array(*map(F.lit, RADII)).alias("radii_nm"), F.array(*map(F.lit, QUANTILES)).alias("wind_q"),
            F.struct(F.array(*map(F.lit, LIMITS)).alias("thresholds"), F.array(*map(F.lit, EDGES)).alias("edges_h")).alias("persist"), F.struct(F.lit(2.0).alias("t0"), F.lit(2.0).alias("step"), F.lit(PERIODS).alias("nb")).alias("tp_hist"),
        )
    )
    rows = C.manifest(B.read(spark, sf_dir, "region").filter("r_regionkey = 0").select(text.alias("txt")), "txt")
    return rows.select(F.struct(*rows.columns).alias("mf"))


def with_manifest(spark, sf_dir, **fields) -> DataFrame:
    """Cells (cell_id, fields.., mf): the manifest is one row."""
    return B.cells(spark, sf_dir).select("cell_id", *(c.alias(name) for name, c in fields.items())).crossJoin(F.broadcast(manifest(spark, sf_dir)))


def current_wire() -> dict:
    return {"s5": wire(1, 12), "s9": wire(2, 12), "b5": wire(3, 12), "b9": wire(4, 12)}


@query(f"WITH {CELLS} SELECT cell_id, m::INT AS m, {unscaled(1, 'm', 100)} AS surf50, {unscaled(2, 'm', 100)} AS surf90, {unscaled(3, 'm', 100)} AS bot50, {unscaled(4, 'm', 100)} AS bot90 FROM cells, range(12) g(m)")
def current_months(spark, sf_dir):
    rows = with_manifest(spark, sf_dir, **current_wire()).select("cell_id", *(N.nested(f).alias(f) for f in ("s5", "s9", "b5", "b9")))
    return rows.select("cell_id", F.posexplode(F.arrays_zip("s5", "s9", "b5", "b9")).alias("m", "z")).select("cell_id", "m", F.col("z.s5").alias("surf50"), F.col("z.s9").alias("surf90"), F.col("z.b5").alias("bot50"), F.col("z.b9").alias("bot90"))


def tide_wire() -> dict:
    one = lambda code: F.get(wire(code, 1), F.lit(0))
    return {"ts": one(5), "tn": one(6), "tf": one(7), "tb": one(8), "s25": one(9) * 20, "s50": one(10) * 20, "ns": one(11), "bd": one(12)}


_SLACK = lambda code: f"CASE WHEN {raw(code, '0')} >= 0 AND {raw(code, '0')} * 20 < 999 THEN ({raw(code, '0')} * 20)::DOUBLE END"
_TIDE_SQL = f"{unscaled(5, '0', 100)} AS spring, {unscaled(6, '0', 100)} AS neap, {unscaled(7, '0', 100)} AS form, {unscaled(8, '0', 1)} AS bearing, {_SLACK(9)} AS slack25, {_SLACK(10)} AS slack50, {unscaled(11, '0', 10)} AS per_day, {unscaled(12, '0', 1)} AS bot_depth"


@query(f"WITH {CELLS} SELECT cell_id, {_TIDE_SQL} FROM cells")
def current_tide(spark, sf_dir):
    """The tide of each cell: streams, form, bearing, slack times (999 minutes or more stand for none), turns a day."""
    return B.cells(spark, sf_dir).select("cell_id", *N.tide(tide_wire()))


@query(f"WITH {CELLS} SELECT cell_id, m::INT AS month, x::INT AS radius, {raw(13, '(m * 3 + x)')} / 100.0::DOUBLE AS storms, {raw(14, '(m * 3 + x)')} / 10.0::DOUBLE AS days FROM cells, range(12) g(m), range(3) h(x)")
def cyclone_months(spark, sf_dir):
    rows = with_manifest(spark, sf_dir, s=wire(13, 36), d=wire(14, 36))
    return N.long(rows, "s", ("cell_id",), value="storms").join(N.long(rows, "d", ("cell_id",), value="days"), ["cell_id", "month", "radius"])


@query(f"WITH {CELLS} SELECT cell_id, m::INT AS month, x::INT AS radius, p::INT AS phase, {unscaled(15, '(m * 9 + x * 3 + p)', 10)} AS days FROM cells, range(12) g(m), range(3) h(x), range(3) i(p) WHERE cell_id % 9 <> 0")
def cyclone_phases(spark, sf_dir):
    """Days by month, radius and phase, of cells whose array has the length that the radii ask for."""
    k = F.col("cell_id")
    return N.long(with_manifest(spark, sf_dir, pd=wire(15, F.when(k % 9 == 0, 107).otherwise(108))), "pd", ("cell_id",), value="days")


@query(f"WITH {CELLS} SELECT cell_id, x::INT AS radius, {unscaled(16, 'x', 100)} AS storms_all, ({raw(17, 'x')})::DOUBLE AS wmax FROM cells, range(3) h(x)")
def cyclone_year(spark, sf_dir):
    rows = with_manifest(spark, sf_dir, sa=wire(16, 3), w=wire(17, 3))
    return N.long(rows, "sa", ("cell_id",), value="storms_all").join(N.long(rows, "w", ("cell_id",), value="wmax"), ["cell_id", "radius"])


@query(f'WITH {CELLS} SELECT cell_id, m::INT AS month, l::INT AS "limit", b::INT AS bin, CASE WHEN {raw(18, "(m * 8)")} >= 0 THEN {raw(18, "(m * 8 + l * 4 + b)")} / 10.0::DOUBLE END AS runs FROM cells, range(12) g(m), range(2) h(l), range(4) i(b) WHERE cell_id % 4 <> 0')
def window_runs(spark, sf_dir):
    """Runs by month, limit and duration; a month whose first number is missing is missing as a whole; arrays of another length are absent."""
    k = F.col("cell_id")
    return N.long(with_manifest(spark, sf_dir, pw=wire(18, F.when(k % 4 == 0, 95).otherwise(96))), "pw", ("cell_id",), value="runs")


@query(f"WITH {CELLS} SELECT cell_id, m::INT AS month, p::INT AS period, CASE WHEN {raw(19, '(m * 5)')} >= 0 THEN {raw(19, '(m * 5 + p)')} / 10.0::DOUBLE END AS pct FROM cells, range(12) g(m), range(5) h(p)")
def period_table(spark, sf_dir):
    return N.long(with_manifest(spark, sf_dir, th=wire(19, 60)), "th", ("cell_id",), value="pct")


@query(f"WITH {CELLS} SELECT cell_id, m::INT AS month, q::INT AS quantile, CASE WHEN {raw(20, '(m * 4)')} >= 0 THEN {raw(20, '(m * 4 + q)')} / 10.0::DOUBLE END AS wind FROM cells, range(12) g(m), range(4) h(q)")
def wind_quantiles(spark, sf_dir):
    return N.long(with_manifest(spark, sf_dir, wq=wire(20, 48)), "wq", ("cell_id",), value="wind")


@query(f"WITH {CELLS} SELECT cell_id, m::INT AS month, p::INT AS phase, t::INT AS threshold, {unscaled(21, '(m * 9 + p * 3 + t)', 10)} AS exc FROM cells, range(12) g(m), range(3) h(p), range(3) i(t)")
def phase_exceedance(spark, sf_dir):
    return N.long(with_manifest(spark, sf_dir, pe=wire(21, 108)), "pe", ("cell_id",), value="exc")


# ---- the tables of currents

_DEPTH_SQL = "CASE WHEN cell_id % 4 <> 0 THEN (cell_id * 31 % 3000)::DOUBLE END"
_COMMA = "regexp_replace(floor(({x}) + 0.5)::BIGINT::VARCHAR, '(\\d)(\\d{{3}})$', '\\1,\\2')"


@query(
    f"""WITH {CELLS}, x AS (SELECT cell_id, {_DEPTH_SQL} AS depth, {unscaled(1, '5', 100)} AS surf50, {unscaled(2, '5', 100)} AS surf90, {unscaled(3, '5', 100)} AS bot50, {unscaled(4, '5', 100)} AS bot90, {unscaled(12, '0', 1)} * 20 AS bd FROM cells)
    SELECT cell_id, 0 AS place, 'Surface' AS label, surf50 AS typical, surf90 AS top FROM x WHERE surf50 IS NOT NULL
    UNION ALL SELECT cell_id, 1, CASE WHEN coalesce(depth > bd * 1.25, false) THEN 'At ' || {_COMMA.format(x='bd')} || ' m (deepest model level)' ELSE 'Near seabed (~' || {_COMMA.format(x='bd')} || ' m)' END, bot50, bot90 FROM x WHERE bot50 IS NOT NULL AND bd >= 1"""
)
def background_rows(spark, sf_dir):
    """Background currents of June: the deepest level is the bed's unless the water is deeper by a quarter of it."""
    k = F.col("cell_id")
    june = {name: F.get(N.nested(f), F.lit(5)).alias(name) for name, f in (("surf50", "s5"), ("surf90", "s9"), ("bot50", "b5"), ("bot90", "b9"))}
    rows = with_manifest(spark, sf_dir, **current_wire(), **tide_wire()).select("cell_id", F.when(k % 4 != 0, (k * 31 % 3000).cast("double")).alias("depth"), *june.values(), (N.tide({"bd": F.col("bd")})[-1] * 20).alias("bot_depth"))
    return E.background_table(rows)


@query(
    f"""WITH {CELLS}, x AS (SELECT cell_id, {_DEPTH_SQL} AS depth, {unscaled(5, '0', 100)} AS spring, {unscaled(6, '0', 100)} AS neap FROM cells), y AS (SELECT *, 8.0::DOUBLE / 7 AS s, CASE WHEN depth > 2 THEN 8.0::DOUBLE / 7 * pow(1 / depth, 1.0::DOUBLE / 7) END AS f FROM x WHERE spring IS NOT NULL)
    SELECT cell_id, 0 AS place, 'Surface' AS label, round(spring * s, 6) AS springs, round(neap * s, 6) AS neaps, NULL::VARCHAR AS note FROM y
    UNION ALL SELECT cell_id, 1, CASE WHEN f IS NULL THEN 'Near seabed' ELSE 'Near seabed (~' || {_COMMA.format(x='depth')} || ' m)' END, round(spring * f, 6), round(neap * f, 6), CASE WHEN f IS NULL THEN 'about 2/3 of surface' END FROM y"""
)
def tide_rows(spark, sf_dir):
    k = F.col("cell_id")
    rows = B.cells(spark, sf_dir).select("cell_id", F.when(k % 4 != 0, (k * 31 % 3000).cast("double")).alias("depth"), *N.tide(tide_wire()))
    return E.tide_table(rows).withColumns({c: r(F.col(c)) for c in ("springs", "neaps")})


# ---- tiles as a source

_STEP = 30
_TILE_SQL = f"'t_' || (floor((lat + 90) / {_STEP}) * {_STEP} - 90)::INT || '_' || (floor((lon + 180) / {_STEP}) * {_STEP} - 180)::INT"
_BOX = (-40.0, 35.0, -100.0, 80.0)


def _listed() -> list[str]:
    """The manifest's tiles: three in four, and one that no file was written for."""
    every = [(a, o) for a in range(-90, 90, _STEP) for o in range(-180, 180, _STEP)]
    return [f"t_{a}_{o}" for k, (a, o) in enumerate(every) if k % 4 != 1] + ["t_0_900"]


@query(
    f"""WITH {CELLS}, t AS (SELECT cell_id, {_TILE_SQL} AS tile, floor((lat + 90) / {_STEP})::INT AS a, floor((lon + 180) / {_STEP})::INT AS o, lat, lon FROM cells)
    SELECT tile, lat, lon, m::INT AS month, {unscaled(22, 'm', 10)} AS mean FROM t, range(12) g(m)
    WHERE (a * {360 // _STEP} + o) % 4 <> 1 AND a * {_STEP} - 90 <= {_BOX[1]} AND a * {_STEP} - 90 + {_STEP} > {_BOX[0]} AND o * {_STEP} - 180 <= {_BOX[3]} AND o * {_STEP} - 180 + {_STEP} > {_BOX[2]}"""
)
def tiles_in_box(spark, sf_dir):
    """Tiles written from the cells and read through the source: those that the manifest lists and that touch a box."""
    path = shared_folder(spark, "tiles")
    write_tiles(spark, B.cells(spark, sf_dir).withColumn("mean", wire(22, 12)), path)
    read = spark.read.format("marine_tiles").options(tiles=json.dumps(_listed()), box=",".join(map(str, _BOX)), step=_STEP).load(path)
    return N.long(read.crossJoin(F.broadcast(manifest(spark, sf_dir))), "mean", ("tile", "lat", "lon"), value="mean")


@query(f"WITH {CELLS}, t AS (SELECT cell_id, {_TILE_SQL} AS tile FROM cells) SELECT tile, count(*)::BIGINT AS cells FROM t WHERE tile IN ('t_0_0', 't_-30_60', 't_30_-120') GROUP BY tile")
def tiles_by_name(spark, sf_dir):
    """A filter on names is pushed to the list of files."""
    path = shared_folder(spark, "tiles")
    write_tiles(spark, B.cells(spark, sf_dir).withColumn("mean", wire(22, 12)), path)
    return spark.read.format("marine_tiles").load(path).filter(F.col("tile").isin("t_0_0", "t_-30_60", "t_30_-120")).groupBy("tile").agg(F.count("*").alias("cells"))


def write_tiles(spark, cells: DataFrame, path: str, step: int = _STEP) -> None:
    """Cells (lat, lon, mean) as one JSON file a tile, their order that of latitude and longitude; a tile holds at most its grid's cells."""
    T.register(spark)
    origin = lambda x, low: (F.floor((F.col(x) + low) / step) * step - low).cast("int").cast("string")
    named = cells.withColumn("tile", F.concat_ws("_", F.lit("t"), origin("lat", 90), origin("lon", 180)))
    held = named.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("lat", "lon", "mean"))).alias("c"))
    body = F.to_json(F.struct(F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"), F.col("c.mean").alias("mean")))
    held.select("tile", body.alias("body")).write.format("marine_tiles").mode("append").save(path)


# ---- outlines from delta codes

#: Steps of a ring's sides, in hundredths of a degree; the first vertex is where the ring begins.
SIDES = ((100, 0), (70, 70), (0, 100), (-70, 70), (-100, 0), (-70, -70), (0, -100))
_DELTA = f"""deltas AS (SELECT g, (ARRAY[200, 1000, 2000])[g % 3 + 1]::INT AS level, g::INT AS ring, seq::INT AS seq,
    CASE WHEN seq = 0 THEN g * 7919 % 34000 - 17000 ELSE (ARRAY[{', '.join(str(x) for x, _ in SIDES)}])[seq] * (2 + g % 9) END AS dx, CASE WHEN seq = 0 THEN g * 5471 % 15000 - 7500 ELSE (ARRAY[{', '.join(str(y) for _, y in SIDES)}])[seq] * (2 + g % 9) END AS dy
    FROM (SELECT p_partkey // 8 AS g, p_partkey % 8 AS seq FROM part QUALIFY count(*) OVER (PARTITION BY p_partkey // 8) = 8)),
    verts AS (SELECT level, ring, seq, sum(dx) OVER w / 100.0::DOUBLE AS x, sum(dy) OVER w / 100.0::DOUBLE AS y FROM deltas WINDOW w AS (PARTITION BY ring ORDER BY seq))"""
_RING_EDGES = f"{_DELTA}, edges AS (SELECT level, ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM verts WINDOW w AS (PARTITION BY ring ORDER BY seq))"


def outlines(spark, sf_dir) -> DataFrame:
    """(level, ring, seq, x, y) of the rings that the parts give: eight vertices each."""
    k, seq = F.floor(F.col("p_partkey") / 8).cast("int"), (F.col("p_partkey") % 8).cast("int")
    side = lambda n: F.element_at(F.array(F.lit(0), *(F.lit(s[n]) for s in SIDES)), F.col("seq") + 1) * (2 + F.col("ring") % 9)
    rows = B.read(spark, sf_dir, "part").select(k.alias("ring"), seq.alias("seq"))
    whole = rows.join(rows.groupBy("ring").count().filter("count = 8").select("ring"), "ring", "left_semi")
    ring = F.col("ring").cast("long")
    steps = whole.select(
        F.element_at(F.array(F.lit(200), F.lit(1000), F.lit(2000)), F.col("ring") % 3 + 1).alias("level"), "ring", "seq",
        F.when(F.col("seq") == 0, ring * 7919 % 34000 - 17000).otherwise(side(0)).alias("dx"), F.when(F.col("seq") == 0, ring * 5471 % 15000 - 7500).otherwise(side(1)).alias("dy"),
    )
    return S.rings(steps)


@query(f"WITH {_DELTA} SELECT level, ring, count(*)::BIGINT AS points, round(min(x), 6) AS west, round(min(y), 6) AS south, round(max(x), 6) AS east, round(max(y), 6) AS north FROM verts GROUP BY level, ring")
def ring_levels(spark, sf_dir):
    return S.ring_boxes(outlines(spark, sf_dir)).withColumns({c: r(F.col(c)) for c in ("west", "south", "east", "north")})


@query(
    f"""WITH {POINTS}, {_RING_EDGES}, inside AS (SELECT pt_id, level FROM points JOIN edges ON ((y1 <= lat AND y2 > lat) OR (y2 <= lat AND y1 > lat)) AND x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon GROUP BY pt_id, level HAVING count(*) % 2 = 1)
    SELECT pt_id, CASE max(level) WHEN 200 THEN '200 m to 1,000 m' WHEN 1000 THEN '1,000 m to 2,000 m' WHEN 2000 THEN 'deeper than 2,000 m' ELSE 'under 200 m' END AS band FROM points LEFT JOIN inside USING (pt_id) GROUP BY pt_id"""
)
def depth_band_rings(spark, sf_dir):
    """Depth bands by outlines of a table, met by bands of latitude."""
    points = B.points(spark, sf_dir)
    return S.depth_band(points, S.crossings(points, S.edges(outlines(spark, sf_dir))), [200, 1000, 2000])
