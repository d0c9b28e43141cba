"""Queries on texts, choices, assets, currents, cyclones, daylight and fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import numeric as N
from pelagos.functions import text as X
from pelagos.functions.constants import COMPASS, MONTH_NAMES
from pelagos.functions.position import ERRORS, read_positions
from pelagos.operators import display as D
from pelagos.operators import environment as E
from pelagos.operators import panels as V
from pelagos.operators import rollup as R
from pelagos.operators.quantile import quantiles
from pelagos.plans.registry import ASSETS, CELLS, DAYS, EXC, OBS, POINTS, SEQ, THR, TRACKS, query
from pelagos.sources import bindings as B
from pelagos.sources import demo, tiles


def r(col, digits: int = 6):
    return F.round(col, digits)


def _fixed(x: str, digits: int) -> str:
    n = f"floor(abs({x}) * {10**digits} + 0.5)::BIGINT"
    sign = f"CASE WHEN {x} < 0 AND {n} > 0 THEN '-' ELSE '' END"
    return f"({sign} || ({n} // {10**digits})" + (f" || '.' || lpad(({n} % {10**digits})::VARCHAR, {digits}, '0'))" if digits else ")")


_SHARE = f"{OBS}, x AS (SELECT cell_id, m, round(100.0::DOUBLE * count(*) FILTER (WHERE hs > 6) / count(*) / 4, 6) AS p FROM obs GROUP BY cell_id, m)"


def _share(spark, sf_dir):
    return B.obs(spark, sf_dir).groupBy("cell_id", "m").agg(r(F.lit(100.0) * F.count_if(F.col("hs") > 6) / F.count("*") / 4).alias("p"))


@query(f"WITH {_SHARE}, z AS (SELECT cell_id, m, CASE WHEN m = 5 THEN NULL ELSE p END AS p FROM x) SELECT cell_id, m, CASE WHEN p IS NULL THEN 'no data' WHEN p < 0.05 THEN '<0.1%' WHEN p < 10 THEN {_fixed('p', 1)} || '%' ELSE {_fixed('p', 0)} || '%' END AS txt FROM z")
def fmt_pct(spark, sf_dir):
    return _share(spark, sf_dir).select("cell_id", "m", X.percent(F.when(F.col("m") != 5, F.col("p"))).alias("txt"))


@query(f"WITH {_SHARE}, z AS (SELECT cell_id, m, p, p * 0.3044::DOUBLE AS d FROM x) SELECT cell_id, m, CASE WHEN p > 0 AND d < 0.05 THEN 'under 0.1' WHEN d < 3 THEN {_fixed('d', 1)} ELSE {_fixed('d', 0)} END AS txt FROM z")
def fmt_days(spark, sf_dir):
    return _share(spark, sf_dir).select("cell_id", "m", X.days_a_month(F.col("p")).alias("txt"))


@query(f"WITH {POINTS} SELECT pt_id, {_fixed('abs(lat)', 2)} || '° ' || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || ', ' || {_fixed('abs(lon)', 2)} || '° ' || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END AS txt FROM points")
def fmt_latlon(spark, sf_dir):
    return B.points(spark, sf_dir).select("pt_id", X.lat_lon(F.col("lat"), F.col("lon")).alias("txt"))


def _ddm(v: str, pos: str, neg: str) -> str:
    t = f"floor((abs({v}) - floor(abs({v}))) * 60000 + 0.5)::BIGINT"
    return f"((floor(abs({v}))::BIGINT + CASE WHEN {t} >= 60000 THEN 1 ELSE 0 END) || '° ' || (({t} % 60000) // 1000) || '.' || lpad((({t} % 60000) % 1000)::VARCHAR, 3, '0') || '′ ' || CASE WHEN {v} < 0 THEN '{neg}' ELSE '{pos}' END)"


@query(f"WITH {POINTS}, z AS (SELECT pt_id, lat + pt_id % 1000 / 997.0::DOUBLE AS lat, lon + pt_id % 60 / 60.0::DOUBLE - 0.0000001 AS lon FROM points) SELECT pt_id, {_ddm('lat', 'N', 'S')} || ', ' || {_ddm('lon', 'E', 'W')} AS txt FROM z")
def fmt_ddm(spark, sf_dir):
    lat, lon = F.col("lat") + F.col("pt_id") % 1000 / 997.0, F.col("lon") + F.col("pt_id") % 60 / 60.0 - 0.0000001
    return B.points(spark, sf_dir).select("pt_id", F.concat_ws(", ", X.degrees_minutes(lat, "N", "S"), X.degrees_minutes(lon, "E", "W")).alias("txt"))


@query(f"WITH {POINTS}, z AS (SELECT pt_id, floor((pt_id % 24 + pt_id % 61 / 61.0::DOUBLE) * 60 + 0.5)::BIGINT AS k FROM points) SELECT pt_id, lpad((k // 60)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') AS txt FROM z")
def fmt_solar(spark, sf_dir):
    return B.points(spark, sf_dir).select("pt_id", X.solar_time(F.col("pt_id") % 24 + F.col("pt_id") % 61 / 61.0).alias("txt"))


@query(f"WITH {POINTS} SELECT pt_id, (['{"','".join(COMPASS)}'])[floor((((lon * 2) % 360 + 360) % 360) / 22.5::DOUBLE + 0.5)::INT % 16 + 1] AS name FROM points")
def compass16(spark, sf_dir):
    return B.points(spark, sf_dir).select("pt_id", X.compass(F.col("lon") * 2).alias("name"))


_STYLES = 12


def _position_texts(spark, sf_dir):
    """Places written in a dozen ways, some of them wrong."""
    whole = lambda v: F.floor(F.abs(v)).cast("int").cast("string")
    minutes = lambda v: ((F.abs(v) % 1) * 60).cast("int").cast("string")
    lat, lon = F.col("lat"), F.col("lon")
    ns, ew = F.when(lat < 0, "S").otherwise("N"), F.when(lon < 0, "W").otherwise("e")
    p = lambda f, *c: F.format_string(f, *c)
    styles = [
        p("%s, %s", lat.cast("string"), lon.cast("string")),
        p("%s %s %s, %s %s %s", whole(lat), minutes(lat), ns, whole(lon), minutes(lon), ew),
        p("%s°%s'00\"%s %s°%s′00″%s", whole(lat), minutes(lat), ns, whole(lon), minutes(lon), ew),
        p("%s%s / %s%s", ew, F.abs(lon).cast("string"), ns, F.abs(lat).cast("string")),
        p("%s%s %s %s%s %s", ns, whole(lat), minutes(lat), ew, whole(lon), minutes(lon)),
        F.replace(p("%s; %s", lat.cast("string"), lon.cast("string")), F.lit("-"), F.lit("−")),
        p("%s 75 N, 3 E", whole(lat)),
        p("%s, %s, 1", lat.cast("string"), lon.cast("string")),
        p("%s %s", lat.cast("string"), lon.cast("string")),
        F.lit(None).cast("string"),
        p("%s %s %s %s %s %s", ns, whole(lat), minutes(lat), ew, whole(lon), minutes(lon)),
        p("%s %s %s", whole(lat), minutes(lat), whole(lon)),
    ]
    kind = F.col("pt_id") % _STYLES
    txt = F.coalesce(*(F.when(kind == k, s) for k, s in enumerate(styles)))
    return B.points(spark, sf_dir).select("pt_id", txt.alias("txt"))


@query(
    f"""WITH {POINTS}, k AS (SELECT *, pt_id % {_STYLES} AS k FROM points)
    SELECT pt_id, CASE WHEN k NOT IN (6, 7, 9, 11) THEN lat END AS lat, CASE WHEN k NOT IN (6, 7, 9, 11) THEN lon END AS lon,
      CASE k WHEN 6 THEN '{ERRORS["minutes"]}' WHEN 7 THEN '{ERRORS["separators"]}' WHEN 9 THEN '{ERRORS["empty"]}' WHEN 11 THEN '{ERRORS["uneven"]}' END AS error FROM k"""
)
def parse_position(spark, sf_dir):
    """The texts are made from places, so the oracle needs no parser: it states the places."""
    return read_positions(_position_texts(spark, sf_dir), "txt", "pt_id").select("pt_id", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"), "error")


@query(
    f"""WITH {POINTS}, z AS (SELECT pt_id, lat, lon, pt_id % 13 AS k, (pt_id % 7) * 0.5::DOUBLE + 0.5 AS h FROM points)
    SELECT pt_id, concat_ws('&', 'loc=' || {_fixed('lat', 2)} || ',' || {_fixed('lon', 2)}, CASE WHEN k BETWEEN 1 AND 11 THEN 'm=' || array_to_string(list_transform(range(k), lambda m: (m + 1)::VARCHAR), ',') END, CASE WHEN h <> 2 THEN 'h=' || regexp_replace({_fixed('h', 2)}, '\\.?0+$', '') END, CASE WHEN pt_id % 3 = 0 THEN 'wt=' || CASE WHEN pt_id % 2 = 0 THEN '1.5' ELSE '2' END END, CASE WHEN pt_id % 3 = 0 THEN 'wd=' || (pt_id % 5 * 12) END) AS link FROM z"""
)
def build_share_link(spark, sf_dir):
    return _links(spark, sf_dir).select("pt_id", "link")


def _links(spark, sf_dir):
    k = (F.col("pt_id") % 13).cast("int")
    months = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda m: m < k)
    some = F.col("pt_id") % 3 == 0
    return B.points(spark, sf_dir).select("pt_id", "lat", "lon", X.share_link(F.col("lat"), F.col("lon"), months, F.col("pt_id") % 7 * 0.5 + 0.5, 2.0, F.when(some, F.when(F.col("pt_id") % 2 == 0, 1.5).otherwise(2.0)), F.when(some, (F.col("pt_id") % 5 * 12).cast("int"))).alias("link"))


@query(
    f"""WITH {POINTS}, z AS (SELECT pt_id, lat, lon, pt_id % 13 AS k, (pt_id % 7) * 0.5::DOUBLE + 0.5 AS h FROM points)
    SELECT pt_id, {_fixed('lat', 2)}::DOUBLE AS lat, {_fixed('lon', 2)}::DOUBLE AS lon, CASE WHEN k BETWEEN 1 AND 11 THEN array_to_string(list_transform(range(k), lambda m: m::VARCHAR), ',') END AS months, CASE WHEN h <> 2 THEN h END AS lim, CASE WHEN pt_id % 3 = 0 THEN CASE WHEN pt_id % 2 = 0 THEN 1.5::DOUBLE ELSE 2.0::DOUBLE END END AS wt, CASE WHEN pt_id % 3 = 0 THEN (pt_id % 5 * 12)::INT END AS wd FROM z"""
)
def parse_share_link(spark, sf_dir):
    p = X.parsed_link(F.concat(F.lit("#"), F.col("link")))
    return _links(spark, sf_dir).select("pt_id", p.alias("p")).select("pt_id", "p.lat", "p.lon", F.array_join(F.transform("p.months", lambda m: m.cast("string")), ",").alias("months"), F.col("p.limit").alias("lim"), "p.wt", "p.wd")


def _visits(spark, sf_dir):
    tagged = F.concat("url", F.when(F.col("page_id") % 5 == 0, F.lit("?utm_source=News!Letter")).otherwise(""))
    hosts = F.array(*(F.lit(h) for h in ("https://www.google.com/x", "https://lnkd.in/a", "", "https://news.example.org/y", "https://t.co/z", "https://chatgpt.com/", "http://www.bing.com/s")))
    return B.read(spark, sf_dir, "pages").select("page_id", tagged.alias("url"), F.element_at(hosts, (F.col("page_id") % 7 + 1).cast("int")).alias("referrer"))


@query(
    r"""WITH v AS (SELECT page_id, url || CASE WHEN page_id % 5 = 0 THEN '?utm_source=News!Letter' ELSE '' END AS url, (['https://www.google.com/x', 'https://lnkd.in/a', '', 'https://news.example.org/y', 'https://t.co/z', 'https://chatgpt.com/', 'http://www.bing.com/s'])[page_id % 7 + 1] AS referrer FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(url, '[?&]utm_source=[^&#]') THEN left(regexp_replace(lower(url_decode(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1))), '[^a-z0-9_.-]', '', 'g'), 40) ELSE (['google', 'linkedin', 'direct', 'news.example.org', 'x', 'chatgpt', 'bing'])[page_id % 7 + 1] END AS source FROM v"""
)
def traffic_source(spark, sf_dir):
    return _visits(spark, sf_dir).select("page_id", X.traffic_source(F.col("url"), F.col("referrer")).alias("source"))


@query(
    r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/locations/' WHEN 1 THEN '/locations/north-sea-' || page_id || '.html' WHEN 2 THEN '/methodology.html' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/]+(/[^?#]*)', 1) END AS path FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'locations' WHEN 1 THEN 'loc:north-sea-' || page_id WHEN 2 THEN 'how' ELSE CASE WHEN regexp_matches(path, 'methodology\.html$') THEN 'how' ELSE 'home' END END AS page FROM p"""
)
def page_class(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.lit("/locations/")).when(k == 1, F.concat(F.lit("/locations/north-sea-"), F.col("page_id").cast("string"), F.lit(".html"))).when(k == 2, F.lit("/methodology.html")).otherwise(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+(/[^?#]*)", 1))
    return B.read(spark, sf_dir, "pages").select("page_id", X.page_class(path).alias("page"))


CAPS = (4, 8, 12, 20, 40, 60, 80, 100)


@query(f"WITH {_SHARE}, t AS (SELECT cell_id, max(p) AS top, arg_min(m, (-p, m)) AS month FROM x GROUP BY cell_id) SELECT cell_id, top, month, coalesce(list_min(list_filter([4.0, 8, 12, 20, 40, 60, 80, 100]::DOUBLE[], lambda c: c >= top * 1.06::DOUBLE)), 100.0) AS cap FROM t")
def nice_axis(spark, sf_dir):
    """The axis of monthly bars, and the first month with the highest one."""
    ranked = _share(spark, sf_dir).withColumn("rk", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.col("p").desc(), "m"))).filter("rk = 1")
    return ranked.select("cell_id", F.col("p").alias("top"), F.col("m").alias("month"), N.first_cap(F.col("p"), CAPS, 1.06).alias("cap"))


@query(f"WITH {OBS}, {THR}, {EXC}, c AS (SELECT cell_id, t, sum(n * exc) / sum(n) AS p FROM exc WHERE m IN (5, 6, 7) GROUP BY cell_id, t) SELECT cell_id, t, round(p, 6) AS p FROM c WHERE t NOT IN (3.0, 7.0) UNION ALL SELECT DISTINCT cell_id, 0.0, 100.0 FROM c")
def chart_points(spark, sf_dir):
    curve = R.combine_months(R.exceedance(B.obs(spark, sf_dir)), [5, 6, 7]).withColumn("p", F.when(~F.col("t").isin(3.0, 7.0), r(F.col("p"))))
    return D.curve_points(curve)


@query(f"WITH {OBS}, {THR}, {EXC} SELECT m, t, round(sum(n * exc) / sum(n), 4) AS p FROM exc GROUP BY m, t")
def month_table(spark, sf_dir):
    """The report's table of months and heights, over all cells."""
    return R.exceedance(B.obs(spark, sf_dir), keys=("m",)).select("m", "t", r(F.col("exc"), 4).alias("p"))


@query("SELECT string_agg(source, ' ' ORDER BY source) AS sources, count(*)::BIGINT AS n FROM (SELECT DISTINCT source FROM documents)")
def attributions(spark, sf_dir):
    """Each source once. There are as many as catalogues have, a short list by nature."""
    names = B.read(spark, sf_dir, "documents").select("source").distinct()
    return names.agg(F.array_join(F.array_sort(F.collect_list("source")), " ").alias("sources"), F.count("*").alias("n"))


@query(f"WITH {SEQ} SELECT k, count(*)::BIGINT AS n, round(avg(hs), 6) AS hs FROM seq GROUP BY k")
def json_decode(spark, sf_dir):
    return B.seq(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"), r(F.avg("hs")).alias("hs"))


@query(
    """WITH c AS (SELECT s_suppkey AS cell, range(12) AS ms FROM supplier), z AS (SELECT cell, unnest(ms) AS m FROM c)
    SELECT cell, m::INT AS m, CASE WHEN (cell + m) % 5 <> 0 THEN ((cell * 7 + m * 3) % 90) / 10.0::DOUBLE END AS value FROM z"""
)
def tile_decode(spark, sf_dir):
    """Tiles made up from the suppliers, five-hundredfold scaled down again: negative numbers are missing."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: F.when((F.col("s_suppkey") + m) % 5 == 0, -1).otherwise((F.col("s_suppkey") * 7 + m * 3) % 90).cast("int"))
    wire = B.read(spark, sf_dir, "supplier").select(F.array(F.col("s_suppkey").cast("double")).alias("lat"), F.array(F.lit(0.0)).alias("lon"), F.array(raw).alias("mean"))
    cells = tiles.checked(tiles.cells_of(wire), 15).withColumn("cell", F.col("lat").cast("long"))
    return tiles.monthly(cells, "mean").select("cell", "m", "value")


_ACTIVE = f"(NOT regexp_matches(lower(s), '{X.NOT_IN_SERVICE}') AND regexp_matches(lower(s), '{X.IN_SERVICE}'))"


@query(
    f"""WITH {ASSETS}, own AS (SELECT *, d <> 0 AND d BETWEEN 100 AND 700 AS deep, contains(lower(n || ' ' || coalesce(s, '') || ' ' || coalesce(o, '')), 'brand') AS named FROM assets)
    SELECT 'default' AS choice, asset_id, t FROM own
    UNION ALL SELECT 'active' AS choice, asset_id, t FROM own WHERE t <> 'lng terminal' AND (t <> 'well' OR {_ACTIVE}) AND deep AND named
    UNION ALL SELECT 'platforms' AS choice, asset_id, t FROM own WHERE contains(t, 'platform') AND d <> 0 AND d <= 500"""
)
def asset_filter(spark, sf_dir):
    """Three choices: all; wells in service, platforms and fields at 100 to 700 m whose texts hold "brand"; platforms in up to 500 m."""
    assets = B.assets(spark, sf_dir)
    choices = {"default": V.AssetChoice(), "active": V.AssetChoice(lng=False, active_only=True, low=100, high=700, text=" Brand "), "platforms": V.AssetChoice(wells=False, lng=False, fields=False, high=500)}
    return reduce(DataFrame.unionByName, [V.chosen_assets(assets, c).select(F.lit(name).alias("choice"), "asset_id", "t") for name, c in choices.items()])


@query(f"WITH {ASSETS} SELECT asset_id, {_ACTIVE} AS active FROM assets WHERE t = 'well'")
def well_in_service(spark, sf_dir):
    return B.assets(spark, sf_dir).filter("t = 'well'").select("asset_id", X.in_service(F.col("s")).alias("active"))


WORDS = {"producing": "producing", "in service": "operating", "plugged and abandoned": "closed"}


@query(f"WITH {ASSETS} SELECT asset_id, CASE lower(trim(s)) WHEN 'producing' THEN 'producing' WHEN 'in service' THEN 'operating' WHEN 'plugged and abandoned' THEN 'closed' ELSE lower(trim(s)) END AS label FROM assets")
def status_label(spark, sf_dir):
    return B.assets(spark, sf_dir).select("asset_id", X.status_label(F.col("s"), WORDS).alias("label"))


@query(f"WITH {ASSETS} SELECT t, count(*)::BIGINT AS total, count(*) FILTER (WHERE {_ACTIVE})::BIGINT AS active, count(*) FILTER (WHERE {_ACTIVE}) || ' of ' || count(*) AS txt FROM assets GROUP BY t")
def asset_counts(spark, sf_dir):
    counts = B.assets(spark, sf_dir).groupBy("t").agg(F.count("*").alias("total"), F.count_if(X.in_service(F.col("s"))).alias("active"))
    return counts.withColumn("txt", F.concat(F.col("active").cast("string"), F.lit(" of "), F.col("total").cast("string")))


_SETS = """sets AS (SELECT c_custkey AS id, list_filter(range(12), lambda m: ((c_custkey * 2654435761 // 64) >> m) % 2 = 1 OR c_custkey % 50 = 7) AS ms FROM customer),
    st AS (SELECT id, ms, list_filter(ms, lambda m: NOT list_contains(ms, (m + 11) % 12)) AS starts FROM sets),
    rn AS (SELECT id, ms, list_transform(starts, lambda s: {s: s, n: list_filter(range(1, 13), lambda k: NOT list_contains(ms, (s + k) % 12))[1]}) AS runs FROM st)"""
_MONTH = "(['" + "', '".join(MONTH_NAMES) + "'])"


def _month_sets(spark, sf_dir):
    """Sets of months that the customers' numbers give; one in fifty has all of them."""
    bits = F.floor(F.col("c_custkey") * 2654435761 / 64).cast("long")
    chosen = lambda m: F.when((F.shiftright(bits, m) % 2 == 1) | (F.col("c_custkey") % 50 == 7), F.lit(m))
    return B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_compact(F.array(*(chosen(m) for m in range(12)))).alias("months"))


@query(
    f"""WITH {_SETS}, t AS (SELECT id, ms, CASE WHEN len(ms) = 12 THEN 'Jan to Dec' ELSE array_to_string(list_transform(runs, lambda r: CASE WHEN r.n = 1 THEN {_MONTH}[r.s + 1] WHEN r.n = 2 THEN {_MONTH}[r.s + 1] || ' and ' || {_MONTH}[(r.s + 1) % 12 + 1] ELSE {_MONTH}[r.s + 1] || ' to ' || {_MONTH}[(r.s + r.n - 1) % 12 + 1] END), ', ') END AS runs FROM rn)
    SELECT id, runs, CASE len(ms) WHEN 12 THEN 'across the whole year' WHEN 0 THEN '(no months selected)' ELSE 'in ' || runs END AS label, CASE len(ms) WHEN 12 THEN 'All year' ELSE array_to_string(list_transform(ms, lambda m: {_MONTH}[m + 1]), ', ') END AS listed FROM t"""
)
def month_runs(spark, sf_dir):
    rows = _month_sets(spark, sf_dir)
    return rows.select("id", X.month_runs(F.col("months")).alias("runs"), X.months_label(F.col("months")).alias("label"), X.month_list(F.col("months")).alias("listed"))


@query(f"WITH {OBS}, c AS (SELECT cell_id, m FROM obs WHERE m IN (5, 6, 7) AND hs > 9.5 GROUP BY ALL HAVING count(*) >= 1), a AS (SELECT DISTINCT cell_id FROM obs), x AS (SELECT cell_id, u.m::INT AS m FROM a, (VALUES (5), (6), (7)) u(m)) SELECT cell_id, string_agg(m::VARCHAR, ',' ORDER BY m) AS missing FROM (SELECT * FROM x EXCEPT SELECT cell_id, m FROM c) GROUP BY cell_id")
def missing_months(spark, sf_dir):
    """Chosen months without a sample over 9.5 m."""
    used = B.obs(spark, sf_dir).groupBy("cell_id").agg(F.collect_set(F.when(F.col("m").isin(5, 6, 7) & (F.col("hs") > 9.5), F.col("m"))).alias("used"))
    gone = F.array_except(F.array(F.lit(5), F.lit(6), F.lit(7)), "used")
    return used.filter(F.size(gone) > 0).select("cell_id", F.array_join(F.transform(gone, lambda m: m.cast("string")), ",").alias("missing"))


@query(
    f"""WITH {THR}, l AS (SELECT DISTINCT (c_custkey % 44)::DOUBLE / 4 + 0.25 AS lim FROM customer), c AS (SELECT lim, t, sum(CASE WHEN t >= greatest(6, lim) - 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY lim ORDER BY t) AS over FROM l, thr),
    k AS (SELECT lim, t, abs(t - lim) < 0.001 AS own, lag(abs(t - lim) < 0.001) OVER w AS a, lead(abs(t - lim) < 0.001) OVER w AS b FROM c WHERE over <= 1 WINDOW w AS (PARTITION BY lim ORDER BY t))
    SELECT lim AS "limit", t FROM k WHERE abs(t * 2 - round(t * 2)) < 1e-9 OR own OR coalesce(a, false) OR coalesce(b, false)"""
)
def display_thresholds(spark, sf_dir):
    """Rows of the table of heights for every limit that some customer has."""
    from pelagos.functions.constants import THRESHOLDS

    limits = B.read(spark, sf_dir, "customer").select(((F.col("c_custkey") % 44).cast("double") / 4 + 0.25).alias("limit")).distinct()
    return D.shown(limits.select("limit", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("t")))


_TYPED = "CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'abc' || c_custkey WHEN 2 THEN '-' || c_custkey WHEN 3 THEN (c_custkey % 400)::VARCHAR || '.' || (c_custkey % 100)::VARCHAR ELSE (c_custkey % 20)::VARCHAR || '.' || (c_custkey % 1000)::VARCHAR END"


@query(f"WITH t AS (SELECT c_custkey AS id, {_TYPED} AS txt FROM customer), x AS (SELECT id, txt, TRY_CAST(txt AS DOUBLE) AS h FROM t) SELECT id, txt, CASE WHEN h IS NULL OR h <= 0 THEN 2.0::DOUBLE ELSE least(15.0, greatest(0.25, floor(h * 4 + 0.5) / 4)) END AS h FROM x")
def clean_limit(spark, sf_dir):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    typed = F.when(k % 8 == 0, "").when(k % 8 == 1, F.concat(F.lit("abc"), text(k))).when(k % 8 == 2, F.concat(F.lit("-"), text(k))).when(k % 8 == 3, F.concat_ws(".", text(k % 400), text(k % 100))).otherwise(F.concat_ws(".", text(k % 20), text(k % 1000)))
    rows = B.read(spark, sf_dir, "customer").select(k.alias("id"), typed.alias("txt"))
    return rows.select("id", "txt", D.clean_limit(F.col("txt")).alias("h"))


_CUR = f"{OBS}, {DAYS}, mm AS (SELECT cell_id, m, quantile_cont(wind, 0.5) / 20 AS s5, quantile_cont(wind, 0.9) / 20 AS s9, CASE WHEN m % 4 <> 1 THEN avg(hs) / 20 END AS b5 FROM obs GROUP BY cell_id, m)"


def _currents(spark, sf_dir):
    rows = B.obs(spark, sf_dir)
    means = rows.groupBy("cell_id", "m").agg(F.when(F.col("m") % 4 != 1, F.avg("hs") / 20).alias("b5"))
    return quantiles(rows, ["cell_id", "m"], "wind", {"s5": 0.5, "s9": 0.9}).join(means, ["cell_id", "m"]).withColumns({c: F.col(c) / 20 for c in ("s5", "s9")})


@query(f"WITH {_CUR} SELECT cell_id, round(sum(w * s5) / sum(w), 6) AS s5, round(sum(w * s9) / sum(w), 6) AS s9, round(sum(w * b5) / sum(w) FILTER (WHERE b5 IS NOT NULL), 6) AS b5 FROM mm JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY cell_id")
def current_summary(spark, sf_dir):
    return E.current_summary(_currents(spark, sf_dir), [5, 6, 7], ("s5", "s9", "b5")).select("cell_id", r(F.col("s5")).alias("s5"), r(F.col("s9")).alias("s9"), r(F.col("b5")).alias("b5"))


@query(
    f"""WITH {CELLS}, p AS (SELECT cell_id, CASE WHEN cell_id % 9 = 0 THEN NULL ELSE (cell_id * 17 % 300)::DOUBLE END AS depth, CASE WHEN cell_id % 4 = 0 THEN NULL ELSE (cell_id % 12) / 10.0::DOUBLE END AS spring, (cell_id % 20)::DOUBLE AS wind, (cell_id % 8) / 10.0::DOUBLE AS surf, CASE WHEN cell_id % 3 = 0 THEN NULL ELSE 0.1::DOUBLE END AS bot, 60.0::DOUBLE AS bd FROM cells),
    z AS (SELECT *, CASE WHEN depth > 2 THEN depth END AS d FROM p), lv AS (SELECT *, unnest(CASE WHEN d IS NULL THEN [0.0::DOUBLE] ELSE list_concat(list_concat([0.0::DOUBLE], list_filter([5.0::DOUBLE, 10, 25, 50, 100, 200], lambda q: q < d - 1)), [d - 1]) END) AS z FROM z),
    v AS (SELECT cell_id, z, CASE WHEN d IS NOT NULL THEN spring * 8.0::DOUBLE / 7 * pow((d - z) / d, 1.0::DOUBLE / 7) WHEN z = 0 THEN spring * 8.0::DOUBLE / 7 END AS tidal, wind * 0.03::DOUBLE * greatest(0, 1 - z / 50) AS wind, CASE WHEN bot IS NOT NULL AND z >= bd THEN bot WHEN bot IS NOT NULL THEN surf + (bot - surf) * z / bd ELSE surf END AS background FROM lv)
    SELECT cell_id, z, round(tidal, 6) AS tidal, round(wind, 6) AS wind, round(background, 6) AS background, round(coalesce(tidal, 0) + coalesce(wind, 0) + coalesce(background, 0), 6) AS total FROM v"""
)
def current_profile(spark, sf_dir):
    k = F.col("cell_id")
    places = B.cells(spark, sf_dir).select(
        k, F.when(k % 9 != 0, (k * 17 % 300).cast("double")).alias("depth"), F.when(k % 4 != 0, (k % 12) / 10.0).alias("spring"), (k % 20).cast("double").alias("wind"), ((k % 8) / 10.0).alias("surf"), F.when(k % 3 != 0, 0.1).alias("bot"), F.lit(60.0).alias("bot_depth")
    )
    return E.current_profile(places).select("cell_id", "z", *(r(F.col(c)).alias(c) for c in ("tidal", "wind", "background", "total")))


@query(f"WITH {CELLS}, f AS (SELECT cell_id, (cell_id % 40) / 10.0::DOUBLE AS f FROM cells) SELECT cell_id, CASE WHEN f < 0.25 THEN 'Semidiurnal, peaks about every 6.2 h' WHEN f <= 1.5 THEN 'Mixed, mainly semidiurnal, peaks about every 6 h' WHEN f <= 3 THEN 'Mixed, mainly diurnal, one strong and one weak peak a day' ELSE 'Diurnal, peaks about every 12.4 h' END AS kind FROM f")
def tide_type(spark, sf_dir):
    return B.cells(spark, sf_dir).select("cell_id", X.tide_type((F.col("cell_id") % 40) / 10.0).alias("kind"))


@query(
    f"""WITH {CELLS}, t AS (SELECT cell_id, (cell_id % 15) / 10.0::DOUBLE AS sp, CASE WHEN cell_id % 11 = 0 THEN NULL ELSE (cell_id % 9) / 10.0::DOUBLE END AS np, CASE WHEN cell_id % 7 = 0 THEN 0.0 WHEN cell_id % 5 = 0 THEN 999.0 ELSE (cell_id % 50)::DOUBLE END AS sl, (cell_id % 5)::DOUBLE AS pd FROM cells)
    SELECT cell_id, CASE WHEN NOT sp > 0.5 THEN NULL WHEN sl = 0 THEN 'None: the stream turns without stopping' WHEN np > 0.5 AND sl < 999 THEN 'About ' || sl::INT || ' min below 1 kn at each turn' || CASE WHEN pd >= 1 THEN ', ' || pd::INT || ' times a day' ELSE '' END WHEN np <= 0.5 THEN 'Long spells at neaps, short at springs' END AS slack FROM t"""
)
def slack_class(spark, sf_dir):
    k = F.col("cell_id")
    return B.cells(spark, sf_dir).select("cell_id", X.slack_water((k % 15) / 10.0, F.when(k % 11 != 0, (k % 9) / 10.0), F.when(k % 7 == 0, 0.0).when(k % 5 == 0, 999.0).otherwise((k % 50).cast("double")), (k % 5).cast("double")).alias("slack"))


_CYC = f"{TRACKS}, cm AS (SELECT track_id % 200 AS cell_id, m, count(*) FILTER (WHERE w >= 64) / 10.0::DOUBLE AS storms, count(*) FILTER (WHERE w >= 34) / 4.0::DOUBLE AS days FROM tracks GROUP BY ALL), cy AS (SELECT track_id % 200 AS cell_id, count(DISTINCT y) / 2.0::DOUBLE AS storms_all FROM tracks WHERE track_id % 3 <> 0 GROUP BY ALL)"


def _cyclones(spark, sf_dir):
    rows = B.tracks(spark, sf_dir).withColumn("cell_id", F.col("track_id") % 200)
    monthly = rows.groupBy("cell_id", "m").agg((F.count_if(F.col("w") >= 64) / 10.0).alias("storms"), (F.count_if(F.col("w") >= 34) / 4.0).alias("days"))
    return rows, monthly, rows.filter("track_id % 3 <> 0").groupBy("cell_id").agg((F.count_distinct("y") / 2.0).alias("storms_all"))


@query(
    f"""WITH {_CYC}, s AS (SELECT cell_id, sum(storms) AS s, sum(days) AS d, bool_or(storms > 0 OR days > 0) AS happens FROM cm GROUP BY cell_id), pk AS (SELECT track_id % 200 AS cell_id, max(w) AS w FROM tracks GROUP BY ALL)
    SELECT cell_id, round(coalesce(storms_all, s), 6) AS storms, round(d, 6) AS days, happens, storms_all IS NOT NULL AS exact, w AS wmax,
      CASE WHEN w < 34 THEN NULL WHEN w < 64 THEN 'tropical storm strength' WHEN w < 83 THEN 'Category 1' WHEN w < 96 THEN 'Category 2' WHEN w < 113 THEN 'Category 3' WHEN w < 137 THEN 'Category 4' ELSE 'Category 5' END AS category
    FROM s LEFT JOIN cy USING (cell_id) JOIN pk USING (cell_id)"""
)
def cyclone_summary(spark, sf_dir):
    rows, monthly, year = _cyclones(spark, sf_dir)
    peaks = rows.groupBy("cell_id").agg(F.max("w").alias("wmax"))
    return E.cyclone_summary(monthly, year, peaks, list(range(12))).select("cell_id", r(F.col("storms")).alias("storms"), r(F.col("days")).alias("days"), "happens", "exact", "wmax", "category")


@query(f"WITH {_CYC} SELECT cell_id, sum(storms) >= 0.1 AS in_area FROM cm GROUP BY cell_id")
def cyclone_area(spark, sf_dir):
    return E.in_cyclone_area(_cyclones(spark, sf_dir)[1])


@query(
    f"""WITH {TRACKS}, p AS (SELECT track_id % 200 AS cell_id, (y % 3)::INT AS phase, m, count(*) FILTER (WHERE w >= 34) / 7.0::DOUBLE AS days FROM tracks WHERE (track_id + y) % 4 <> 0 GROUP BY ALL),
    s AS (SELECT cell_id, phase, floor(round(sum(days), 6) * 10 + 0.5) / 10 AS days FROM p WHERE m IN (7, 8, 9) GROUP BY cell_id, phase),
    yr AS (SELECT phase, floor(sum(n) / 3.0::DOUBLE + 0.5)::INT AS years FROM (SELECT (y % 3)::INT AS phase, m, count(DISTINCT y) AS n FROM tracks WHERE m IN (7, 8, 9) GROUP BY ALL) GROUP BY phase),
    k AS (SELECT cell_id FROM s GROUP BY cell_id HAVING count(*) >= 2)
    SELECT cell_id, ph.phase::INT AS phase, days, coalesce(years, 0)::INT AS years FROM k CROSS JOIN range(3) ph(phase) LEFT JOIN s USING (cell_id, phase) LEFT JOIN yr USING (phase)"""
)
def cyc_enso_split(spark, sf_dir):
    rows = B.tracks(spark, sf_dir).withColumns({"cell_id": F.col("track_id") % 200, "phase": (F.col("y") % 3).cast("int")})
    monthly = rows.filter((F.col("track_id") + F.col("y")) % 4 != 0).groupBy("cell_id", "phase", "m").agg((F.count_if(F.col("w") >= 34) / 7.0).alias("days"))
    years = rows.groupBy("phase", "m").agg(F.count_distinct("y").alias("n"))
    return E.cyclones_by_phase(monthly, years, [7, 8, 9])


_CAT = "CASE WHEN w < 34 THEN {weak} WHEN w < 64 THEN {storm} WHEN w < 83 THEN 'Category 1' WHEN w < 96 THEN 'Category 2' WHEN w < 113 THEN 'Category 3' WHEN w < 137 THEN 'Category 4' ELSE 'Category 5' END"


@query(f"WITH {TRACKS} SELECT seq, {_CAT.format(weak='NULL', storm=chr(39) + 'tropical storm strength' + chr(39))} AS category, {_CAT.format(weak=chr(39) + 'Below tropical storm strength' + chr(39), storm=chr(39) + 'Tropical storm strength' + chr(39))} AS on_map FROM tracks")
def cyclone_category(spark, sf_dir):
    return B.tracks(spark, sf_dir).select("seq", X.storm_category(F.col("w")).alias("category"), X.storm_category_on_map(F.col("w")).alias("on_map"))


@query(
    f"""WITH {POINTS}, w AS (SELECT pt_id, lat, CASE WHEN lat < 0 THEN 'cyclone' WHEN lat >= 30 AND lon >= 0 AND lon < 60 THEN '' WHEN lat >= 50 AND (lon <= -100 OR lon >= 140) THEN '' WHEN lon >= 100 THEN 'typhoon' WHEN lon >= 30 THEN 'cyclone' ELSE 'hurricane' END AS word FROM points),
    c AS (SELECT *, upper(word[1]) || word[2:] AS cap FROM w) SELECT pt_id, word, CASE WHEN word = '' THEN CASE WHEN abs(lat) > 35 THEN 'Tropical and ex-tropical cyclones' ELSE 'Tropical cyclones' END WHEN abs(lat) > 35 THEN cap || 's and ex-' || word || 's' ELSE cap || 's' END AS heading FROM c"""
)
def storm_word(spark, sf_dir):
    at = (F.col("lat"), F.col("lon"))
    return B.points(spark, sf_dir).select("pt_id", X.storm_word(*at).alias("word"), X.storm_heading(*at).alias("heading"))


_LIGHT = f"""{POINTS}, {DAYS}, n(m, day) AS (VALUES (0, 15), (1, 46), (2, 74), (3, 105), (4, 135), (5, 166), (6, 196), (7, 227), (8, 258), (9, 288), (10, 319), (11, 349)),
    x AS (SELECT pt_id, m, -tan(radians(lat)) * tan(radians(-23.44::DOUBLE * cos(2 * pi() / 365 * (day + 10)))) AS x FROM points, n),
    light AS (SELECT pt_id, m, CASE WHEN x <= -1 THEN 24.0 WHEN x >= 1 THEN 0.0 ELSE 2 * degrees(acos(greatest(-1.0, least(1.0, x)))) / 15 END AS hours FROM x)"""


def _light(spark, sf_dir):
    return E.daylight(B.points(spark, sf_dir)).select("pt_id", "m", "hours", "rise", "set")


@query(f"WITH {_LIGHT} SELECT pt_id, m, round(hours, 6) AS hours, CASE WHEN hours > 0 AND hours < 24 THEN round(12 - hours / 2, 6) END AS rise, CASE WHEN hours > 0 AND hours < 24 THEN round(12 + hours / 2, 6) END AS \"set\" FROM light")
def daylight_by_month(spark, sf_dir):
    return _light(spark, sf_dir).withColumns({c: r(F.col(c)) for c in ("hours", "rise", "set")})


@query(f"WITH {_LIGHT} SELECT pt_id, arg_min(m, (round(hours, 6), m)) AS shortest, arg_min(m, (-round(hours, 6), m)) AS longest FROM light WHERE m IN (4, 5, 6, 7) GROUP BY pt_id")
def daylight_extremes(spark, sf_dir):
    h = r(F.col("hours"))
    return _light(spark, sf_dir).filter("m IN (4, 5, 6, 7)").groupBy("pt_id").agg(F.min_by("m", F.struct(h, "m")).alias("shortest"), F.min_by("m", F.struct(-h, F.col("m"))).alias("longest"))


@query(f"WITH {_LIGHT} SELECT pt_id, round(sum(w * hours) / sum(w), 6) AS hours FROM light JOIN days USING (m) WHERE m IN (4, 5, 6, 7) GROUP BY pt_id")
def daylight_weighted(spark, sf_dir):
    return _light(spark, sf_dir).filter("m IN (4, 5, 6, 7)").groupBy("pt_id").agg(r(N.weighted(F.col("hours"), N.month_days(F.col("m")))).alias("hours"))


def _ss(a: float, b: float, x: str) -> str:
    t = f"least(1.0, greatest(0.0, (({x}) - {a}) / {b - a}::DOUBLE))"
    return f"({t} * {t} * (3 - 2 * {t}))"


_DEMO = f"""{POINTS}, q AS (SELECT pt_id, lat, lon, m::INT AS m, cos(2 * pi() * (m - 0.25::DOUBLE) / 12) AS ph, exp(-pow((m - 6) / 1.6::DOUBLE, 2)) AS mon,
      (CASE WHEN lat <= 0 THEN 1.6 + 1.5 * {_ss(18, 42, 'abs(lat)')} + 1.3 * {_ss(42, 58, 'abs(lat)')} ELSE 1.6 + 0.9 * {_ss(18, 42, 'abs(lat)')} + 0.5 * {_ss(42, 60, 'abs(lat)')} END) * (1 - 0.45 * {_ss(66, 78, 'abs(lat)')}) AS base FROM points, range(12) g(m)),
    s AS (SELECT *, base + {_ss(12, 32, 'lat')} * 0.38 * base * ph - {_ss(12, 32, '-lat')} * 0.2 * base * ph + CASE WHEN lat > 4 AND lat < 23 AND lon > 52 AND lon < 75 THEN 1.3 * mon ELSE 0 END + CASE WHEN lat > 4 AND lat < 21 AND lon > 79 AND lon < 95 THEN 0.8 * mon ELSE 0 END + CASE WHEN lat > 4 AND lat < 23 AND lon > 104 AND lon < 121 THEN 0.55 * greatest(0, ph) ELSE 0 END AS mean FROM q),
    h AS (SELECT pt_id, m, greatest(0.35, least(7.0, mean * (0.88 + 0.12 * {_ss(2, 9, 'abs(lat)')}))) AS mean, greatest(1.55, least(2.35, 2.25 - 0.55 * {_ss(22, 45, 'abs(lat)')})) AS k FROM s)"""


@query(f"WITH {_DEMO}, {DAYS} SELECT pt_id, m, floor(46 * 8 * w + 0.5)::BIGINT AS n, round(mean, 6) AS mean, round(100 * exp(-pow(2.0::DOUBLE / (mean / gamma(1 + 1 / k)), k)), 5) AS over_2m FROM h JOIN days USING (m)")
def demo_climatology(spark, sf_dir):
    return demo.climatology(B.points(spark, sf_dir)).filter("t = 2.0").select("pt_id", "m", "n", r(F.col("mean")).alias("mean"), r(F.col("exc"), 5).alias("over_2m"))


@query()
def label_declutter(spark, sf_dir):
    rows = B.points(spark, sf_dir).select((F.col("pt_id") % 8).alias("view"), F.col("pt_id").alias("label"), F.col("pt_id").alias("rank"), (F.col("lon") * 2).alias("x"), (F.col("lat") * 2).alias("y"))
    return D.declutter(rows)
