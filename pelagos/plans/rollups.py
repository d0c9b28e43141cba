"""Queries on roll-ups: exceedance, means, roses, histograms, swell, wind, diurnal cycle, phases, windows, extremes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.functions import numeric as N
from pelagos.functions.constants import BIN_MEAN_H, WINDOW_EDGES
from pelagos.operators import extremes as X
from pelagos.operators import persistence as P
from pelagos.operators import rollup as R
from pelagos.operators.quantile import quantiles
from pelagos.plans.registry import CELLS, CURVE, DAYS, EXC, OBS, SEQ, THR, curve_at, query
from pelagos.sources import bindings as B

SUMMER = [5, 6, 7]
H = 2.2


def r(col, digits: int = 4):
    return F.round(col, digits)


@query(f"WITH {OBS}, {THR}, {EXC} SELECT cell_id, m, t, n::BIGINT AS n, round(exc, 4) AS exc FROM exc")
def exceed_counts(spark, sf_dir):
    return R.exceedance(B.obs(spark, sf_dir)).select("cell_id", "m", "t", "n", r(F.col("exc")).alias("exc"))


@query(f"WITH {OBS}, {THR}, {EXC}, {CURVE} SELECT cell_id, t, round(p, 4) AS p, n FROM curve")
def exceed_curve(spark, sf_dir):
    return R.combine_months(R.exceedance(B.obs(spark, sf_dir)), SUMMER).select("cell_id", "t", r(F.col("p")).alias("p"), "n")


@query(f"WITH {OBS}, {THR}, {EXC}, {CURVE} SELECT cell_id, round(p, 4) AS p, floor FROM ({curve_at(H, 'cell_id')})")
def exceed_at_limit(spark, sf_dir):
    return R.exceeded_at(R.combine_months(R.exceedance(B.obs(spark, sf_dir)), SUMMER), H).select("cell_id", r(F.col("p")).alias("p"), "floor")


@query(f"WITH {OBS}, {THR}, {EXC}, mc AS (SELECT cell_id, m, t, exc AS p FROM exc) SELECT cell_id, m, floor(round(p, 6) * 10 + 0.5) / 10 AS p FROM ({curve_at(H, 'cell_id, m', 'mc')})")
def monthly_exceed(spark, sf_dir):
    months = R.exceedance(B.obs(spark, sf_dir)).withColumnRenamed("exc", "p")
    return R.exceeded_at(months, H, ("cell_id", "m")).select("cell_id", "m", N.half_up(r(F.col("p"), 6), 1).alias("p"))


@query(f"WITH {OBS} SELECT cell_id, round(avg(hs), 6) AS hs FROM obs WHERE m IN (5, 6, 7) GROUP BY cell_id")
def mean_hs_n_weighted(spark, sf_dir):
    months = R.selected(R.monthly_means(B.obs(spark, sf_dir), "hs"), SUMMER)
    return months.groupBy("cell_id").agg(r(N.weighted(F.col("hs"), F.col("n").cast("double")), 6).alias("hs"))


@query(f"WITH {OBS}, {DAYS}, mm AS (SELECT cell_id, m, avg(hs) AS hs FROM obs GROUP BY cell_id, m) SELECT cell_id, round(sum(w * hs) / sum(w), 6) AS hs FROM mm JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY cell_id")
def mean_hs_day_weighted(spark, sf_dir):
    months = R.selected(R.monthly_means(B.obs(spark, sf_dir), "hs"), SUMMER)
    return months.groupBy("cell_id").agg(r(N.weighted(F.col("hs"), N.month_days(F.col("m"))), 6).alias("hs"))


def _rose_sql(key: str) -> str:
    return f"""WITH {OBS}, {DAYS}, c AS (SELECT cell_id, m, {key} AS k, count(*) AS n FROM obs GROUP BY ALL),
      s AS (SELECT cell_id, m, k, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY cell_id, m) AS pct FROM c),
      b AS (SELECT cell_id, k, sum(w * pct) AS w FROM s JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY cell_id, k)
      SELECT cell_id, k AS {key}, round(100 * w / sum(w) OVER (PARTITION BY cell_id), 4) AS pct, row_number() OVER (PARTITION BY cell_id ORDER BY round(w, 9) DESC, k) = 1 AS is_mode FROM b"""


def _rose(spark, sf_dir, key):
    return R.blended(R.shares(B.obs(spark, sf_dir), key), key, SUMMER).withColumn("pct", r(F.col("pct")))


@query(_rose_sql("sector"))
def wave_rose(spark, sf_dir):
    return _rose(spark, sf_dir, "sector")


@query(_rose_sql("wind_sector"))
def wind_rose(spark, sf_dir):
    return _rose(spark, sf_dir, "wind_sector")


@query(_rose_sql("tp_bin"))
def period_hist(spark, sf_dir):
    return _rose(spark, sf_dir, "tp_bin")


@query(_rose_sql("tp_bin").replace("tp_bin AS k", "(tp_bin // 2)::INT AS k").replace("AS tp_bin,", "AS tz_bin,", 2).replace("(l_partkey % 14)::INT AS tz_bin,", "(l_partkey % 14)::INT AS tp_bin,"))
def tz_hist(spark, sf_dir):
    rows = B.obs(spark, sf_dir).withColumn("tz_bin", F.expr("CAST(tp_bin DIV 2 AS INT)"))
    return R.blended(R.shares(rows, "tz_bin"), "tz_bin", SUMMER).withColumn("pct", r(F.col("pct")))


@query(
    f"""WITH {OBS}, {DAYS}, c AS (SELECT cell_id, m, sector, count(*) AS n FROM obs GROUP BY ALL),
    s AS (SELECT cell_id, m, sector, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY cell_id, m) AS pct FROM c),
    modal AS (SELECT cell_id, m, arg_min(sector, (-round(pct, 9), sector)) AS sector, max(pct) AS pct FROM s GROUP BY cell_id, m),
    v AS (SELECT cell_id, sector, sum(w) AS d, sum(w * pct) / sum(w) AS share FROM modal JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY cell_id, sector),
    top AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY d DESC, sector) = 1),
    tp AS (SELECT cell_id, sum(w * tp) / sum(w) AS tp FROM (SELECT cell_id, m, avg(tp_bin) AS tp FROM obs GROUP BY cell_id, m) JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY cell_id)
    SELECT cell_id, sector, round(share, 4) AS share, round(tp, 6) AS tp FROM top JOIN tp USING (cell_id)"""
)
def prevailing_direction(spark, sf_dir):
    return R.prevailing(B.obs(spark, sf_dir), SUMMER).select("cell_id", "sector", r(F.col("share")).alias("share"), r(F.col("tp"), 6).alias("tp"))


@query(f"WITH {OBS} SELECT floor(hs / 0.5)::INT AS hs_bin, tp_bin, count(*)::BIGINT AS cnt FROM obs WHERE m IN (5, 6, 7) GROUP BY ALL")
def joint_scatter(spark, sf_dir):
    return R.joint_table(B.obs(spark, sf_dir), SUMMER)


@query(
    f"WITH {OBS}, j AS (SELECT floor(hs / 0.5)::INT AS hs_bin, tp_bin, count(*) AS cnt FROM obs WHERE m IN (5, 6, 7) GROUP BY ALL) SELECT hs_bin, tp_bin, sum(cnt)::BIGINT AS cnt, round(1000.0::DOUBLE * sum(cnt) / (SELECT sum(cnt) FROM j), 4) AS permille FROM j GROUP BY CUBE (hs_bin, tp_bin)"
)
def joint_marginals(spark, sf_dir):
    return R.with_margins(R.joint_table(B.obs(spark, sf_dir), SUMMER)).select("hs_bin", "tp_bin", "cnt", r(F.col("permille")).alias("permille"))


FLOORS, SWELL_T = (0, 4, 8), (0.5, 1.0, 2.0, 4.0)
_SWELL = f"""{OBS}, {DAYS}, fl(floor) AS (VALUES (0), (4), (8)), sw(t) AS (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0)),
    e AS (SELECT cell_id, m, floor, t, 100.0::DOUBLE * count(*) FILTER (WHERE tp_bin >= floor AND swell > t) / count(*) AS exc FROM obs, fl, sw GROUP BY cell_id, m, floor, t),
    s AS (SELECT cell_id, floor, t, sum(w * exc) / sum(w) AS exc FROM e JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY cell_id, floor, t),
    mm AS (SELECT cell_id, m, avg(swell) FILTER (WHERE tp_bin >= 3) AS mean, avg(windsea) FILTER (WHERE windsea > 0) AS wind FROM obs GROUP BY cell_id, m),
    ms AS (SELECT cell_id, sum(w * mean) / sum(w) AS mean, sum(w * wind) / sum(w) FILTER (WHERE wind IS NOT NULL) AS wind FROM mm JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY cell_id)"""


@query(f"WITH {_SWELL} SELECT cell_id, floor, t, round(exc, 4) AS exc, round(mean, 6) AS mean, round(wind, 6) AS wind FROM s JOIN ms USING (cell_id)")
def swell_summary(spark, sf_dir):
    return R.swell_summary(B.obs(spark, sf_dir), SUMMER, FLOORS, SWELL_T).select("cell_id", "floor", "t", r(F.col("exc")).alias("exc"), r(F.col("mean"), 6).alias("mean"), r(F.col("wind"), 6).alias("wind"))


def _swell_curve(spark, sf_dir):
    return R.swell_summary(B.obs(spark, sf_dir), SUMMER, FLOORS, SWELL_T).select("cell_id", "floor", "t", F.col("exc").alias("p"))


@query(
    f"""WITH {_SWELL} SELECT cell_id, floor, round(max(exc) FILTER (WHERE t = 1.0) + (max(exc) FILTER (WHERE t = 2.0) - max(exc) FILTER (WHERE t = 1.0)) * 0.5, 4) AS at_1_5,
    round(max(exc) FILTER (WHERE t = 0.5), 4) AS at_0_3, CAST(NULL AS DOUBLE) AS at_6 FROM s GROUP BY cell_id, floor"""
)
def swell_at(spark, sf_dir):
    found = R.exceeded_at_each(_swell_curve(spark, sf_dir), (1.5, 0.3, 6.0), ("cell_id", "floor"), anchored=False)
    return found.select("cell_id", "floor", *(r(F.get("each", F.lit(k))["p"]).alias(name) for k, name in enumerate(("at_1_5", "at_0_3", "at_6"))))


SIX = (0.3, 0.75, 1.0, 1.5, 3.0, 6.0)


@query(
    f"""WITH {_SWELL}, c AS (SELECT cell_id, floor, list(exc ORDER BY t) AS p FROM s GROUP BY cell_id, floor)
    SELECT cell_id, floor, h, round(p, 4) AS p FROM (SELECT cell_id, floor, unnest([{', '.join(f'{h}::DOUBLE' for h in SIX)}]) AS h, unnest([p[1], p[1] + (p[2] - p[1]) * 0.5, p[2], p[2] + (p[3] - p[2]) * 0.5, p[3] + (p[4] - p[3]) * 0.5, NULL]) AS p FROM c)"""
)
def swell_heights(spark, sf_dir):
    """The swell panel's six heights, of each period and above, in one pass over the curve."""
    found = R.exceeded_at_each(_swell_curve(spark, sf_dir), SIX, ("cell_id", "floor"), anchored=False)
    return found.select("cell_id", "floor", F.explode("each").alias("e")).select("cell_id", "floor", "e.h", r(F.col("e.p")).alias("p"))


def _p99(spark, sf_dir):
    return quantiles(B.obs(spark, sf_dir), ["cell_id", "m"], "hs", {"p99": 0.99, "p999": 0.999})


@query(f"WITH {OBS} SELECT cell_id, m, round(quantile_cont(hs, 0.99), 6) AS p99, round(quantile_cont(hs, 0.999), 6) AS p999 FROM obs GROUP BY cell_id, m")
def monthly_p99(spark, sf_dir):
    return _p99(spark, sf_dir).select("cell_id", "m", r(F.col("p99"), 6).alias("p99"), r(F.col("p999"), 6).alias("p999"))


@query(f"WITH {OBS}, q AS (SELECT cell_id, m, quantile_cont(hs, 0.99) AS p99 FROM obs GROUP BY cell_id, m) SELECT cell_id, round(max(p99) FILTER (WHERE m IN (5, 6, 7)), 6) AS max_p99, arg_min(m, (-round(p99, 9), m)) AS roughest FROM q GROUP BY cell_id HAVING count(*) FILTER (WHERE m IN (5, 6, 7)) > 0")
def roughest_month(spark, sf_dir):
    return R.extremes_summary(_p99(spark, sf_dir), SUMMER).select("cell_id", r(F.col("max_p99"), 6).alias("max_p99"), "roughest")


@query(f"WITH {OBS} SELECT cell_id, round(quantile_cont(hs, 0.99), 6) AS p99_all, round(quantile_cont(hs, 0.999), 6) AS p999_all FROM obs GROUP BY cell_id")
def annual_p999(spark, sf_dir):
    return quantiles(B.obs(spark, sf_dir), ["cell_id"], "hs", {"p99_all": 0.99, "p999_all": 0.999}).withColumns({c: r(F.col(c), 6) for c in ("p99_all", "p999_all")})


@query(f"WITH {OBS}, {DAYS}, mm AS (SELECT cell_id, m, avg(wind) AS mean, quantile_cont(wind, 0.9) AS p90 FROM obs GROUP BY cell_id, m) SELECT cell_id, round(sum(w * mean) / sum(w), 6) AS mean, round(sum(w * p90) / sum(w), 6) AS p90 FROM mm JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY cell_id")
def wind_summary(spark, sf_dir):
    months = quantiles(B.obs(spark, sf_dir), ["cell_id", "m"], "wind", {"p90": 0.9}, mean="mean")
    days = N.month_days(F.col("m"))
    return R.selected(months, SUMMER).groupBy("cell_id").agg(r(N.weighted(F.col("mean"), days), 6).alias("mean"), r(N.weighted(F.col("p90"), days), 6).alias("p90"))


PROBS = (0.1, 0.5, 0.9, 0.99)


@query(
    f"""WITH RECURSIVE {OBS}, {DAYS}, q AS (SELECT cell_id, m, w, quantile_cont(wind, [0.1, 0.5, 0.9, 0.99]) AS v FROM obs JOIN days USING (m) WHERE m IN (5, 6, 7) GROUP BY cell_id, m, w),
    knots AS (SELECT cell_id, m, w, unnest([0.0::DOUBLE, v[1], v[2], v[3], v[4]]) AS x0, unnest([v[1], v[2], v[3], v[4], v[4] * 1.1 + 0.5]) AS x1, unnest([0.0::DOUBLE, 0.1, 0.5, 0.9, 0.99]) AS p0, unnest([0.1::DOUBLE, 0.5, 0.9, 0.99, 1.0]) AS p1 FROM q),
    total AS (SELECT cell_id, sum(w) AS tw FROM q GROUP BY cell_id),
    steps AS (SELECT cell_id, 0 AS i, 0.0::DOUBLE AS lo, 80.0::DOUBLE AS hi FROM total
      UNION ALL SELECT s.cell_id, s.i + 1, CASE WHEN f.cdf < 0.9 THEN (s.lo + s.hi) / 2 ELSE s.lo END, CASE WHEN f.cdf < 0.9 THEN s.hi ELSE (s.lo + s.hi) / 2 END
      FROM steps s JOIN LATERAL (SELECT sum(k.w * CASE WHEN (s.lo + s.hi) / 2 >= k.x1 THEN k.p1 - k.p0 WHEN (s.lo + s.hi) / 2 > k.x0 THEN (k.p1 - k.p0) * ((s.lo + s.hi) / 2 - k.x0) / (k.x1 - k.x0) ELSE 0 END) / any_value(t.tw) AS cdf FROM knots k JOIN total t USING (cell_id) WHERE k.cell_id = s.cell_id) f ON true WHERE s.i < 60)
    SELECT cell_id, round((lo + hi) / 2, 6) AS q FROM steps WHERE i = 60"""
)
def wind_pooled_p90(spark, sf_dir):
    found = quantiles(B.obs(spark, sf_dir), ["cell_id", "m"], "wind", {f"q{k}": p for k, p in enumerate(PROBS)})
    months = found.select("cell_id", "m", F.array(*(f"q{k}" for k in range(len(PROBS)))).alias("q"), F.array(*map(F.lit, PROBS)).alias("qp"))
    return R.pooled_quantile(months, SUMMER, 0.9).select("cell_id", r(F.col("q"), 6).alias("q"))


_DIURNAL = f"{SEQ}, s AS (SELECT site, slot, avg(hs) AS hs FROM seq GROUP BY site, slot)"


@query(
    f"""WITH {_DIURNAL} SELECT site, slot, round(hs, 6) AS hs, row_number() OVER (PARTITION BY site ORDER BY round(hs, 9), slot) = 1 AS is_calm, row_number() OVER (PARTITION BY site ORDER BY round(hs, 9) DESC, slot) = 1 AS is_rough,
    round((max(hs) OVER (PARTITION BY site) - min(hs) OVER (PARTITION BY site)) / nullif(avg(hs) OVER (PARTITION BY site), 0), 6) AS span FROM s"""
)
def diurnal_profile(spark, sf_dir):
    return R.diurnal(B.seq(spark, sf_dir)).withColumns({"hs": r(F.col("hs"), 6), "span": r(F.col("span"), 6)})


@query(f"WITH {_DIURNAL} SELECT site, arg_min(slot, (round(hs, 9), slot)) AS calm_slot, arg_min(slot, (-round(hs, 9), slot)) AS rough_slot FROM s GROUP BY site")
def calm_rough_slot(spark, sf_dir):
    slots = R.diurnal(B.seq(spark, sf_dir))
    return slots.groupBy("site").agg(F.min(F.when(F.col("is_calm"), F.col("slot"))).alias("calm_slot"), F.min(F.when(F.col("is_rough"), F.col("slot"))).alias("rough_slot"))


_PHASES = f"""{OBS}, {THR}, e AS (SELECT cell_id, phase, m, t, 100.0::DOUBLE * count(*) FILTER (WHERE hs > t) / count(*) AS p FROM obs, thr WHERE m IN (5, 6, 7) GROUP BY ALL),
    a AS ({curve_at(H, 'cell_id, phase, m', 'e')}), mm AS (SELECT cell_id, phase, m, count(*) AS n, avg(hs) AS mean FROM obs WHERE m IN (5, 6, 7) GROUP BY ALL),
    s AS (SELECT cell_id, phase, sum(n * p) / sum(n) AS pct, sum(n * mean) / sum(n) AS mean, floor(sum(n) / (8 * 30.4::DOUBLE * count(*)) + 0.5)::INT AS years FROM mm JOIN a USING (cell_id, phase, m) GROUP BY cell_id, phase)"""


@query(f"WITH {_PHASES} SELECT cell_id, phase, round(pct, 4) AS pct, round(mean, 6) AS mean, years FROM s QUALIFY count(*) OVER (PARTITION BY cell_id) >= 2")
def enso_split(spark, sf_dir):
    return R.by_phase(B.obs(spark, sf_dir), SUMMER, H).select("cell_id", "phase", r(F.col("pct")).alias("pct"), r(F.col("mean"), 6).alias("mean"), "years")


@query(
    f"""WITH {_PHASES}, q AS (SELECT cell_id, max(round(pct, 6)) AS hi, min(round(pct, 6)) AS lo FROM s GROUP BY cell_id HAVING count(*) >= 2)
    SELECT cell_id, floor(round(100 * (hi - lo) / greatest(lo, 0.1), 6) + 0.5)::INT AS rel, floor(round(100 * (hi - lo) / greatest(lo, 0.1), 6) + 0.5) >= 10 AND hi - lo >= 1 AS rougher FROM q"""
)
def enso_difference(spark, sf_dir):
    ends = R.by_phase(B.obs(spark, sf_dir), SUMMER, H).groupBy("cell_id").agg(F.max(r(F.col("pct"), 6)).alias("hi"), F.min(r(F.col("pct"), 6)).alias("lo"))
    rel = F.floor(r(100 * (F.col("hi") - F.col("lo")) / F.greatest("lo", F.lit(0.1)), 6) + 0.5).cast("int")
    return ends.select("cell_id", rel.alias("rel"), ((rel >= 10) & (F.col("hi") - F.col("lo") >= 1)).alias("rougher"))


RUN_LIMIT = 3.0
_RUNS = f"""{SEQ}, marked AS (SELECT *, hs < {RUN_LIMIT} AS calm, row_number() OVER (PARTITION BY site ORDER BY ts, event_id) - row_number() OVER (PARTITION BY site, hs < {RUN_LIMIT} ORDER BY ts, event_id) AS run FROM seq),
    runs AS (SELECT site, run, min(ts) AS start, count(*) AS samples, 3.0::DOUBLE * count(*) AS hours FROM marked WHERE calm GROUP BY site, run),
    binned AS (SELECT site, CASE WHEN hours <= 6 THEN 0 WHEN hours <= 12 THEN 1 WHEN hours <= 24 THEN 2 WHEN hours <= 48 THEN 3 WHEN hours <= 72 THEN 4 WHEN hours <= 120 THEN 5 ELSE 6 END AS bin, count(*) AS runs FROM runs GROUP BY ALL)"""


@query(f"WITH {_RUNS} SELECT site, start, samples::BIGINT AS samples, hours FROM runs")
def weather_runs(spark, sf_dir):
    return P.calm_runs(B.seq(spark, sf_dir), RUN_LIMIT).select("site", "start", "samples", "hours")


@query(f"WITH {_RUNS} SELECT site, sum(CASE WHEN bin > 1 THEN runs ELSE 0 END)::DOUBLE AS longer FROM binned GROUP BY site")
def windows_longer_than(spark, sf_dir):
    return P.longer_than(P.runs_by_bin(P.calm_runs(B.seq(spark, sf_dir), RUN_LIMIT), ["site"]), 1, ["site"])


def _month_bins(spark, sf_dir):
    """Bins of runs for each cell and month, made up from counts of samples, with the share of time over 2.2 m."""
    bins = {f"b{b}": F.count_if((F.col("tp_bin") % 7 == b) & (F.col("hs") < 4)) / F.lit(2.0 + b) for b in range(7)}
    return R.exceedance_at(B.obs(spark, sf_dir), (H,), ("cell_id", "m"), bins).withColumn("p", F.get("each", F.lit(0))["p"])


def _periods(spark, sf_dir, edge=2):
    return _month_bins(spark, sf_dir).select("cell_id", "m", P.periods([F.col(f"b{b}") for b in range(7)], F.col("p"), F.col("m"), edge).alias("v"))


def _periods_sql(edge: int = 2) -> str:
    lows, ups, d = [0, *WINDOW_EDGES], [*WINDOW_EDGES, 240], WINDOW_EDGES[edge]
    add = lambda f: " + ".join(f for f in f)
    later = range(edge + 1, 7)
    return f"""{OBS}, {THR}, {EXC}, {DAYS}, mc AS (SELECT cell_id, m, t, exc AS p FROM exc), pp AS ({curve_at(H, 'cell_id, m', 'mc')}),
    b AS (SELECT cell_id, m, {', '.join(f'count(*) FILTER (WHERE tp_bin % 7 = {k} AND hs < 4) / {2.0 + k}::DOUBLE AS b{k}' for k in range(7))} FROM obs GROUP BY cell_id, m),
    x AS (SELECT cell_id, m, w * 24 AS mh, greatest(0, 100 - p) / 100 * (w * 24) AS calm, {add(f'b{k} * {BIN_MEAN_H[k]}' for k in range(edge + 1))} AS short, {add(f'b{k}' for k in later)} AS ln, {add(f'b{k} * {lows[k]}' for k in later)} AS lo, {add(f'b{k} * {ups[k]}' for k in later)} AS hi, {add(f'b{k} * {lows[k] // d}' for k in later)} AS least, b6 FROM b JOIN pp USING (cell_id, m) JOIN days USING (m)),
    z AS (SELECT *, least(hi, greatest(lo, calm - short)) AS lh, ln - b6 * (calm / mh) AS loss FROM x),
    per AS (SELECT cell_id, m, floor(greatest(0, greatest(least, least(lh / {d} - loss * ({d} - 3) / (2.0 * {d}), lh / {d}, floor(mh / {d})))) * 10 + 0.5) / 10 AS v FROM z)"""


@query(f"WITH {_periods_sql()} SELECT cell_id, m, v FROM per".replace("greatest(least, least(", "greatest(z.least, least("))
def window_periods(spark, sf_dir):
    return _periods(spark, sf_dir)


@query(f"WITH {_periods_sql()} SELECT cell_id, round(avg(v), 6) AS mean, arg_min(m, (round(v / w, 9), m)) AS worst FROM per JOIN days USING (m) GROUP BY cell_id".replace("greatest(least, least(", "greatest(z.least, least("))
def worst_window_month(spark, sf_dir):
    return P.worst_month(_periods(spark, sf_dir), "cell_id").select("cell_id", r(F.col("mean"), 6).alias("mean"), "worst")


_MAXIMA = f"""{OBS}, {CELLS}, s AS (SELECT o.cell_id, (CASE WHEN lat >= -1e-6 AND month(ts) < 7 THEN year(ts) - 1 ELSE year(ts) END)::INT AS season, hs, ts FROM obs o JOIN cells USING (cell_id)),
    am AS (SELECT cell_id, season, max(hs) AS hs, arg_min(ts, (-hs, ts)) AS top_ts FROM s GROUP BY cell_id, season)"""


def _maxima(spark, sf_dir):
    return X.annual_maxima(B.obs(spark, sf_dir), B.cells(spark, sf_dir))


@query(f"WITH {_MAXIMA} SELECT cell_id, season, hs, month(top_ts)::INT AS month, day(top_ts)::INT AS day FROM am")
def annual_maxima(spark, sf_dir):
    return _maxima(spark, sf_dir)


@query(f"WITH {_MAXIMA} SELECT cell_id, season, hs, month(top_ts)::INT AS month, day(top_ts)::INT AS day FROM am QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY hs DESC, season) = 1")
def biggest_sea(spark, sf_dir):
    return X.record(_maxima(spark, sf_dir))


_LEVELS = f"""{_MAXIMA}, f AS (SELECT cell_id, count(*) AS n, avg(hs) AS mean, stddev_samp(hs) AS sd FROM am GROUP BY cell_id HAVING count(*) >= 3),
    k AS (SELECT *, -sqrt(6.0) / pi() * (0.5772156649015329 + ln(-ln(1 - 1.0::DOUBLE / rp))) AS fac FROM f, (VALUES (10), (50), (100)) v(rp)),
    lv AS (SELECT cell_id, n, rp, mean + fac * sd AS hs, sd / sqrt(n) * sqrt(1 + 1.1396 * fac + 1.1 * fac * fac) AS se FROM k)"""


@query(f"WITH {_LEVELS} SELECT cell_id, n::BIGINT AS n, rp, round(hs, 6) AS hs, round(se, 6) AS se FROM lv")
def return_levels(spark, sf_dir):
    return X.return_levels(_maxima(spark, sf_dir)).select("cell_id", "n", "rp", r(F.col("hs"), 6).alias("hs"), r(F.col("se"), 6).alias("se"))


@query(f"WITH {_LEVELS} SELECT cell_id, rp, round(greatest(0, hs - 1.645 * se), 6) AS lo, round(hs + 1.645 * se, 6) AS hi, round(1.9 * hs, 6) AS single_wave FROM lv")
def rv_confidence(spark, sf_dir):
    lo, hi = X.confidence(F.col("hs"), F.col("se"))
    return X.return_levels(_maxima(spark, sf_dir)).select("cell_id", "rp", r(lo, 6).alias("lo"), r(hi, 6).alias("hi"), r(1.9 * F.col("hs"), 6).alias("single_wave"))


@query(f"WITH {_LEVELS}, alt AS (SELECT cell_id, quantile_cont(hs, 0.999) * 1.2 AS alt FROM obs GROUP BY cell_id) SELECT cell_id, coalesce(abs((alt - hs) / hs) > 0.15, false) AS disagrees FROM lv JOIN alt USING (cell_id) WHERE rp = 100")
def alt_method_flag(spark, sf_dir):
    other = quantiles(B.obs(spark, sf_dir), ["cell_id"], "hs", {"alt": 0.999}).withColumn("alt", F.col("alt") * 1.2)
    return X.return_levels(_maxima(spark, sf_dir)).filter("rp = 100").join(other, "cell_id").select("cell_id", X.disagrees(F.col("hs"), F.col("alt")).alias("disagrees"))


@query(
    f"""WITH {OBS}, s AS (SELECT cell_id, CASE WHEN m IN (11, 0, 1) THEN 'DJF' WHEN m IN (2, 3, 4) THEN 'MAM' WHEN m IN (5, 6, 7) THEN 'JJA' ELSE 'SON' END AS season, quantile_cont(hs, 0.99) * 1.05 AS v FROM obs GROUP BY ALL),
    a AS (SELECT cell_id, quantile_cont(hs, 0.99) AS v FROM obs GROUP BY cell_id) SELECT cell_id, season, CASE season WHEN 'DJF' THEN 'Dec to Feb' WHEN 'MAM' THEN 'Mar to May' WHEN 'JJA' THEN 'Jun to Aug' ELSE 'Sep to Nov' END AS label, round(least(s.v, a.v), 6) AS hs, s.v > a.v AS capped FROM s JOIN a USING (cell_id)"""
)
def season_cap(spark, sf_dir):
    from pelagos.functions.constants import SEASONS

    rows = B.obs(spark, sf_dir).withColumn("season", F.element_at(F.array(*(F.lit(s) for s in ("DJF", "DJF", "MAM", "MAM", "MAM", "JJA", "JJA", "JJA", "SON", "SON", "SON", "DJF"))), F.col("m") + 1))
    seasons = quantiles(rows, ["cell_id", "season"], "hs", {"v": 0.99}).withColumn("v", F.col("v") * 1.05)
    years = quantiles(rows, ["cell_id"], "hs", {"year": 0.99})
    cap, flag = X.capped(F.col("v"), F.col("year"))
    names = F.create_map(*(F.lit(x) for kv in SEASONS.items() for x in kv))
    return seasons.join(years, "cell_id").select("cell_id", "season", F.element_at(names, F.col("season")).alias("label"), r(cap, 6).alias("hs"), flag.alias("capped"))
