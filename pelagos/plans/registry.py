"""Where queries are named, and the SQL parts that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pelagos.functions.constants import MONTH_DAYS, THRESHOLDS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


OBS = """obs AS (SELECT l_suppkey AS cell_id, l_shipdate AS ts, year(l_shipdate)::INT AS y, (month(l_shipdate) - 1)::INT AS m, l_quantity / 5.0::DOUBLE AS hs,
 (l_partkey % 14)::INT AS tp_bin, ((l_partkey * 7 + l_orderkey * 13) % 360)::INT AS dir, (((l_partkey * 7 + l_orderkey * 13) % 360) // 30)::INT AS sector,
 (((l_orderkey * 17 + l_partkey * 3) % 360) // 30)::INT AS wind_sector, l_extendedprice / 5000.0::DOUBLE AS wind, l_quantity / 5.0::DOUBLE * (1.0::DOUBLE - l_discount) AS swell,
 l_quantity / 5.0::DOUBLE * l_tax * 10.0::DOUBLE AS windsea, (year(l_shipdate) % 3)::INT AS phase FROM lineitem)"""
SEQ = "seq AS (SELECT user_id AS site, event_id, ts, (hour(ts) // 3)::INT AS slot, value / 50.0::DOUBLE AS hs, CAST(props::JSON ->> '$.k' AS INT) AS k FROM events)"
CELLS = "cells AS (SELECT s_suppkey AS cell_id, ((s_suppkey * 53) % 170 - 85)::DOUBLE AS lat, ((s_suppkey * 77) % 360 - 180)::DOUBLE AS lon, s_acctbal AS balance FROM supplier)"
POINTS = "points AS (SELECT c_custkey AS pt_id, ((c_custkey * 37) % 170 - 85)::DOUBLE + 0.25 AS lat, ((c_custkey * 91) % 360 - 180)::DOUBLE + 0.5 AS lon FROM customer)"
ASSETS = """assets AS (SELECT p_partkey AS asset_id, p_name AS n, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'well' WHEN p_type LIKE 'LARGE%' THEN 'fixed platform' WHEN p_type LIKE 'MEDIUM%' THEN 'lng terminal' WHEN p_type LIKE 'PROMO%' THEN 'well' ELSE 'field' END AS t,
 CASE p_size % 6 WHEN 0 THEN 'Producing' WHEN 1 THEN 'plugged and abandoned' WHEN 2 THEN 'Suspended' WHEN 3 THEN 'exploration drilling' WHEN 4 THEN '' ELSE 'in service' END AS s,
 p_brand AS o, ((p_size % 45) * 20)::DOUBLE AS d, ((p_partkey * 29) % 170 - 85)::DOUBLE AS lat, ((p_partkey * 83) % 360 - 180)::DOUBLE AS lon FROM part)"""
TRACKS = "tracks AS (SELECT o_custkey AS track_id, o_orderdate AS ts, o_orderkey AS seq, (o_orderkey % 21 - 10)::DOUBLE AS dlat, (o_orderkey % 121 - 60)::DOUBLE AS dlon, year(o_orderdate)::INT AS y, (month(o_orderdate) - 1)::INT AS m, o_totalprice / 3500.0::DOUBLE AS w FROM orders)"
GRID = "grid AS (SELECT (p_partkey // 40)::INT AS r, (p_partkey % 40)::INT AS c, CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE (-(p_size * 20))::DOUBLE END AS elev FROM part)"
THR = "thr(t) AS (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS) + ")"
DAYS = "days(m, w) AS (VALUES " + ", ".join(f"({k}, {d}::DOUBLE)" for k, d in enumerate(MONTH_DAYS)) + ")"
EXC = "exc AS (SELECT cell_id, m, t, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (WHERE hs > t) / count(*) AS exc FROM obs, thr GROUP BY cell_id, m, t)"
CURVE = "curve AS (SELECT cell_id, t, sum(n * exc) / sum(n) AS p, sum(n)::BIGINT AS n FROM exc WHERE m IN (5, 6, 7) GROUP BY cell_id, t)"


def curve_at(height: float, keys: str, curve: str = "curve") -> str:
    """A curve (keys, t, p) at a height: neighbours by max and min, from the anchor (0, 100)."""
    return f"""SELECT {keys}, CASE WHEN hi_t IS NULL THEN lo_p ELSE coalesce(lo_p, 100.0) + (hi_p - coalesce(lo_p, 100.0)) * ({height} - coalesce(lo_t, 0.0)) / (hi_t - coalesce(lo_t, 0.0)) END AS p,
      hi_t IS NULL AND lo_t < {height} AS floor
      FROM (SELECT {keys}, max(t) FILTER (WHERE t <= {height}) AS lo_t, arg_max(p, t) FILTER (WHERE t <= {height}) AS lo_p, min(t) FILTER (WHERE t > {height}) AS hi_t, arg_min(p, t) FILTER (WHERE t > {height}) AS hi_p FROM {curve} GROUP BY {keys})"""
