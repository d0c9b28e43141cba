"""Views that give the driver's tables a marine meaning. Every query goes through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of waves and wind: one row a sample, months 0 .. 11."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS cell_id",
        "l_shipdate AS ts",
        "CAST(year(l_shipdate) AS INT) AS y",
        "CAST(month(l_shipdate) - 1 AS INT) AS m",
        "l_quantity / 5D AS hs",
        "CAST(l_partkey % 14 AS INT) AS tp_bin",
        "CAST((l_partkey * 7 + l_orderkey * 13) % 360 AS INT) AS dir",
        "CAST(((l_partkey * 7 + l_orderkey * 13) % 360) DIV 30 AS INT) AS sector",
        "CAST(((l_orderkey * 17 + l_partkey * 3) % 360) DIV 30 AS INT) AS wind_sector",
        "l_extendedprice / 5000D AS wind",
        "l_quantity / 5D * (1D - l_discount) AS swell",
        "l_quantity / 5D * l_tax * 10D AS windsea",
        "CAST(year(l_shipdate) % 3 AS INT) AS phase",
    )


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of samples at sites, with three-hour slots."""
    return read(spark, sf_dir, "events").selectExpr("user_id AS site", "event_id", "ts", "CAST(hour(ts) DIV 3 AS INT) AS slot", "value / 50D AS hs", "CAST(get_json_object(props, '$.k') AS INT) AS k")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS cell_id", "CAST((s_suppkey * 53) % 170 - 85 AS DOUBLE) AS lat", "CAST((s_suppkey * 77) % 360 - 180 AS DOUBLE) AS lon", "s_acctbal AS balance")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS pt_id", "CAST((c_custkey * 37) % 170 - 85 AS DOUBLE) + 0.25D AS lat", "CAST((c_custkey * 91) % 360 - 180 AS DOUBLE) + 0.5D AS lon")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells, platforms, terminals and fields; depth 0 on some."""
    kind = "CASE WHEN p_type LIKE 'ECONOMY%' THEN 'well' WHEN p_type LIKE 'LARGE%' THEN 'fixed platform' WHEN p_type LIKE 'MEDIUM%' THEN 'lng terminal' WHEN p_type LIKE 'PROMO%' THEN 'well' ELSE 'field' END"
    status = "CASE p_size % 6 WHEN 0 THEN 'Producing' WHEN 1 THEN 'plugged and abandoned' WHEN 2 THEN 'Suspended' WHEN 3 THEN 'exploration drilling' WHEN 4 THEN '' ELSE 'in service' END"
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS asset_id", "p_name AS n", f"{kind} AS t", f"{status} AS s", "p_brand AS o", "CAST((p_size % 45) * 20 AS DOUBLE) AS d", "CAST((p_partkey * 29) % 170 - 85 AS DOUBLE) AS lat", "CAST((p_partkey * 83) % 360 - 180 AS DOUBLE) AS lon")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm tracks: delta-encoded points in the order of seq."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS track_id", "o_orderdate AS ts", "o_orderkey AS seq", "CAST(o_orderkey % 21 - 10 AS DOUBLE) AS dlat", "CAST(o_orderkey % 121 - 60 AS DOUBLE) AS dlon", "CAST(year(o_orderdate) AS INT) AS y", "CAST(month(o_orderdate) - 1 AS INT) AS m", "o_totalprice / 3500D AS w"
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A depth raster of 40 columns; elevations below 0 are sea."""
    return read(spark, sf_dir, "part").selectExpr("CAST(p_partkey DIV 40 AS INT) AS r", "CAST(p_partkey % 40 AS INT) AS c", "CASE WHEN p_partkey % 37 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(-(p_size * 20) AS DOUBLE) END AS elev")
