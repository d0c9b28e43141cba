"""Annual maxima and return levels. The estimators here are this project's choice: Gumbel by moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.constants import EULER


def season_year(ts: Column, lat: Column) -> Column:
    """Northern seasons run from July and are named after the year in which they begin; southern ones are calendar years."""
    return F.when((lat >= -1e-6) & (F.month(ts) < 7), F.year(ts) - 1).otherwise(F.year(ts)).cast("int")


def annual_maxima(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, season, hs, month, day): the highest sample of each season, the earliest of equals. One aggregate, no sort."""
    rows = obs.select("cell_id", "ts", "hs").join(cells.select("cell_id", "lat"), "cell_id").withColumn("season", season_year(F.col("ts"), F.col("lat")))
    top = rows.groupBy("cell_id", "season").agg(F.max("hs").alias("hs"), F.min_by("ts", F.struct(-F.col("hs"), "ts")).alias("at"))
    return top.select("cell_id", "season", "hs", F.month("at").alias("month"), F.dayofmonth("at").alias("day"))


def record(maxima: DataFrame) -> DataFrame:
    """The biggest sea of each cell's record, the first of equals."""
    rk = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.col("hs").desc(), "season"))
    return maxima.withColumn("rk", rk).filter("rk = 1").drop("rk")


def return_levels(maxima: DataFrame, periods: tuple = (10, 50, 100), min_years: int = 3) -> DataFrame:
    """(cell_id, n, rp, hs, se): Gumbel levels by the method of moments, with their standard errors."""
    fit = maxima.groupBy("cell_id").agg(F.count("*").alias("n"), F.avg("hs").alias("mean"), F.stddev_samp("hs").alias("sd")).filter(F.col("n") >= min_years)
    levels = fit.select("cell_id", "n", "mean", "sd", F.explode(F.array(*(F.lit(p) for p in periods))).alias("rp"))
    factor = -F.sqrt(F.lit(6.0)) / F.pi() * (F.lit(EULER) + F.log(-F.log(1 - F.lit(1.0) / F.col("rp"))))
    se = F.col("sd") / F.sqrt(F.col("n").cast("double")) * F.sqrt(1 + 1.1396 * factor + 1.1 * factor * factor)
    return levels.select("cell_id", "n", "rp", (F.col("mean") + factor * F.col("sd")).alias("hs"), se.alias("se"))


def confidence(hs: Column, se: Column) -> tuple[Column, Column]:
    """Ninety per cent range; heights are not below 0."""
    return F.greatest(F.lit(0.0), hs - 1.645 * se), hs + 1.645 * se


def disagrees(one: Column, other: Column) -> Column:
    """Whether two methods differ by more than 15 per cent."""
    return F.coalesce(F.abs(F.try_divide(other - one, one)) > 0.15, F.lit(False))


def capped(seasonal: Column, year: Column) -> tuple[Column, Column]:
    """A season's level, at most that of the whole year, and whether it had to be cut."""
    return F.least(seasonal, year), seasonal > year
