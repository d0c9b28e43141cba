"""Streams of samples: exceedance counts that grow with each batch, and calm spells as session windows.

An extension: the counts of samples over each threshold add up, so that a stream keeps one row a cell, month and
threshold as its state, however long it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.functions.constants import THRESHOLDS


def exceedance_counts(samples: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """(cell_id, m, t, n, over) of a stream of (cell_id, ts, hs); for output modes complete and update."""
    month = (F.month("ts") - 1).cast("int").alias("m")
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("t"), (F.col("hs") > t).alias("over")) for t in thresholds))
    each = samples.filter("hs IS NOT NULL").select("cell_id", month, F.explode(pairs).alias("x"))
    return each.groupBy("cell_id", "m", F.col("x.t").alias("t")).agg(F.count("*").alias("n"), F.count_if("x.over").alias("over"))


def calm_spells(samples: DataFrame, limit: float, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(site, start, end, n): spells of samples under the limit, no two further apart than `gap`; a sample later than `late` is left out."""
    calm = samples.withWatermark("ts", late).filter(F.col("hs") < limit)
    spells = calm.groupBy("site", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return spells.select("site", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
