"""Exact quantiles that spill: values are counted, ranked by running sums of the counts, and read off by rank.

Counting is a partial aggregate, so that a value that occurs often costs one row; the ranking sorts and may spill. No
buffer holds a group's values, as that of the built-in percentile does. All probabilities come from one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], mean: str | None = None) -> DataFrame:
    """(keys, one column a name): quantiles by linear interpolation between neighbours, and the mean under a name of its own;
    nulls don't count, groups without a value have no row."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    order = group.orderBy("_v")
    ranked = counts.select(
        *keys, "_v", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"), "_n", F.lead("_v").over(order).alias("_next"), F.sum("_n").over(group).alias("_all")
    )
    found = {}
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_all") - 1)
        here = (F.floor(at) >= F.col("_end") - F.col("_n")) & (F.floor(at) < F.col("_end"))
        upper = F.when(F.ceil(at) < F.col("_end"), F.col("_v")).otherwise(F.col("_next"))
        found[name] = F.when(here, F.when(F.ceil(at) == F.floor(at), F.col("_v")).otherwise(F.col("_v") + (at - F.floor(at)) * (upper - F.col("_v"))))
    more = [(F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias(mean)] if mean else []
    return ranked.groupBy(*keys).agg(*(F.max(q).alias(name) for name, q in found.items()), *more)
