"""What tables and charts show: cuts, axes, curve points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.constants import DEFAULT_LIMIT, HIGHEST_LIMIT, LOWEST_LIMIT

SHOWN_TO = 6.0


def clean_limit(x: Column) -> Column:
    """A height that a user typed: to quarters, within bounds; the default if it is none."""
    h = x.try_cast("double")
    quarter = F.floor(h * 4 + 0.5).cast("double") / 4
    return F.when(h.isNull() | F.isnan(h) | (h <= 0), DEFAULT_LIMIT).otherwise(F.least(F.lit(HIGHEST_LIMIT), F.greatest(F.lit(LOWEST_LIMIT), quarter)))


def shown(thresholds: DataFrame, neighbours: bool = True) -> DataFrame:
    """(limit, t) to show: up to the first threshold at or over max(6, limit); of those half and whole metres, the limit, and with neighbours the rows beside it."""
    w = Window.partitionBy("limit").orderBy("t")
    up_to = F.greatest(F.lit(SHOWN_TO), F.col("limit")) - 0.001
    cut = thresholds.withColumn("over", F.sum(F.when(F.col("t") >= up_to, 1).otherwise(0)).over(w)).filter("over <= 1")
    marked = cut.withColumn("own", F.abs(F.col("t") - F.col("limit")) < 0.001)
    near = F.coalesce(F.lag("own").over(w), F.lit(False)) | F.coalesce(F.lead("own").over(w), F.lit(False))
    whole = F.abs(F.col("t") * 2 - F.floor(F.col("t") * 2 + 0.5)) < 1e-9
    return marked.withColumn("near", near).filter(whole | F.col("own") | (F.lit(neighbours) & F.col("near"))).select("limit", "t")


def curve_points(curve: DataFrame, by: str = "cell_id") -> DataFrame:
    """(by, t, p): the curve's points without missing ones, from (0, 100) on."""
    return curve.select(by).distinct().select(by, F.lit(0.0).alias("t"), F.lit(100.0).alias("p")).unionByName(curve.filter("p IS NOT NULL").select(by, "t", "p"))


def declutter(labels: DataFrame, box: float = 16.0, most: int = 130, view: str = "view") -> DataFrame:
    """Labels of each view, in order of rank, that overlap none kept before; at most so many a view (a limit of the feature).

    Greedy, so each view is one task's work; a view's labels are those of one screen.
    """
    import pandas as pd

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[float, float]] = []
        flags = []
        for x, y in pdf.sort_values(["rank", "label"])[["x", "y"]].itertuples(index=False):
            ok = len(kept) < most and all(abs(x - a) >= box or abs(y - b) >= box for a, b in kept)
            if ok:
                kept.append((x, y))
            flags.append(ok)
        return pdf.sort_values(["rank", "label"])[flags]

    return labels.groupBy(view).applyInPandas(keep, labels.schema)
