"""Weather windows: runs of calm samples, and periods of work that fit between storms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.constants import BIN_MEAN_H, OPEN_END_H, WINDOW_EDGES
from pelagos.functions.numeric import half_up, month_days


def calm_runs(seq: DataFrame, limit: float, hours: float = 3.0, by: str = "site", block_days: int = 365) -> DataFrame:
    """(by, start, samples, hours): stretches of consecutive samples below a limit.

    A series is cut into blocks of time, so that a site's samples are the work of as many tasks as it has blocks. Within a
    block a sample's number among all, less its number among those as calm, stays the same within a run. Runs at a block's
    edge go on in the next block that has samples; of a block only such runs, two at most, meet those of its neighbours.
    """
    order = [F.col("ts"), F.col("event_id")]
    block = [by, "_block"]
    dated = seq.withColumns({"_calm": F.coalesce(F.col("hs") < limit, F.lit(False)), "_block": F.floor(F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")) / block_days).cast("int")})
    numbered = dated.withColumn("_n", F.row_number().over(Window.partitionBy(*block).orderBy(*order)))
    marked = numbered.withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy(*block, "_calm").orderBy(*order)))
    parts = marked.groupBy(*block, "_calm", "_run").agg(F.min("ts").alias("start"), F.count("*").alias("samples"), F.min("_n").alias("_first"), F.max("_n").alias("_last"))
    # of the runs of rough weather those count that a block begins or ends with: they part what is calm on either side
    whole = Window.partitionBy(*block)
    ends = parts.withColumns({"_head": F.col("_first") == 1, "_tail": F.col("_last") == F.max("_last").over(whole)})
    inner = ends.filter("_calm AND NOT _head AND NOT _tail").select(by, "start", "samples")
    edges = ends.filter("_head OR _tail")
    along = Window.partitionBy(by).orderBy("_block", "_first")
    # an edge run goes on where the one before is as calm, ends its block, and this one begins its own
    joins = F.lag("_calm").over(along) & F.col("_calm") & F.lag("_tail").over(along) & F.col("_head")
    chained = edges.withColumn("_chain", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = chained.filter("_calm").groupBy(by, "_chain").agg(F.min("start").alias("start"), F.sum("samples").alias("samples")).drop("_chain")
    return inner.unionByName(merged).withColumn("hours", F.col("samples") * F.lit(float(hours)))


def duration_bin(hours: Column, edges: tuple = WINDOW_EDGES) -> Column:
    """0 for up to the first edge, and so on; the last bin is open."""
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(hours <= edges[k], k).otherwise(out)
    return out


def runs_by_bin(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.withColumn("bin", duration_bin(F.col("hours"))).groupBy(*by, "bin").agg(F.count("*").alias("runs"))


def longer_than(binned: DataFrame, edge: int, by: list[str]) -> DataFrame:
    """Runs longer than the edge with this index."""
    return binned.groupBy(*by).agg(half_up(F.sum(F.when(F.col("bin") > edge, F.col("runs")).otherwise(0)).cast("double"), 1).alias("longer"))


def periods(bins: list[Column], p: Column, month: Column, edge: int) -> Column:
    """How many periods of an edge's length fit into a month's calm spells, without overlap.

    bins: runs in each duration bin; p: percentage of time over the limit.
    """
    lows, ups, length = [0, *WINDOW_EDGES], [*WINDOW_EDGES, OPEN_END_H], float(WINDOW_EDGES[edge])
    month_h = month_days(month) * 24
    later = range(edge + 1, len(bins))
    total = lambda parts: sum(parts, F.lit(0.0))
    calm_h = F.greatest(F.lit(0.0), 100 - p) / 100 * month_h
    short_h = total(bins[b] * BIN_MEAN_H[b] for b in range(edge + 1))
    long_n = total(bins[b] for b in later)
    long_h = F.least(total(bins[b] * float(ups[b]) for b in later), F.greatest(total(bins[b] * float(lows[b]) for b in later), calm_h - short_h))
    loss_n = long_n - bins[-1] * (calm_h / month_h)
    least = total(bins[b] * float(lows[b] // WINDOW_EDGES[edge]) for b in later)
    v = long_h / length - loss_n * (length - 3) / (2 * length)
    v = F.greatest(least, F.least(v, long_h / length, F.floor(month_h / length).cast("double")))
    return half_up(F.greatest(F.lit(0.0), v), 1)


def worst_month(values: DataFrame, by: str) -> DataFrame:
    """(by, mean, worst): unweighted mean of the months' values, and the first month with the least value a day."""
    a_day = F.round(F.col("v") / month_days(F.col("m")), 9)
    ranked = values.withColumn("rk", F.row_number().over(Window.partitionBy(by).orderBy(a_day, "m")))
    return ranked.groupBy(by).agg(F.avg("v").alias("mean"), F.min(F.when(F.col("rk") == 1, F.col("m"))).alias("worst"))
