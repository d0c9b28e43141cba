"""Roll-ups over months of long-form climatologies.

A climatology has one row for a cell, a month and a key (threshold, sector, bin ...). Samples are counted once, with
partial aggregates before the shuffle; what follows works on those counts. Ties go to the smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.constants import THRESHOLDS
from pelagos.functions.numeric import month_days, weighted


def selected(df: DataFrame, months: list[int]) -> DataFrame:
    return df.filter(F.col("m").isin(months))


def exceedance(obs: DataFrame, thresholds: tuple = THRESHOLDS, keys: tuple = ("cell_id", "m"), value: str = "hs") -> DataFrame:
    """(keys, t, n, exc): percentage of samples over each threshold. One pass: a conditional count for each threshold, then unpivoted."""
    counts = obs.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col(value) > t).alias(f"c{k}") for k, t in enumerate(thresholds)))
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("t"), F.col(f"c{k}").alias("over")) for k, t in enumerate(thresholds)))
    long = counts.select(*keys, "n", F.explode(pairs).alias("x"))
    return long.select(*keys, F.col("x.t").alias("t"), "n", (F.lit(100.0) * F.col("x.over") / F.col("n")).alias("exc"))


def combine_months(exc: DataFrame, months: list[int], keys: tuple = ("cell_id",)) -> DataFrame:
    """(keys, t, p, n): mean exceedance of the months, weighted by their samples; missing values are left out for their threshold."""
    used = selected(exc, months).filter(F.col("n") > 0)
    return used.groupBy(*keys, "t").agg(weighted(F.col("exc"), F.col("n").cast("double")).alias("p"), F.sum("n").alias("n"))


def exceeded_at(curve: DataFrame, height: float, keys: tuple = ("cell_id",), anchored: bool = True) -> DataFrame:
    """(keys, p, floor): the curve (t, p) at a height, linear between thresholds.

    anchored: the curve starts at (0, 100) and stays at its last value beyond the last threshold, with floor true.
    Otherwise it stays at its first value before the first threshold and ends, as null, beyond the last.
    """
    point = F.struct("t", "p")
    known = F.col("p").isNotNull()
    ends = curve.groupBy(*keys).agg(
        F.min(point).alias("first"),
        F.max(F.when(known & (F.col("t") <= height), point)).alias("lo"),
        F.min(F.when(known & (F.col("t") > height), point)).alias("hi"),
    )
    line = lambda t0, p0: p0 + (F.col("hi.p") - p0) * (F.lit(float(height)) - t0) / (F.col("hi.t") - t0)
    if anchored:
        p = F.when(F.col("first.p").isNull(), None).when(F.lit(height <= 0), 100.0).when(F.col("hi").isNull(), F.col("lo.p")).when(F.col("lo").isNull(), line(F.lit(0.0), F.lit(100.0))).otherwise(line(F.col("lo.t"), F.col("lo.p")))
        return ends.select(*keys, p.alias("p"), (F.col("hi").isNull() & F.col("lo").isNotNull() & (F.col("lo.t") < height)).alias("floor"))
    p = F.when(F.col("lo").isNull(), F.col("first.p")).when(F.col("hi").isNull(), F.when(F.col("lo.t") == height, F.col("lo.p"))).otherwise(line(F.col("lo.t"), F.col("lo.p")))
    return ends.select(*keys, p.alias("p"))


def _at(points: Column, height: float, anchored: bool) -> Column:
    """What a curve, an array of (t, p) in ascending order, has at a height: as in exceeded_at."""
    h = F.lit(float(height))
    known = F.filter(points, lambda c: c["p"].isNotNull())
    below, above = F.filter(known, lambda c: c["t"] <= h), F.filter(known, lambda c: c["t"] > h)
    lo, hi, first = F.element_at(below, -1), F.get(above, F.lit(0)), F.get(points, F.lit(0))
    none, end = F.size(below) == 0, F.size(above) == 0
    line = lambda t0, p0: p0 + (hi["p"] - p0) * (h - t0) / (hi["t"] - t0)
    if anchored:
        p = F.when(first["p"].isNull(), None).when(h <= 0, 100.0).when(end, F.when(~none, lo["p"])).when(none, line(F.lit(0.0), F.lit(100.0))).otherwise(line(lo["t"], lo["p"]))
        return F.struct(h.alias("h"), p.alias("p"), F.coalesce(end & (lo["t"] < h), F.lit(False)).alias("floor"))
    p = F.when(none, first["p"]).when(end, F.when(lo["t"] == h, lo["p"])).otherwise(line(lo["t"], lo["p"]))
    return F.struct(h.alias("h"), p.alias("p"))


def exceeded_at_each(curve: DataFrame, heights: tuple, keys: tuple = ("cell_id",), anchored: bool = True) -> DataFrame:
    """(keys, each array<struct<h, p, floor>>): the curve (t, p) at many heights, by one aggregate; a curve has as many points as there are thresholds."""
    curves = curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "p"))).alias("_points"))
    return curves.select(*keys, F.array(*(_at(F.col("_points"), h, anchored) for h in heights)).alias("each"))


def exceedance_at(obs: DataFrame, heights: tuple, keys: tuple, more: dict[str, Column] | None = None, thresholds: tuple = THRESHOLDS, value: str = "hs") -> DataFrame:
    """(keys, n, more.., each): exceedance of each group at heights, with further aggregates of the same pass over the samples."""
    counts = obs.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col(value) > t).alias(f"_c{k}") for k, t in enumerate(thresholds)), *(a.alias(name) for name, a in (more or {}).items()))
    points = F.array(*(F.struct(F.lit(float(t)).alias("t"), (F.lit(100.0) * F.col(f"_c{k}") / F.col("n")).alias("p")) for k, t in enumerate(thresholds)))
    return counts.select(*keys, "n", *(more or {}), F.array(*(_at(points, h, True) for h in heights)).alias("each"))


def shares(obs: DataFrame, key: str, keys: tuple = ("cell_id", "m")) -> DataFrame:
    """(keys, key, pct): what percentage of a month's samples has each value of the key."""
    counts = obs.groupBy(*keys, key).agg(F.count("*").alias("n"))
    return counts.select(*keys, key, (F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("pct"))


def blended(share: DataFrame, key: str, months: list[int]) -> DataFrame:
    """(cell_id, key, pct, is_mode): the months' shares weighted by their days, to 100 per cent again, and the most frequent key."""
    sums = selected(share, months).groupBy("cell_id", key).agg(F.sum(month_days(F.col("m")) * F.col("pct")).alias("w"))
    cell = Window.partitionBy("cell_id")
    rank = F.row_number().over(cell.orderBy(F.round("w", 9).desc(), key))
    return sums.select("cell_id", key, (F.lit(100.0) * F.col("w") / F.sum("w").over(cell)).alias("pct"), (rank == 1).alias("is_mode"))


def prevailing(obs: DataFrame, months: list[int]) -> DataFrame:
    """(cell_id, sector, share, tp): the sector that most days' months have as their modal one, its mean share there, and the mean period."""
    share = shares(obs, "sector")
    modal = share.withColumn("rk", F.row_number().over(Window.partitionBy("cell_id", "m").orderBy(F.round("pct", 9).desc(), "sector"))).filter("rk = 1")
    days = month_days(F.col("m"))
    votes = selected(modal, months).groupBy("cell_id", "sector").agg(F.sum(days).alias("days"), (F.sum(days * F.col("pct")) / F.sum(days)).alias("share"))
    top = votes.withColumn("rk", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.col("days").desc(), "sector"))).filter("rk = 1")
    period = selected(obs.groupBy("cell_id", "m").agg(F.avg("tp_bin").alias("tp")), months).groupBy("cell_id").agg(weighted(F.col("tp"), days).alias("tp"))
    return top.join(period, "cell_id").select("cell_id", "sector", "share", "tp")


def monthly_means(obs: DataFrame, *names: str) -> DataFrame:
    return obs.groupBy("cell_id", "m").agg(F.count("*").alias("n"), *(F.avg(n).alias(n) for n in names))


def joint_table(obs: DataFrame, months: list[int]) -> DataFrame:
    """(hs_bin, tp_bin, cnt): plain sums of counts of height and period."""
    return selected(obs, months).groupBy(F.floor(F.col("hs") / 0.5).cast("int").alias("hs_bin"), "tp_bin").agg(F.count("*").alias("cnt"))


def with_margins(joint: DataFrame) -> DataFrame:
    """Per mille of all counts for each cell of the table, its rows, its columns and the whole."""
    cube = joint.cube("hs_bin", "tp_bin").agg(F.sum("cnt").alias("cnt"))
    total = joint.agg(F.sum("cnt").alias("total"))  # one row
    return cube.join(F.broadcast(total)).select("hs_bin", "tp_bin", "cnt", (F.lit(1000.0) * F.col("cnt") / F.col("total")).alias("permille"))


def swell_summary(obs: DataFrame, months: list[int], floors: tuple, thresholds: tuple) -> DataFrame:
    """(cell_id, floor, t, exc, mean, wind): swell of at least a period over a height, weighted by days.

    The mean shares the exceedance's denominator even where a month's mean is missing.
    """
    grid = [(f, t) for f in floors for t in thresholds]
    counts = obs.groupBy("cell_id", "m").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("tp_bin") >= 3, F.col("swell"))).alias("mean"),
        F.avg(F.when(F.col("windsea") > 0, F.col("windsea"))).alias("wind"),
        *(F.count_if((F.col("tp_bin") >= f) & (F.col("swell") > t)).alias(f"c{k}") for k, (f, t) in enumerate(grid)),
    )
    days = month_days(F.col("m"))
    sums = selected(counts, months).groupBy("cell_id").agg(
        F.sum(days).alias("den"), F.sum(days * F.col("mean")).alias("mean"), weighted(F.col("wind"), days).alias("wind"), *(F.sum(days * F.lit(100.0) * F.col(f"c{k}") / F.col("n")).alias(f"e{k}") for k in range(len(grid)))
    )
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("floor"), F.lit(float(t)).alias("t"), (F.col(f"e{k}") / F.col("den")).alias("exc")) for k, (f, t) in enumerate(grid))))
    return sums.select("cell_id", long.alias("x"), (F.col("mean") / F.col("den")).alias("mean"), "wind").select("cell_id", "x.*", "mean", "wind")


def diurnal(seq: DataFrame, by: str = "site") -> DataFrame:
    """(by, slot, hs, is_calm, is_rough, span): mean of each three-hour slot, the first calmest and roughest, and their difference over the mean of slots."""
    slots = seq.groupBy(by, "slot").agg(F.avg("hs").alias("hs"))
    w = Window.partitionBy(by)
    return slots.select(
        by,
        "slot",
        "hs",
        (F.row_number().over(w.orderBy(F.round("hs", 9), "slot")) == 1).alias("is_calm"),
        (F.row_number().over(w.orderBy(F.round("hs", 9).desc(), "slot")) == 1).alias("is_rough"),
        F.try_divide(F.max("hs").over(w) - F.min("hs").over(w), F.avg("hs").over(w)).alias("span"),
    )


def by_phase(obs: DataFrame, months: list[int], height: float) -> DataFrame:
    """(cell_id, phase, pct, mean, years) where at least two phases have samples: exceedance and mean weighted by samples."""
    found = exceedance_at(selected(obs, months), (height,), ("cell_id", "phase", "m"), {"mean": F.avg("hs")}).withColumn("p", F.get("each", F.lit(0))["p"])
    n = F.col("n").cast("double")
    sums = found.groupBy("cell_id", "phase").agg(weighted(F.col("p"), n).alias("pct"), weighted(F.col("mean"), n).alias("mean"), F.sum("n").alias("n"), F.count("*").alias("with_data"))
    years = F.floor(F.col("n") / (F.lit(8 * 30.4) * F.col("with_data")) + 0.5).cast("int")
    phases = F.count("pct").over(Window.partitionBy("cell_id"))
    return sums.withColumn("phases", phases).filter("phases >= 2").select("cell_id", "phase", "pct", "mean", years.alias("years"))


def extremes_summary(percentiles: DataFrame, months: list[int]) -> DataFrame:
    """(cell_id, max_p99, roughest): the highest monthly p99 of the months, and of all twelve the month that has it, the first of equals."""
    worst = percentiles.withColumn("rk", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.round("p99", 9).desc(), "m"))).filter("rk = 1").select("cell_id", F.col("m").alias("roughest"))
    return selected(percentiles, months).groupBy("cell_id").agg(F.max("p99").alias("max_p99")).join(worst, "cell_id")


def pooled_quantile(quantiles: DataFrame, months: list[int], prob: float, top_factor: float = 1.1, top_add: float = 0.5, high: float = 80.0) -> DataFrame:
    """(cell_id, q): where the months' mixed distribution reaches a probability.

    quantiles has, a cell and month, `q` (values at the probabilities `qp`). Each month's distribution runs linearly
    through its quantiles from 0 and on to top_factor * last + top_add; months weigh by their days. The mixture is linear
    between the values of any month, so that its slopes are summed up in their order and one line is solved; at most `high`.
    """
    rows = selected(quantiles, months).filter(F.col("q").isNotNull()).withColumn("w", month_days(F.col("m")))
    xs = F.concat(F.array(F.lit(0.0)), "q", F.array(F.element_at("q", -1) * top_factor + top_add))
    ps = F.concat(F.array(F.lit(0.0)), "qp", F.array(F.lit(1.0)))
    knots = rows.select("cell_id", "w", F.posexplode(F.arrays_zip(xs.alias("x"), ps.alias("p"))).alias("k", "knot"), xs.alias("xs"), ps.alias("ps"))
    x0, x1, p0, p1 = F.col("knot.x"), F.get("xs", F.col("k") + 1), F.col("knot.p"), F.get("ps", F.col("k") + 1)
    steps = knots.filter(x1.isNotNull()).select("cell_id", x0.alias("x0"), x1.alias("x1"), (F.col("w") * (p1 - p0)).alias("rise"), F.when(F.col("k") == 0, F.col("w")).otherwise(0.0).alias("weight"))
    # a step of no width is a jump; others begin a slope and end it
    slope = F.when(F.col("x1") > F.col("x0"), F.col("rise") / (F.col("x1") - F.col("x0"))).otherwise(0.0)
    jump = F.when(F.col("x1") > F.col("x0"), 0.0).otherwise(F.col("rise"))
    turn = lambda x, s, up, w: F.struct(x.alias("x"), s.alias("slope"), up.alias("jump"), w.alias("weight"))
    turns = steps.select("cell_id", F.explode(F.array(turn(F.col("x0"), slope, jump, F.col("weight")), turn(F.col("x1"), -slope, F.lit(0.0), F.lit(0.0)))).alias("t")).select("cell_id", "t.*")
    at = turns.groupBy("cell_id", "x").agg(F.sum("slope").alias("slope"), F.sum("jump").alias("jump"), F.sum("weight").alias("weight"))
    order, every = Window.partitionBy("cell_id").orderBy("x"), Window.partitionBy("cell_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    walked = at.withColumns({"total": F.sum("weight").over(every), "steep": F.coalesce(F.sum("slope").over(before), F.lit(0.0)), "gap": F.col("x") - F.coalesce(F.lag("x").over(order), F.col("x"))})
    reached = walked.withColumn("left", F.sum(F.col("steep") * F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("jump").over(before), F.lit(0.0)))
    goal = F.col("total") * prob
    hit = reached.filter(F.col("left") + F.col("jump") >= goal * (1 - 1e-12)).groupBy("cell_id").agg(F.min(F.struct("x", "left", "steep", "total")).alias("b"))
    over = F.col("b.left") - F.col("b.total") * prob
    return hit.select("cell_id", F.when((over > 0) & (F.col("b.steep") > 0), F.col("b.x") - over / F.col("b.steep")).otherwise(F.col("b.x")).alias("q")).withColumn("q", F.least("q", F.lit(high)))


def climatology(obs: DataFrame, thresholds: tuple = THRESHOLDS, swells: tuple = ()) -> DataFrame:
    """(cell_id, months): all a panel needs of a cell's months, in one pass over the samples.

    months is an array of at most twelve (m, n, over[], hs, tp, sectors[], bins[], swells[]): counts over each threshold,
    means, counts of the twelve sectors, runs in seven bins made up from counts of samples, and counts of swell over heights.
    """
    array = lambda parts: F.array(*parts)
    counts = obs.groupBy("cell_id", "m").agg(
        F.count("*").alias("n"), F.avg("hs").alias("hs"), F.avg("tp_bin").alias("tp"),
        *(F.count_if(F.col("hs") > t).alias(f"t{k}") for k, t in enumerate(thresholds)), *(F.count_if(F.col("sector") == k).alias(f"s{k}") for k in range(12)), *((F.count_if((F.col("tp_bin") % 7 == k) & (F.col("hs") < 4)) / F.lit(2.0 + k)).alias(f"b{k}") for k in range(7)),
        *(F.count_if(F.col("swell") > t).alias(f"w{k}") for k, t in enumerate(swells)),
    )
    month = F.struct("m", "n", "hs", "tp", array(f"t{k}" for k in range(len(thresholds))).alias("over"), array(f"s{k}" for k in range(12)).alias("sectors"), array(f"b{k}" for k in range(7)).alias("bins"), array(f"w{k}" for k in range(len(swells))).alias("swells"))
    return counts.groupBy("cell_id").agg(F.sort_array(F.collect_list(month)).alias("months"))


def _total(months: Column, value) -> Column:
    """Sum over months of what is not null; null without any."""
    some = F.filter(F.transform(months, value), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x))


def headline(cells: DataFrame, chosen: list[int], height: float, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """cells (cell_id, months as climatology gives them) with panels of the chosen months: over_limit (share of time over a height),
    floor, mean, sector with its share, tp, samples.

    Steps are columns of their own, so that the plan holds each once.
    """
    days = lambda x: month_days(x["m"])
    rows = cells.withColumn("_some", F.filter("months", lambda x: x["m"].isin(chosen) & (x["n"] > 0)))
    some = F.col("_some")
    rows = rows.withColumns({"_n": _total(some, lambda x: x["n"].cast("double")), "_days": _total(some, days)})
    ts = F.array(*(F.lit(float(t)) for t in thresholds))
    rows = rows.withColumn("_points", F.transform(ts, lambda t, k: F.struct(t.alias("t"), (F.lit(100.0) * _total(some, lambda x: F.get(x["over"], k).cast("double")) / F.col("_n")).alias("p"))))
    # each month votes for its most frequent sector, the first of equals, with its days
    votes = F.transform(some, lambda x: F.struct((F.array_position(x["sectors"], F.array_max(x["sectors"])) - 1).cast("int").alias("sector"), days(x).alias("days"), (F.lit(100.0) * F.array_max(x["sectors"]) / x["n"]).alias("pct")))
    rows = rows.withColumns({"_at": _at(F.col("_points"), height, True), "_votes": votes})
    sums = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.struct(_total(F.filter("_votes", lambda v: v["sector"] == k), lambda v: v["days"]).alias("days"), (-k).alias("first")))
    rows = rows.withColumn("_sums", F.filter(sums, lambda s: s["days"].isNotNull())).withColumn("sector", -F.array_max("_sums")["first"])
    own = F.filter("_votes", lambda v: v["sector"] == F.col("sector"))
    out = {
        "over_limit": F.col("_at.p"), "floor": F.col("_at.floor"), "mean": _total(some, lambda x: days(x) * x["hs"]) / F.col("_days"), "tp": _total(some, lambda x: days(x) * x["tp"]) / F.col("_days"),
        "share": _total(own, lambda v: v["days"] * v["pct"]) / _total(own, lambda v: v["days"]), "samples": F.col("_n").cast("long"),
    }
    return rows.withColumns(out).drop("_some", "_n", "_days", "_points", "_at", "_votes", "_sums")


def monthly_periods(cells: DataFrame, height: float, edge: int, periods, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """(cell_id, m, v): what `periods` (bins, p, m, edge) makes of each month's bins and share of time over a height."""
    each = cells.select("cell_id", F.explode("months").alias("x"))
    points = F.array(*(F.struct(F.lit(float(t)).alias("t"), (F.lit(100.0) * F.get("x.over", F.lit(k)) / F.col("x.n")).alias("p")) for k, t in enumerate(thresholds)))
    at = each.withColumn("_points", points).select("cell_id", F.col("x.m").alias("m"), F.col("x.bins").alias("bins"), _at(F.col("_points"), height, True).alias("_at"))
    flat = at.select("cell_id", "m", F.col("_at.p").alias("p"), *(F.get("bins", F.lit(k)).alias(f"b{k}") for k in range(7)))
    return flat.select("cell_id", "m", periods([F.col(f"b{k}") for k in range(7)], F.col("p"), F.col("m"), edge).alias("v"))


def swell_over(cells: DataFrame, chosen: list[int], height: float, swells: tuple) -> DataFrame:
    """cells (cell_id, months) with `swell`: share of time that swell of any period is over a height, by the counts that climatology gives; null beyond the last."""
    days = lambda x: month_days(x["m"])
    rows = cells.withColumn("_some", F.filter("months", lambda x: x["m"].isin(chosen) & (x["n"] > 0)))
    ts = F.array(*(F.lit(float(t)) for t in swells))
    points = F.transform(ts, lambda t, k: F.struct(t.alias("t"), (_total(F.col("_some"), lambda x: days(x) * F.lit(100.0) * F.get(x["swells"], k) / x["n"]) / _total(F.col("_some"), days)).alias("p")))
    return rows.withColumn("_points", points).withColumn("_at", _at(F.col("_points"), height, False)).withColumn("swell", F.col("_at.p")).drop("_some", "_points", "_at")
