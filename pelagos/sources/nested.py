"""Nested layouts: what a cell's flat array means, by the sizes that its manifest gives.

A field is an array of scaled whole numbers with named axes, the first outermost. Sizes of axes come from the manifest
(thresholds, quantiles, limits, duration bins, periods, radii), so a field is read only where its length is their product:
a field of another length is absent, but for those that must fit, which raise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Axes and scale of each field. waves t_*, currents c_*, cyclones cyc_*, joint tables.
LAYOUTS = {
    "mean": (("month",), 10.0), "n": (("month",), 1.0), "tp": (("month",), 10.0), "exc": (("month", "threshold"), 10.0), "wd": (("month",), 1.0), "wp": (("month",), 1.0), "wr": (("month", "sector"), 1.0),
    "hx": (("month", "rank"), 10.0), "hxa": (("rank",), 10.0), "wm": (("month",), 10.0), "w9": (("month",), 10.0), "wq": (("month", "quantile"), 10.0), "vr": (("month", "sector"), 1.0),
    "pw": (("month", "limit", "bin"), 10.0), "th": (("month", "period"), 10.0), "pn": (("month", "phase"), 1.0), "pm": (("month", "phase"), 10.0), "pe": (("month", "phase", "threshold"), 10.0), "dh": (("month", "slot"), 10.0), "dw": (("month", "slot"), 10.0),
    "s5": (("month",), 100.0), "s9": (("month",), 100.0), "b5": (("month",), 100.0), "b9": (("month",), 100.0),
    "s": (("month", "radius"), 100.0), "d": (("month", "radius"), 10.0), "sa": (("radius",), 100.0), "w": (("radius",), 1.0), "pd": (("month", "radius", "phase"), 10.0),
}
#: Fields whose row of a month is missing as a whole where its first number is below 0, and fields without missing numbers.
BY_ROW, ALWAYS = ("wr", "vr", "wq", "th", "pw"), ("n", "pn", "s", "d", "w")
#: Fields that must fit.
MUST = ("exc",)
#: Single numbers of a current's tide, with their scale; slack times from 999 minutes stand for none.
TIDE = {"spring": ("ts", 100.0), "neap": ("tn", 100.0), "form": ("tf", 100.0), "bearing": ("tb", 1.0), "slack25": ("s25", 1.0), "slack50": ("s50", 1.0), "per_day": ("ns", 10.0), "bot_depth": ("bd", 1.0)}


def sizes(manifest: str = "mf") -> dict[str, Column]:
    """The size of each axis, from a column that holds a manifest; null where it says nothing. Fixed values where the format gives them."""
    m = lambda path: F.col(f"{manifest}.{path}")
    listed = lambda path: F.when(m(path).isNotNull(), F.size(m(path)))
    return {
        "month": F.lit(12), "sector": F.lit(12), "phase": F.lit(3), "slot": F.lit(8), "rank": F.lit(2),
        "threshold": listed("thresholds"), "quantile": listed("wind_q"), "period": m("tp_hist.nb"), "radius": listed("radii_nm"),
        "limit": F.coalesce(listed("persist.thresholds"), F.lit(5)), "bin": F.coalesce(listed("persist.edges_h"), F.lit(6)) + 1,
    }


def fits(field: str, manifest: str = "mf") -> Column:
    """Whether a cell's array has the length that the manifest asks for."""
    size = sizes(manifest)
    return F.coalesce(F.size(field) == reduce(lambda a, b: a * b, (size[axis] for axis in LAYOUTS[field][0])), F.lit(False))


def _length_error(field: str) -> Column:
    return F.raise_error(F.lit(f"field {field} does not have the length its manifest gives; read both again"))


def long(cells: DataFrame, field: str, by: tuple, manifest: str = "mf", value: str = "value") -> DataFrame:
    """(by, one column an axis from 0, value) of a field in cells (by, field, manifest)."""
    axes, scale = LAYOUTS[field]
    size = sizes(manifest)
    there = F.col(field).isNotNull() & fits(field, manifest)
    if field in MUST:
        there = F.when(F.col(field).isNull(), F.lit(False)).when(fits(field, manifest), F.lit(True)).otherwise(_length_error(field).cast("boolean"))
    rows = cells.filter(there).select(*by, *(size[axis].alias(f"_{axis}") for axis in axes), F.col(field).alias("_all"), F.posexplode(field).alias("_i", "_raw"))
    place, left = [], F.col("_i")
    for axis in reversed(axes):
        place.append((left % F.col(f"_{axis}")).cast("int").alias(axis))
        left = F.floor(left / F.col(f"_{axis}"))
    x = F.col("_raw") / scale
    if field in BY_ROW:
        row = F.lit(1) if len(axes) < 2 else reduce(lambda a, b: a * b, (F.col(f"_{axis}") for axis in axes[1:]))
        x = F.when(F.get("_all", (F.col("_i") - F.col("_i") % row).cast("int")) >= 0, x)
    elif field not in ALWAYS:
        x = F.when(F.col("_raw") >= 0, x)
    return rows.select(*by, *reversed(place), x.alias(value))


def nested(field: str, manifest: str = "mf") -> Column:
    """A field as arrays within arrays, one level an axis; null where it is absent or has another length."""
    axes, scale = LAYOUTS[field]
    size = [sizes(manifest)[axis] for axis in axes]

    def level(k: int, start: Column) -> Column:
        width = reduce(lambda a, b: a * b, size[k + 1 :], F.lit(1))

        def one(i: Column) -> Column:
            at = start + i * width
            if k + 1 < len(axes):
                inner = level(k + 1, at)
                return F.when(F.get(field, at.cast("int")) >= 0, inner) if k == 0 and field in BY_ROW else inner
            raw = F.get(field, at.cast("int"))
            return raw / scale if field in BY_ROW or field in ALWAYS else F.when(raw >= 0, raw / scale)

        return F.transform(F.sequence(F.lit(0), size[k] - 1), one)

    return F.when(fits(field, manifest), level(0, F.lit(0)))


def tide(raw: dict[str, Column]) -> list[Column]:
    """The single numbers of a current's cell (spring, neap, form, bearing, slack25, slack50, per_day, bot_depth), by their names on the wire; absent ones are null."""
    out = []
    for name, (field, scale) in TIDE.items():
        x = raw.get(field, F.lit(None).cast("int"))
        known = (x >= 0) & (x < 999) if name.startswith("slack") else x >= 0
        out.append(F.when(known, x / scale).alias(name))
    return out
