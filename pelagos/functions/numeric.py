"""Column expressions for numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagos.functions.constants import MONTH_DAYS


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded to so many digits, halves towards positive infinity."""
    k = F.lit(float(10**digits))
    return F.floor(x * k + 0.5).cast("double") / k


def month_days(month: Column) -> Column:
    """The weight of a month 0 .. 11."""
    return F.element_at(F.array(*(F.lit(float(d)) for d in MONTH_DAYS)), month.cast("int") + 1)


def weighted(value: Column, weight: Column) -> Column:
    """Weighted mean of the values that aren't null; null without any."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - a) / (b - a)))
    return t * t * (3 - 2 * t)


#: Lanczos' coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gamma(x: Column) -> Column:
    """The gamma function, by Lanczos' sum; below one half by reflection."""

    def upper(z: Column) -> Column:
        y = z - 1
        total = reduce(lambda a, b: a + b, [F.lit(LANCZOS[0]), *(F.lit(c) / (y + k) for k, c in enumerate(LANCZOS[1:], 1))])
        t = y + 7.5
        return F.sqrt(F.lit(2.0) * F.pi()) * F.pow(t, y + 0.5) * F.exp(-t) * total

    return F.when(x < 0.5, F.pi() / (F.sin(F.pi() * x) * upper(1 - x))).otherwise(upper(x))


def first_cap(value: Column, caps: tuple, factor: float) -> Column:
    """The first cap of at least factor times the value, else the last."""
    return F.coalesce(F.get(F.filter(F.array(*(F.lit(float(c)) for c in caps)), lambda c: c >= value * factor), F.lit(0)), F.lit(float(caps[-1])))
