"""Values worked out by hand from the formulas, and identities that must hold."""

import pytest
from pyspark.sql import functions as F

from pelagos.functions import geo, text
from pelagos.plans import catalogue


def _one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_distances(spark):
    p = [F.lit(float(x)) for x in (51.5, 0, 40.7, -74, 0, 179.5, 0, -179.5)]
    a, b = _one(spark, geo.haversine_km(*p[:4]), geo.haversine_km(*p[4:]))
    assert a == pytest.approx(5579.3744, abs=1e-3) and b == pytest.approx(111.1949, abs=1e-3)


def test_longitudes_wrap(spark):
    assert _one(spark, *(geo.wrap_lon(F.lit(float(x))) for x in (180, -180, 540))) == (-180.0, -180.0, -180.0)


def test_percentages(spark):
    assert _one(spark, *(text.percent(F.lit(x).cast("double")) for x in (0.0, 0.04, 0.5, 9.96, 10.4, None))) == ("<0.1%", "<0.1%", "0.5%", "10.0%", "10%", "no data")
    assert _one(spark, *(text.days_a_month(F.lit(x)) for x in (0.1, 5.0, 20.0))) == ("under 0.1", "1.5", "6")


def test_compass(spark):
    assert _one(spark, *(text.compass(F.lit(x)) for x in (0.0, 11.25, 348.75, 285.0))) == ("N", "NNE", "N", "WNW")


def test_roses_sum_to_100_and_curves_fall(spark, sf):
    rose = catalogue.queries()["wave_rose"](spark, sf)
    assert {"cell_id", "sector", "pct"} <= set(rose.columns)
    for r in rose.groupBy("cell_id").agg(F.sum("pct").alias("s")).collect():
        assert r["s"] == pytest.approx(100, abs=0.01)
    last = {}
    for r in catalogue.queries()["exceed_curve"](spark, sf).orderBy("cell_id", "t").collect():
        assert r["p"] <= last.get(r["cell_id"], 100.0) + 1e-9
        last[r["cell_id"]] = r["p"]
