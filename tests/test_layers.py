"""Tiles as a source, nested layouts, an index of edges, exact quantiles and lookups in layers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pelagos.operators import lookup as K
from pelagos.operators import rollup as R
from pelagos.operators import spatial as S
from pelagos.operators.quantile import quantiles
from pelagos.sources import catalogue as C
from pelagos.sources import nested as N
from pelagos.sources import tile_source as T


@pytest.fixture
def folder(tmp_path):
    """Four tiles; one of them cannot be read."""
    for name in ("t_0_0", "t_0_10", "t_10_0"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"lat": [1.0, 2.0], "lon": [3.0, 4.0], "mean": [[10] * 12, [-1] * 12]}))
    (tmp_path / "t_-80_100.json").write_text("this is no tile")
    return str(tmp_path)


def test_tiles_that_are_not_asked_for_are_not_opened(spark, folder):
    T.register(spark)
    read = lambda **o: spark.read.format("marine_tiles").options(**o).load(folder)
    listed = json.dumps(["t_0_0", "t_10_0", "t_50_50"])
    assert {r.tile for r in read(tiles=listed).collect()} == {"t_0_0", "t_10_0"}  # one that is listed but absent gives none
    assert {r.tile for r in read(box="-5,5,2,30").collect()} == {"t_0_0", "t_0_10"}
    assert {r.tile for r in read(box="-5,5,-358,-351").collect()} == {"t_0_0"}
    assert {r.tile for r in read().filter("tile = 't_0_10'").collect()} == {"t_0_10"}
    assert read().filter("tile IN ('t_0_0', 't_99_99')").count() == 2
    assert read().filter("tile = 't_7_7'").count() == 0
    with pytest.raises(Exception, match="JSON"):
        read().collect()
    row = read(tiles=listed).filter("tile = 't_0_0' AND cell = 1").first()
    assert (row.lat, row.lon, row.mean, row.exc) == (2.0, 4.0, [-1] * 12, None)


def test_written_tiles_are_whole_or_absent(spark, tmp_path):
    T.register(spark)
    path = str(tmp_path / "out")
    body = json.dumps({"lat": [1.0], "lon": [2.0], "mean": [[5] * 12]})
    rows = spark.createDataFrame([(f"t_{k}_0", body) for k in range(0, 90, 10)], "tile string, body string").repartition(3)
    rows.write.format("marine_tiles").mode("append").save(path)
    assert spark.read.format("marine_tiles").load(path).count() == 9
    bad = rows.withColumn("body", F.when(F.col("tile") == "t_50_0", F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    other = str(tmp_path / "other")
    with pytest.raises(Exception, match="lost"):
        bad.write.format("marine_tiles").mode("append").save(other)
    assert spark.read.format("marine_tiles").load(other).count() == 0


MF = "struct<thresholds: array<double>, wind_q: array<double>, tp_hist: struct<nb: int>, radii_nm: array<double>, persist: struct<thresholds: array<double>, edges_h: array<int>>>"


def test_nested_layouts_follow_the_manifest(spark):
    mf = ([0.5, 1.0], None, (2,), [50.0], None)
    rows = spark.createDataFrame([(1, list(range(24)), [5] * 24, [-1] + [7] * 23, mf), (2, list(range(24)), [5] * 23, None, mf)], f"id int, exc array<int>, d array<int>, th array<int>, mf {MF}")
    got = {(r.month, r.threshold): r.value for r in N.long(rows.filter("id = 1"), "exc", ("id",)).collect()}
    assert len(got) == 24 and got[3, 1] == 0.7
    assert N.long(rows.filter("id = 1"), "d", ("id",)).count() == 0  # one radius: twelve numbers
    hist = N.long(rows, "th", ("id",)).collect()
    assert {(r.id, r.month, r.period, r.value) for r in hist if r.month < 2} == {(1, 0, 0, None), (1, 0, 1, None), (1, 1, 0, 0.7), (1, 1, 1, 0.7)}
    wide = rows.filter("id = 1").select(N.nested("exc").alias("e"), N.nested("th").alias("t"), N.nested("wq" if False else "d").alias("d")).first()
    assert wide.e[3] == [0.6, 0.7] and wide.t[0] is None and wide.t[1] == [0.7, 0.7] and wide.d is None
    short = rows.withColumn("exc", F.slice("exc", 1, 23))
    with pytest.raises(Exception, match="length its manifest gives"):
        N.long(short, "exc", ("id",)).collect()


def test_slack_of_999_minutes_is_none(spark):
    rows = spark.createDataFrame([(120, 999, 5), (-1, 998, 0)], "ts int, s25 int, ns int")
    got = rows.select(*N.tide({c: F.col(c) for c in rows.columns})).collect()
    assert [(r.spring, r.slack25, r.per_day, r.neap) for r in got] == [(1.2, None, 0.5, None), (None, 998.0, 0.0, None)]


def test_points_in_a_hundred_thousand_edges(spark):
    """12,500 octagons: the plan has a hash join on bands, and each centre lies in its own ring."""
    k = F.col("id")
    corner = [(1.0, 0.4), (0.4, 1.0), (-0.4, 1.0), (-1.0, 0.4), (-1.0, -0.4), (-0.4, -1.0), (0.4, -1.0), (1.0, -0.4)]
    x0, y0 = (k % 125) * 2.8 - 174, F.floor(k / 125) * 1.7 - 84
    rings = spark.range(12_500).select(F.lit(200).alias("level"), k.alias("ring"), x0.alias("x0"), y0.alias("y0"), F.posexplode(F.array(*(F.struct(F.lit(a * 1.3).alias("a"), F.lit(b * 0.8).alias("b")) for a, b in corner))).alias("seq", "c")).select("level", "ring", "seq", (F.col("x0") + F.col("c.a")).alias("x"), (F.col("y0") + F.col("c.b")).alias("y"))
    points = spark.range(12_500).select(k.alias("pt_id"), (y0 + F.when(k % 2 == 0, 0.1).otherwise(0.82)).alias("lat"), (x0 + 0.1).alias("lon"))
    found = S.crossings(points, S.edges(rings))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert {r.pt_id for r in found.collect()} == set(range(0, 12_500, 2))


def test_crossings_equal_a_plain_ray_cast(spark):
    rng = random.Random(3)
    rings = {(lv, g): [(rng.uniform(-30, 30), rng.choice([rng.uniform(-20, 20), float(rng.randrange(-20, 20))])) for _ in range(9)] for g in range(12) for lv in [g % 3]}
    points = [(k, float(rng.randrange(-20, 20)) if k % 3 else rng.uniform(-20, 20), rng.uniform(-32, 32)) for k in range(400)]
    want = set()
    for k, y, x in points:
        for lv in range(3):
            n = 0
            for (level, _), pts in rings.items():
                for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
                    n += level == lv and (y1 <= y < y2 or y2 <= y < y1) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x
            if n % 2:
                want.add((k, lv))
    table = spark.createDataFrame([(lv, g, s, *p) for (lv, g), pts in rings.items() for s, p in enumerate(pts)], "level int, ring int, seq int, x double, y double")
    got = S.crossings(spark.createDataFrame(points, "pt_id long, lat double, lon double"), S.edges(table), band=0.7)
    assert {(r.pt_id, r.level) for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 5, 100])
def test_quantiles_equal_the_built_in(spark, n):
    rng = random.Random(n)
    rows = spark.createDataFrame([(g, rng.choice([None, 1.0, 2.5, rng.random()])) for g in range(4) for _ in range(n)], "g int, x double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.g: [r[p] for p in probs] + [r.mean] for r in quantiles(rows, ["g"], "x", probs, mean="mean").collect()}
    want = {r.g: r.q + [r.m] for r in rows.filter("x IS NOT NULL").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, probs.values()))).alias("q"), F.avg("x").alias("m")).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for g in want for a, b in zip(got[g], want[g]))
    assert quantiles(rows.filter("g > 9"), ["g"], "x", probs).count() == 0


def test_many_heights_equal_one_at_a_time(spark):
    rng = random.Random(1)
    curve = spark.createDataFrame([(g, float(t), None if g % 3 == 2 and t == 3 else 100 - 7.0 * t + rng.random()) for g in range(6) for t in range(1, 8)] + [(9, 1.0, None), (9, 2.0, 4.0)], "cell_id int, t double, p double")
    heights = (-1.0, 0.0, 0.5, 1.0, 2.5, 3.0, 3.5, 7.0, 9.0)
    for anchored in (True, False):
        each = {(r.cell_id, e.h): (e.p, e.floor if anchored else None) for r in R.exceeded_at_each(curve, heights, anchored=anchored).collect() for e in r.each}
        for h in heights:
            for r in R.exceeded_at(curve, h, anchored=anchored).collect():
                p, flag = each[r.cell_id, h]
                assert (p is None) == (r.p is None) and (p is None or abs(p - r.p) < 1e-9), (r, p)
                assert not anchored or flag == bool(r.floor)


def test_layers_meet_in_one_join(spark):
    places = spark.createDataFrame([(1, 10.0, 10.0), (2, 0.0, 179.9), (3, -80.0, 0.0)], "pt_id int, lat double, lon double")
    cells = spark.createDataFrame([(1, 10.5, 10.0), (2, 10.0, 10.5), (3, 0.0, -179.9)], "id long, lat double, lon double")
    layers = [K.Layer("near", cells, 60.0), K.Layer("far", cells.filter("id <> 2"), 200.0), K.Layer("whole", cells, 23.0, K.whole_km, lambda d: d <= 22)]
    found = K.nearest_of_layers(places, layers, "pt_id")
    got = {r.pt_id: (r.near_id, r.far_id, r.whole_id) for r in found.collect()}
    assert got == {1: (2, 1, None), 2: (3, 3, 3), 3: (None, None, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = K.nearest_of_layers(places, layers, "pt_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 2  # the layers, and the places without any


def test_extremes_of_cells_that_share_a_place_keep_apart(spark):
    cells = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.0), (3, 10.0, 20.0), (3, 10.0, 20.0)], "cell_id long, lat double, lon double")
    extremes = spark.createDataFrame([(1, 10.0000002, 20.0, [5]), (3, 10.0000002, 20.0, [7]), (3, 10.0000002, 20.0, [7])], "cell_id long, lat double, lon double, rv array<int>")
    assert sorted((r.cell_id, r.rv) for r in C.at_exact_cell(cells, extremes, "cell_id").collect()) == [(1, [5]), (2, None), (3, [7]), (3, [7])]
