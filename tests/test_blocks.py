"""Series cut into blocks give what whole series give; rounds of a nearest search give what one search gives; sinks repeat safely."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pelagos.operators import panels as V
from pelagos.operators import persistence as P
from pelagos.operators import polyline as L
from pelagos.operators import lookup as K
from pelagos.operators import spatial as S
from pelagos.streaming import sink


def plain_runs(rows, limit):
    out = []
    for site in {r[0] for r in rows}:
        start, n = None, 0
        for _, ts, _, hs in sorted((r for r in rows if r[0] == site), key=lambda r: (r[1], r[2])) + [(site, None, None, None)]:
            if hs is not None and hs < limit:
                start, n = (ts if not n else start), n + 1
            elif n:
                out.append((site, start, n))
                n = 0
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("days", [1, 3, 1000])
def test_runs_go_on_across_blocks(spark, seed, days):
    import datetime as dt

    rng = random.Random(seed)
    calm = [0.5, 0.9, 0.02, 0.99][seed]
    rows = [(site, dt.datetime(2020, 1, 1) + dt.timedelta(hours=3 * rng.randrange(200)), k, None if rng.random() < 0.03 else 1.0 if rng.random() < calm else 5.0) for site in ("a", "b") for k in range(150)]
    df = spark.createDataFrame(rows, "site string, ts timestamp, event_id long, hs double")
    got = sorted((r.site, r.start, r.samples) for r in P.calm_runs(df, 3.0, block_days=days).collect())
    assert got == plain_runs(rows, 3.0)


def test_a_long_series_is_many_tasks_work(spark):
    """Two million samples of one site: no group of the first step holds more than a block's."""
    k = F.col("id")
    df = spark.range(2_000_000).select(F.lit("a").alias("site"), F.timestamp_seconds(k * 10_800).alias("ts"), k.alias("event_id"), F.when(k % 1000 < 900, 1.0).otherwise(5.0).alias("hs"))
    runs = P.calm_runs(df, 3.0)
    assert runs.count() == 2000 and runs.agg(F.min("samples"), F.max("samples")).first()[:] == (900, 900)


@pytest.mark.parametrize("days", [1, 40, 10_000])
def test_running_sums_across_blocks(spark, days):
    rng = random.Random(days)
    rows = [(t, f"2020-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d} 00:00:00", k, float(rng.randrange(-9, 9)), float(rng.randrange(-9, 9))) for t in range(3) for k in range(60)]
    df = spark.createDataFrame(rows, "track_id int, ts string, seq long, dlat double, dlon double").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.track_id, r.seq): (r.lat, r.lon) for r in L.decode(df, block_days=days).collect()}
    want, at = {}, {}
    for t, _, k, a, o in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        at[t] = (at.get(t, (0, 0))[0] + a, at.get(t, (0, 0))[1] + o)
        want[t, k] = (at[t][0] / 100, at[t][1] / 100)
    assert got == want


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return round(2 * 6371.0 * math.asin(min(1, math.sqrt(x))), 6)


def test_rounds_find_what_one_search_finds(spark):
    rng = random.Random(2)
    points = [(k, rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(150)] + [(900, 89.9, 10.0), (901, -89.9, -170.0), (902, 0.0, 180.0), (903, 10.0, 10.0)]
    cells = [(k, rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(300)] + [(1000, 10.0, 11.0), (1001, 10.0, 9.0)]
    df = S.nearest_in_rounds(spark.createDataFrame(points, "pt_id long, lat double, lon double"), spark.createDataFrame(cells, "cell_id long, lat double, lon double"), (50.0, 200.0, 700.0, 2000.0))
    want = {p[0]: min((km(*p[1:], *c[1:]), c[0]) for c in cells) for p in points}
    got = {r.pt_id: (r.km, r.cell_id) for r in df.collect()}
    assert got.keys() == {p for p, (d, _) in want.items() if d <= 2000} and all(abs(got[p][0] - want[p][0]) < 1e-5 and got[p][1] == want[p][1] for p in got)


def test_views_of_one_key_share_its_contours(spark):
    views = spark.createDataFrame([(1, 10.01, 10.9, 0.01, 0.9, 50.0), (2, 10.2, 10.8, 0.2, 0.8, 55.0), (3, 10.2, 10.8, 0.2, 0.8, None)], "view_id int, lat0 double, lat1 double, lon0 double, lon1 double, depth double")
    there = spark.createDataFrame([("d_10_0",)], "tile string")
    segments = spark.createDataFrame([("d_10_0", 50.0), ("d_10_0", 500.0), ("d_10_0", 60.0)], "tile string, level double")
    keyed, found = V.contours_of_views(views, there, segments, "view_id", 5)
    keys = {r.view_id: r.key for r in keyed.collect()}
    assert keys[1] == keys[2] != keys[3]
    assert sorted((r.key, r.level) for r in found.collect()) == sorted([(keys[1], 50.0), (keys[3], 500.0)])


def test_a_restarted_sink_writes_no_event_twice(spark, tmp_path):
    rows = spark.createDataFrame([(k % 40, f"2024-01-01 0{k % 9}:00:00", f"e{k % 40}") for k in range(60)], "event_id long, ts string, line string").withColumn("ts", F.to_timestamp("ts"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tries = []

    def written_but_not_told(batch, folder):
        batch.write.mode("overwrite").parquet(folder)
        tries.append(folder)
        if len(tries) == 2:
            raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        sink.append_once(stream(), out, state, write=written_but_not_told).trigger(availableNow=True).start().awaitTermination(120)
    sink.append_once(stream(), out, state).trigger(availableNow=True).start().awaitTermination(120)
    ids = [r.event_id for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(40))
    sink.append_once(stream(), out, state).trigger(availableNow=True).start().awaitTermination(120)  # nothing new
    assert spark.read.parquet(out).count() == 40


def test_event_lines_are_coded_as_addresses_are(spark):
    row = spark.createDataFrame([("a b&c", "é~!*'()/", None)], "x string, y string, z string").select(sink.event_line(F.lit("pv"), F.col("x"), F.col("y"), F.lit(True), {"k": F.col("z"), "n": F.lit(5)}).alias("line")).first()
    assert row.line == "e=pv&p=a%20b%26c&s=%C3%A9~!*'()%2F&t=1&n=5"


def test_points_and_cells_that_share_a_place_are_searched_once(spark, monkeypatch):
    """200 points at one place and 200 cells at another are one pair, not 40,000; ties go to the smaller id."""
    calls = spark.sparkContext.accumulator(0)

    def counted(a, b, c, d):
        calls.add(1)
        return 111.2 * max(abs(a - c), abs(b - d))

    monkeypatch.setattr(S.geo, "haversine_km", lambda *at: F.udf(counted, "double")(*at))
    points = spark.createDataFrame([(k, 10.0, 10.0) for k in range(200)], "pt_id long, lat double, lon double")
    cells = spark.createDataFrame([(k, 10.5, 10.0) for k in range(7, 207)], "cell_id long, lat double, lon double")
    land = spark.createDataFrame([(100, 190)], "i int, j int")
    layers = [K.Layer("near", cells.withColumnRenamed("cell_id", "id"), 60.0)]
    for find, got in (
        (lambda: S.nearest(points, cells, 100.0), "cell_id"), (lambda: S.nearest_in_rounds(points, cells, (20.0, 100.0)), "cell_id"), (lambda: S.nearest_home_first(points, cells, 100.0), "cell_id"),
        (lambda: K.nearest_of_layers(points, layers, "pt_id"), "near_id"), (lambda: S.nearest_ocean(points, land), "j"),
    ):
        before = calls.value
        rows = find().collect()
        assert len(rows) == 200 and {r[got] for r in rows} == ({7} if got != "j" else {189})
        assert calls.value - before < 100, got


def test_a_place_meets_edges_once_and_tells_all_its_points(spark):
    points = spark.createDataFrame([(k, 0.5, 0.5) for k in range(50)] + [(99, 5.0, 5.0)], "pt_id long, lat double, lon double")
    edges = S.edges(spark.createDataFrame([(1, 1, s, x, y) for s, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "level int, ring int, seq int, x double, y double"))
    found = S.crossings(points, edges)
    assert sorted((r.pt_id, r.level) for r in found.collect()) == [(k, 1) for k in range(50)]
    asked = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [lat" in asked  # places, before they meet edges
