"""A stream over files gives what a batch over the same rows gives."""

from pyspark.sql import functions as F

from pelagos.operators import rollup
from pelagos.sources import bindings
from pelagos.streaming import incremental


def _run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_counts_equal_the_batch(spark, sf, tmp_path):
    obs = bindings.obs(spark, sf).select("cell_id", "m", F.col("ts").cast("timestamp").alias("ts"), "hs")
    obs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    _run(incremental.exceedance_counts(stream), "counts", "complete")
    got = {(r["cell_id"], r["m"], r["t"]): (r["n"], r["over"]) for r in spark.table("counts").collect()}
    want = {(r["cell_id"], r["m"], r["t"]): (r["n"], round(r["n"] * r["exc"] / 100)) for r in rollup.exceedance(obs).collect()}
    assert got == want


def test_calm_spells(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 0.5), ("a", "2024-01-01 03:00:00", 0.7), ("a", "2024-01-01 06:00:00", 3.0), ("a", "2024-01-01 12:00:00", 0.4), ("b", "2024-01-01 00:00:00", None), ("b", "2024-01-09 00:00:00", 0.1)]
    samples = spark.createDataFrame(rows, "site string, ts string, hs double").withColumn("ts", F.to_timestamp("ts"))
    samples.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(samples.schema).parquet(f"{tmp_path}/in")
    _run(incremental.calm_spells(stream, 2.0), "spells", "append")
    assert sorted((r["site"], r["n"]) for r in spark.table("spells").collect()) == [("a", 1), ("a", 2)]
