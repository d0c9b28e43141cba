"""Reading the driver's tables, and tables written into the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else what setCheckpointDir() was given; a local one only where neither is set."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = getattr(spark.sparkContext, "_pelagos_dir", None) or tempfile.mkdtemp(prefix="pelagos-")
        spark.sparkContext._pelagos_dir = folder
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, and outlives a lost executor.

    The folder is removed when the driver ends, or earlier by `drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pelagos/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._pelagos_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables made by `written` that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._pelagos_path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended before
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as it takes to clash with none of the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def free_of(df: DataFrame, *names: str) -> None:
    """Raises where df has a column of one of these names, in any case of letters: Spark would not tell them apart."""
    there = {c.lower() for c in df.columns}
    if clash := [n for n in names if n.lower() in there]:
        raise ValueError(f"the table already has a column {clash[0]}")


def text_of(col: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
