"""A folder that all executors and the driver share, for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir; where that is unset, in a temporary folder of a local session, or the warehouse of a cluster's."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        top = tempfile.mkdtemp(prefix="pelagos-") if sc.master.startswith("local[") or sc.master == "local" else spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/pelagos/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: what several branches of a plan read is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
