"""Tables that cut a plan: written to the shared folder and read again, so that lost executors recompute from there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is made only where it is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
