"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local master, whose tasks all see
    it; on a cluster that is a ValueError, since no executor would see a folder of the driver."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/corpusloom-{kind}/{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str = "kept") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: worked out once, however often it is read."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
