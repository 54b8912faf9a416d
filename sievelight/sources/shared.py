"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, also set as the place of checkpoints. Where none is named a temporary folder
    is taken on a local master; on a cluster, whose machines would not share it, this is refused."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='sievelight-')}")
    return (named or sc.getCheckpointDir()).rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: they are fixed, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
