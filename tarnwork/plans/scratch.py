"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def scratch_folder(df: DataFrame) -> str:
    """The folder that the cluster names, or one of our own where none is set and all runs on this machine (tests)."""
    spark = df.sparkSession
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwork-"))
            current = context._jsc.sc().getCheckpointDir()
        shared = current.get()
    return shared.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread. The files go when
    the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(df)}/tarnwork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
