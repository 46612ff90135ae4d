"""What the training-data operators share: input, scratch tables and hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Internal columns carry this prefix, so that they cannot clash with columns of the input.
OWN = "__tw_"


#: Settings of the session that these operators count on, each with the default it takes the place of.
#: Rows hold whole texts and an Arrow batch is held several times over on its way, so batches are small;
#: and many narrow tables are written between stages, which small partitions would scatter over files.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": ("true", "false"),
}


def settle(spark: SparkSession) -> None:
    """SETTINGS from now on, except where the session has values of its own.

    Only the registered queries call this; the operators leave the session as it is.
    """
    for key, (default, wanted) in SETTINGS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, wanted)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and all runs on this machine (tests)."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwork-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tarnwork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one in so many rows is a hot one.
HOT_SHARE = 1_000


def join_counted(rows: DataFrame, per_key: DataFrame, same: Column, n: Column, total: int) -> DataFrame:
    """rows joined (inner) to per_key, one line per key, where n of all total rows have that key.

    The lines of hot keys, fewer than HOT_SHARE, are broadcast, so the rows of
    a hot key stay where they are; those of the others are shuffled.
    """
    is_hot = n > total / HOT_SHARE
    hot = broadcast(per_key.where(is_hot))
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(per_key.where(~is_hot), same))
