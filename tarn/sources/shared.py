"""The folder that driver and executors share, for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what the session set in its stead; in local mode a folder is made if there is none."""
    sc = spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-checkpoint-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below it."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    path = base(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


#: Bytes of files for each core, below which a table is dealt out before texts are worked on.
FEW_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if its files are too small to be: one row group is one task, however long its texts are to
    work on. Tables with as many bytes as a core should have are left as they are, so nothing large is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * FEW_BYTES else df


#: Bytes of files in one share, where rows are dealt out by a key and much is made of each.
SHARE_BYTES = 8 << 20


def shares(*tables: DataFrame) -> int:
    """Into how many parts to deal tables: one for each core at least, of SHARE_BYTES of files at most."""
    size = sum(int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-size // SHARE_BYTES))
