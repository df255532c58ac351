"""Results of a long run, written batch by batch: what is there is whole, nothing is there twice, and a killed run goes on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _there(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where)


def saved(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All results so far. Folders that a killed run was still writing begin with an underscore, which readers skip."""
    if not _there(spark, out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").parquet(out).drop("batch")


def save_batch(rows: DataFrame, batch: int, out: str, key: str = "id") -> bool:
    """Write the rows of one batch whose keys are not saved yet, each once, first into a staged folder, which is then renamed.

    A batch that is there is done: when a run comes back to it after it was killed, it is not written again. Returns whether
    it was written now.
    """
    spark, target = rows.sparkSession, f"{out}/batch={batch}"
    if _there(spark, target):
        return False
    fresh = rows.dropDuplicates([key]).where(F.col(key).isNotNull())
    if _there(spark, out):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        fresh = fresh.join(saved(spark, out, schema).select(key), key, "left_anti").select(*rows.columns)
    staged = f"{out}/_staged-{batch}-{uuid.uuid4().hex}"
    fresh.write.parquet(staged)
    fs, where = _files(spark, target)
    if not fs.rename(_files(spark, staged)[1], where):
        raise OSError(f"{staged} could not be renamed to {target}")
    return True


def run(stream: DataFrame, out: str, checkpoint: str, key: str = "id", after=None) -> StreamingQuery:
    """Save a stream of results. after(batch): what is done once a batch is saved."""

    def each(rows: DataFrame, batch: int) -> None:
        save_batch(rows, batch, out, key)
        if after:
            after(batch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delete(spark: SparkSession, out: str) -> None:
    fs, where = _files(spark, out)
    fs.delete(where, True)


def unused(candidates: DataFrame, results: DataFrame, kept: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Candidates whose keys no result and no row that is kept uses: what a run that goes on has left to do."""
    used = results.select(key) if kept is None else results.select(key).unionByName(kept.select(key))
    return candidates.join(used.distinct(), key, "left_anti")


def in_order(results: DataFrame, tests: DataFrame, key: str = "id") -> DataFrame:
    """results with place, from 1: in the order of tests (key, ordinal), results without a test last, by key."""
    joined = results.join(tests.select(key, "ordinal"), key, "left")
    # numbered from the numbers of rows of each thousand of ordinals, so that no task numbers all
    chunk = F.when(F.col("ordinal").isNotNull(), F.floor(F.col("ordinal") / 1000)).otherwise(F.lit(2**62)).alias("chunk")
    rows = joined.select("*", chunk)
    sizes = rows.groupBy("chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("chunk").orderBy("ordinal", key))
    placed = rows.withColumn("inner", inner).join(sizes.withColumn("before", before).drop("n"), "chunk")
    return placed.withColumn("place", F.col("before") + F.col("inner")).drop("chunk", "inner", "before", "ordinal")
